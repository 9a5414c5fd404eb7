"""Quality by ordinal regression: one hashed score of the text, ordered thresholds between grades.

P(grade <= k) = logistic(threshold_k - score): the weights of the text are shared by all grades. From
the tail probabilities follow the expected grade and the chance of a wanted grade, by which rows are chosen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, in_fold, table
from .features import Adam, Remembered, bucket, labelled_sample

BUCKETS = 1 << 18
SAMPLE_ROWS = 4000
LEAST_DOCS = 3
EPOCHS, RATE, DECAY = 150, 0.1, 1e-5
#: A text's feature values are shares of its tokens, times this.
SCALE = 20.0
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class GradeModel:
    weights: np.ndarray  # one per bucket
    grades: list[int]  # ascending
    thresholds: np.ndarray  # ascending, one fewer than grades


def shape(token: str) -> str:
    """How a token is written: runs of capitals, small letters, digits, and its signs as they are."""
    signs = []
    for c in token[:24]:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not signs or signs[-1] != kind:
            signs.append(kind)
    return "".join(signs)


def features_of(token: str, size: int) -> tuple[int, int]:
    """Buckets of a token's letters and of its shape."""
    word = "".join(LETTERS.findall(token)).lower()
    return bucket(word, size), bucket("\x00" + shape(token), size)


def tokens_of(text: str | None) -> list[str]:
    """Tokens between white space, and marks for each token that repeats the one before or a pair of tokens."""
    tokens = (text or "").split()
    pairs = list(zip(tokens, tokens[1:]))
    same = sum(a == b for a, b in pairs)
    return tokens + ["\x01same"] * same + ["\x01again"] * (len(pairs) - len(set(pairs)))


def train(sample: DataFrame, buckets: int = BUCKETS, epochs: int = EPOCHS) -> GradeModel:
    """Fit to ``text, label``, labels being whole grades. With fewer than two grades nothing is told apart."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Remembered(lambda t: features_of(t, buckets))
        for batch in batches:
            found = [np.array([numbers[t] for t in tokens_of(text)], np.int32).ravel().tolist() for text in batch["text"]]
            yield pd.DataFrame({"_id": batch["_id"], "label": batch["label"], "found": found})

    rows = sample.mapInPandas(hashed, "_id long, label int, found array<int>").toPandas()
    rows = rows.sort_values("_id", kind="stable")
    grades = sorted(rows["label"].unique().tolist())
    weights = np.zeros(buckets)
    if len(grades) < 2:
        return GradeModel(weights.astype(np.float32), grades or [0], np.zeros(max(0, len(grades) - 1)))
    counts = rows["found"].str.len().to_numpy()
    keys = np.repeat(np.arange(len(rows)) * buckets, counts)
    keys += np.concatenate(rows["found"].to_list())
    rows = rows.drop(columns=["found"])
    pairs, times = np.unique(keys, return_counts=True)
    del keys
    owner, words = pairs // buckets, pairs % buckets
    value = times / np.maximum(1, counts // 2)[owner] * SCALE
    usual = np.bincount(words, minlength=buckets)[words] >= LEAST_DOCS
    owner, words, value = owner[usual], words[usual], value[usual]
    grade = np.searchsorted(grades, rows["label"].to_numpy())
    # thresholds start at the observed shares; the gaps stay positive by an exponential
    share = np.clip(np.cumsum(np.bincount(grade, minlength=len(grades)))[:-1] / len(rows), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    tail = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    fit, edges = Adam(weights, RATE), Adam(tail, RATE / 2)
    for _ in range(epochs):
        t = np.concatenate([[-np.inf], tail[0] + np.concatenate([[0], np.cumsum(np.exp(tail[1:]))]), [np.inf]])
        score = np.bincount(owner, weights[words] * value, len(rows))
        with np.errstate(over="ignore"):
            upper, lower = (1 / (1 + np.exp(score - t[grade + i])) for i in (1, 0))
        chance = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        gradient = np.bincount(words, (up - low)[owner] * value, buckets) / len(rows)
        fit.step(gradient + DECAY * weights)
        at = (np.bincount(grade, low, len(grades))[1:] - np.bincount(grade, up, len(grades))[:-1]) / len(rows)
        later = np.cumsum(at[::-1])[::-1]
        edges.step(np.concatenate([[later[0]], later[1:] * np.exp(tail[1:])]))
    return GradeModel(weights.astype(np.float32), grades, tail[0] + np.concatenate([[0], np.cumsum(np.exp(tail[1:]))]))


def graded(spark: SparkSession, model: GradeModel, wanted: int, text_col: str = "text") -> Column:
    """A column ``(expected_grade, tail_probability)`` from the whole text alone.

    ``tail_probability`` is the chance of a grade of at least ``wanted``. A null or empty text has the
    score zero, hence the chances of the thresholds alone.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        size = len(m.weights)
        of = Remembered(lambda t: float(sum(m.weights[b] for b in features_of(t, size)))).__getitem__
        grades, above = np.array(m.grades, float), np.searchsorted(m.grades, wanted)
        for texts in batches:
            scores = np.zeros(len(texts))
            for i, text in enumerate(texts):
                tokens = tokens_of(text)
                scores[i] = sum(map(of, tokens)) / max(1, len(tokens)) * SCALE
            below = 1 / (1 + np.exp(np.clip(scores[:, None] - m.thresholds[None, :], -500, 500)))
            below = np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))])
            yield pd.DataFrame({"expected_grade": np.diff(below, axis=1) @ grades, "tail_probability": 1 - below[:, above]})

    return run(F.col(text_col).cast("string"))


def grade_texts(docs: DataFrame, model: GradeModel, wanted: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability`` for every row; ids pass through as they are."""
    grade = graded(docs.sparkSession, model, wanted, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), grade.alias("grade")).select("doc_id", "grade.*")


#: Documents stay when a good grade is at least this likely.
KEEP = 0.5


def model_of(spark: SparkSession, sf_dir: str) -> GradeModel:
    """The model of the labels beside the documents, without the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return train(labelled_sample(docs, labels, "quality", SAMPLE_ROWS, ~in_fold("_id")))


def drop_rejected(docs: DataFrame, model: GradeModel, wanted: int = 1, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose tail probability is at least ``keep``."""
    return docs.where(graded(docs.sparkSession, model, wanted, text_col)["tail_probability"] >= keep)


@answer()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grade_texts(table(spark, sf_dir, "documents"), model_of(spark, sf_dir), wanted=1)
    return found.select("doc_id", in_fold().alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP).alias("kept"))
