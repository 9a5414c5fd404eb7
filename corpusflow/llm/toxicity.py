"""Toxicity by multiple-instance learning: labels of documents teach a score of sentences.

A sentence's score is logistic in its hashed words; a document is toxic unless every sentence is
clean, so its score is the noisy-or of its sentences. The likelihood of the document labels
alone trains the sentence weights, which then point at the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, in_fold, table
from .features import Adam, Remembered, bucket, labelled_sample

BUCKETS = 1 << 18
#: Labelled documents that training reads at most.
SAMPLE_ROWS = 6000
#: Documents of the sample that must hold a word (a bucket) for it to get a weight.
LEAST_DOCS = 3
#: Likelihood ratio that a word's link with the label must reach.
EVIDENCE = 12.0
EPOCHS, RATE, DECAY = 150, 0.1, 1e-5
#: A longer word is also known by its first letters, so that the forms of a stem learn from each other.
STEM = 4
SENTENCE_END = re.compile(r"[.!?\n…。！？]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class SentenceModel:
    weights: np.ndarray  # one per bucket
    bias: float


def sentences_of(text: str | None) -> list[str]:
    """Sentences in lower case; at least one, so that an empty text has a score too."""
    return SENTENCE_END.split((text or "").lower())


def buckets_of(word: str, size: int) -> tuple[int, ...]:
    """Buckets of a word: its own and its stem's."""
    own = bucket(word, size)
    return (own, bucket("^" + word[:STEM], size)) if len(word) > STEM else (own,)


def telling(owner: np.ndarray, words: np.ndarray, toxic: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in enough documents whose presence goes with the label, by the likelihood ratio of the 2 x 2 table."""
    pairs = np.unique(owner.astype(np.int64) * buckets + words)
    with_word = np.bincount(pairs % buckets, minlength=buckets).astype(float)
    both = np.bincount((pairs % buckets)[toxic[pairs // buckets] > 0], minlength=buckets).astype(float)
    n, positive = len(toxic), toxic.sum()
    ratio = np.zeros(buckets)
    for seen, expected in (
        (both, with_word * positive / n),
        (with_word - both, with_word * (n - positive) / n),
        (positive - both, (n - with_word) * positive / n),
        (n - positive - with_word + both, (n - with_word) * (n - positive) / n),
    ):
        ratio += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0)
    return (ratio >= EVIDENCE) & (with_word >= LEAST_DOCS)


def train(sample: DataFrame, buckets: int = BUCKETS, epochs: int = EPOCHS) -> SentenceModel:
    """Fit to ``text, label`` (0 or 1). Without rows of both labels every text gets a score near zero."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Remembered(lambda w: buckets_of(w, buckets))
        for batch in batches:
            words, ends = [], []
            for text in batch["text"]:
                per = [sorted({b for w in WORD.findall(s) for b in numbers[w]}) for s in sentences_of(text)]
                words.append([w for p in per for w in p])
                ends.append([len(p) for p in per if p])
            yield pd.DataFrame({"_id": batch["_id"], "label": batch["label"], "words": words, "sizes": ends})

    rows = sample.mapInPandas(hashed, "_id long, label int, words array<int>, sizes array<int>").toPandas()
    # the same rows in any order of arrival
    rows = rows[rows["sizes"].str.len() > 0].sort_values("_id", kind="stable") if len(rows) else rows
    weights, bias = np.zeros(buckets + 1), -8.0
    if len(rows) and rows["label"].nunique() > 1:
        weights[-1] = -5.0
        words = np.concatenate(rows["words"].to_list())
        sizes = np.concatenate(rows["sizes"].to_list()).astype(np.int64)
        of = np.repeat(np.arange(len(rows)), rows["sizes"].str.len())
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), rows["words"].str.len())
        rows = rows.drop(columns=["words"])
        toxic = (rows["label"].to_numpy() > 0).astype(float)
        # words that say nothing of the label weigh nothing: leave them out of the sums
        weighed = telling(owner, words, toxic, buckets)[words]
        sentence = np.repeat(np.arange(len(sizes)), sizes)[weighed]
        words = words[weighed]
        adam = Adam(weights, RATE)
        for _ in range(epochs):
            z = np.bincount(sentence, weights[words], len(sizes)) + weights[-1]
            clean = np.bincount(of, -np.logaddexp(0, z), len(rows))  # log of the chance that all are clean
            p = -np.expm1(np.minimum(clean, -1e-12))
            pull = np.where(toxic > 0, -(1 - p) / p, 1.0)[of] / (1 + np.exp(-z))
            gradient = np.bincount(words, pull[sentence], buckets + 1)
            gradient[-1] = pull.sum()
            gradient /= len(rows)
            gradient[:-1] += DECAY * weights[:-1]
            adam.step(gradient)
        bias = float(weights[-1])
    return SentenceModel(weights[:-1].astype(np.float32), bias)


def score_toxicity(docs: DataFrame, model: SentenceModel, sentence_threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, spans`` for every row, from the whole text alone.

    ``score`` is the noisy-or of all sentences' scores. ``spans`` holds start, end (code points of the
    text) and score of each sentence whose own score is at least ``sentence_threshold``. Sentences without
    words don't count; a text without any has one empty sentence.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = shared.value
        size, find = len(weights), WORD.findall
        of = Remembered(lambda w: [(b, float(weights[b])) for b in buckets_of(w, size) if weights[b]]).__getitem__

        def sentence(words: list[str]) -> float:
            # most words weigh nothing; a bucket counts once, as in training
            known = [pairs for pairs in map(of, set(words)) if pairs]
            return sum(dict(p for pairs in known for p in pairs).values()) if known else 0.0

        for batch in batches:
            scores, spans = [], []
            for text in batch["text"]:
                # sentences without words are none, as in training
                spoken = [(i, w) for i, s in enumerate(sentences_of(text)) if (w := find(s))] or [(0, [])]
                z = np.array([sentence(w) for _, w in spoken]) + bias
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                p = 1 / (1 + np.exp(-z))
                found = []
                if (p >= sentence_threshold).any():
                    edges = [(m.start(), m.end()) for m in SENTENCE_END.finditer(text)] if text else []
                    starts, ends = [0, *(e for _, e in edges)], [*(s for s, _ in edges), len(text)]
                    found = [{"start": starts[i], "end": ends[i], "score": float(q)} for (i, _), q in zip(spoken, p) if q >= sentence_threshold]
                spans.append(found)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores, "spans": spans})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, score double, spans array<struct<start:int,end:int,score:double>>")


@answer()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(labelled_sample(docs, labels, "toxic", SAMPLE_ROWS, ~in_fold("_id")))
    found = score_toxicity(docs, model)
    return found.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
