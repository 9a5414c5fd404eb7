"""Language identification by compression: the dictionary that makes a text smallest names its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, in_fold, table

#: Bytes of each language's raw-content dictionary, and of all dictionaries together at most.
DICTIONARY_BYTES = 1 << 16
ALL_BYTES = 1 << 25
#: Code points taken from one training row.
PIECE = 256
#: Bytes of a text that are compressed at once: short enough for the dictionary to count in every part.
PART = 1 << 10
LEVEL = 6
UNKNOWN = "und"


def train_dictionaries(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
    dictionary_bytes: int = DICTIONARY_BYTES, all_bytes: int = ALL_BYTES,
) -> dict[str, bytes]:
    """One raw-content dictionary per language, from a bounded sample of labelled rows.

    Rows are chosen by a hash of their text; from each a piece of at most ``PIECE`` code points at a place
    chosen by that hash is taken, so the dictionaries do not depend on the order of the rows. A language
    gets at most ``dictionary_bytes`` (the most frequent language comes first), fewer if all languages together would take over ``all_bytes``.
    Rows without language or letters teach nothing. Equal texts are one; each language keeps at least one text, so none is lost.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    chance = F.xxhash64(F.lit("row"), "text") / F.lit(float(1 << 64)) + 0.5
    # copies have one chance together, so a language of few much copied texts keeps them
    texts = labelled.groupBy("lang", chance.alias("chance")).agg(F.count("*").alias("rows"))
    sizes = texts.groupBy("lang").agg(F.sum("rows").alias("n"), F.count("*").alias("texts"), F.min("chance").alias("least"))
    languages = sizes.count()
    if not languages:
        return {}
    each = max(1024, min(dictionary_bytes, all_bytes // languages))
    # rows expected to fill a dictionary twice over, at the least half a kilobyte a row
    wanted = 4 * each // PIECE
    spot = F.pmod(F.xxhash64(F.lit("spot"), "text"), F.greatest(F.lit(1), F.length("text") - PIECE + 1)).cast("int") + 1
    pieces = (
        # one row per language: far less than the dictionaries, which every task holds
        labelled.join(F.broadcast(sizes), "lang")
        .where((chance < F.lit(float(wanted)) / F.col("texts")) | (chance == F.col("least")))
        .select("lang", chance.alias("order"), F.substring("text", spot, F.lit(PIECE)).alias("piece"))
        .distinct()
    )
    chosen = pieces.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("order", "piece"))).alias("rows")).join(sizes, "lang")
    found = {}
    for row in sorted(chosen.toLocalIterator(), key=lambda r: (-r.n, r.lang)):
        raw = "\n".join(r.piece for r in row.rows).lower().encode("utf-8", "replace")
        found[row.lang] = raw[:each]
    return found


def classifier(dictionaries: dict[str, bytes]):
    """A function from texts to (best language, its probability, margin to the second)."""
    names = list(dictionaries)
    compressors = []
    for name in names:
        data = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def classify(text: str) -> tuple[str, float, float]:
        raw = text.lower().encode("utf-8", "replace")
        parts = [raw[i : i + PART] for i in range(0, len(raw), PART)]
        sizes = np.array([sum(len(c(p)) for p in parts) for c in compressors], float)
        best = int(sizes.argmin())
        # relative sizes as logits: a hundredth of the size is a factor of e
        share = float(1 / np.exp((sizes[best] - sizes) / sizes[best] * 100).sum())
        second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
        return names[best], share, float(min(1.0, (second - sizes[best]) / second)) if second < np.inf else 1.0

    return classify


def identify_language(
    docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, lang, best, score, margin, letters`` for every row, from the whole text alone.

    ``best`` is the language whose dictionary compresses the text to the fewest bytes, summed over
    all its parts; ties go to the language with most labelled rows. ``margin`` is the saving against the second. ``lang`` is
    ``best`` unless the margin is under ``min_margin``: such texts are rejected as ``und``. A text
    that is null or has no letter is ``und`` with score zero in both, as is any without dictionaries.
    """
    names = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = classifier(names.value) if names.value else None
        for batch in batches:
            rows = [
                classify(text) if letters and classify else (UNKNOWN, 0.0, 0.0)
                for text, letters in zip(batch["text"], batch["letters"])
            ]
            best, score, margin = (list(x) for x in zip(*rows)) if rows else ([], [], [])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "lang": [b if m >= min_margin else UNKNOWN for b, m in zip(best, margin)],
                "best": best, "score": score, "margin": margin, "letters": batch["letters"],
            })

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = chosen.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return chosen.mapInPandas(run, "doc_id long, lang string, best string, score double, margin double, letters boolean")


@answer()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, train_dictionaries(docs.where(~in_fold())))
    return found.select(
        "doc_id", in_fold().alias("held_out"), F.col("best").alias("lang_pred"), "score", "margin", F.col("lang").alias("lang_or_rejected")
    )
