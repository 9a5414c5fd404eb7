"""Exact duplicates by two-pass Bloom filtering: rows whose text is surely unique never shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import bloom
from ..plans.skew import lookup_join
from .common import answer, stored, table, text_of

#: White space that counts as one space: the six ASCII characters.
WHITE = r"[\x20\x09-\x0D]+"


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = bloom.BITS_PER_KEY,
    max_filter_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after white space runs became one space; a null text
    is an empty one. Of equal texts the row with the smallest id stays; a null id comes after all
    others, and of rows that repeat id and text exactly one stays. An empty table gives an empty
    result. Other columns are not read.

    Only digests are stored and compared, never texts. Rows that the filter calls unique pass
    straight to the result; the others are counted by digest with partial aggregation, and get
    their group's row by a join that spreads hot digests.
    """
    digests = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.regexp_replace(text_of(text_col), WHITE, " "), 256)).alias("sha"),
        ).select("doc_id", "sha", F.xxhash64("sha").alias("h"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    bits, rounds = bloom.map_bits(digests.count(), bits_per_row, max_filter_bits)
    parts = []
    for r in range(rounds):
        part = digests if rounds == 1 else digests.where(F.pmod("h", F.lit(rounds)) == r)
        part = part.withColumn("maybe", bloom.maybe_repeated(part, "h", bloom.repeated_map(part, "h", bits)))
        unique = part.where(~F.col("maybe")).select("doc_id", "sha", "row", F.lit(None).cast("long").alias("size"),
                                                    F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"))
        suspects = part.where("maybe").select("doc_id", "sha", "row")
        groups = stored(
            suspects.groupBy("sha")
            .agg(F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
            .where("size > 1")
            .select("sha", "size", F.struct("size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")).alias("found")),
            "repeated",
        )
        joined = lookup_join(suspects, groups, "sha", "found", F.col("size"), F.col("row"), "left")
        parts += [unique, joined.select("doc_id", "sha", "row", "found.size", "found.keep_id", "found.keep_row")]
    every = reduce(DataFrame.unionByName, parts)
    alone = F.col("size").isNull()
    return every.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


@answer(
    r"""SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)"""
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
