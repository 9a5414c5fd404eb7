"""A stored index of words: asked about one word, it reads the blocks of that word and no text.

Four tables below one folder. ``postings`` holds the positions of each token in each section, cut
into rows of bounded length; ``pairs`` the co-occurrences within a window; ``vocabulary`` and ``sizes`` the margins.
Postings and pairs are range-partitioned and sorted by token, the postings of a frequent token over several files; Parquet keeps minima and maxima
of each row group and a Bloom filter of its tokens, and stores positions as differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import concordance as kwic
from . import textometry as tx

#: The most positions in one row.
BLOCK = 4096
#: Tokens whose positions a task lists at a time.
BATCH_TOKENS = 1 << 19
#: Words that a pattern may have in the vocabulary to be looked up by name; more are joined.
NAMED = 1000
ROW_GROUP_BYTES = 1 << 20


class Index(NamedTuple):
    postings: DataFrame
    sizes: DataFrame
    vocabulary: DataFrame
    pairs: DataFrame
    window: int


def postings_of(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """``token, section_id, part, positions`` (from 0, ascending) of tokenised sections."""
    kind = tokens.schema["section_id"].dataType.simpleString()
    lists = tokens.select("section_id", "tokens").mapInArrow(_position_lists, f"token string, section_id {kind}, all array<int>")
    # the lists of a section that stands in several rows are put together; ids travel, not tokens
    repeated = tokens.groupBy("section_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("section_id").alias("_again"))
    if not repeated.isEmpty():
        same = F.col("section_id").eqNullSafe(F.col("_again"))
        merged = lists.join(repeated, same, "left_semi").groupBy("token", "section_id").agg(F.sort_array(F.flatten(F.collect_list("all"))).alias("all"))
        lists = lists.join(repeated, same, "left_anti").unionByName(merged)
    parts = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(block)), lambda i: F.slice("all", i + 1, F.lit(block)))
    return lists.select("token", "section_id", F.posexplode(parts).alias("part", "positions"))


def _position_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, section_id, all``: the positions of each distinct token of a row, ascending."""
    for part in tx._slices(batches, BATCH_TOKENS):
        for batch in part:
            words, codes, sizes = tx.coded([batch])
            if not len(codes):
                continue
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((row, codes))  # stable: positions stay in order
            key = codes[order] * batch.num_rows + row[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
            columns = [words.take(pa.array(codes[order][first])), batch.column("section_id").take(pa.array(row[order][first])), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "section_id", "all"])


def write_index(tokens: DataFrame, path: str, window: int = 5, row_group_bytes: int = ROW_GROUP_BYTES, files: int | None = None) -> None:
    """Index the tokenised sections; ``tokens`` is read once for each table, so store what is costly to make.

    ``files`` is the number of ranges of the two large tables, else as many as shuffle partitions.
    """
    def ranged(df: DataFrame, *keys: str) -> DataFrame:
        return (df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def written(df: DataFrame, name: str, *keys: str) -> None:
        (
            df.write.option("compression", "zstd")
            .option("parquet.block.size", row_group_bytes).option("parquet.writer.version", "v2")
            .option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").option("parquet.bloom.filter.max.bytes", 1 << 18)
            .option("parquet.enable.dictionary#positions.list.element", "false")
            .mode("overwrite").parquet(f"{path}/{name}")
        )

    written(ranged(postings_of(tokens), "token", "section_id", "part"), "postings", "token")
    written(tx.packed_cooccurrences(tokens, window, files), f"pairs/window={window}", "x")
    # the margins are sums over the postings, which are sorted by token
    freq = tokens.sparkSession.read.parquet(f"{path}/postings").select("token", "section_id", "part", F.size("positions").cast("long").alias("freq"))
    freq.groupBy("section_id").agg(F.sum("freq").alias("size"), F.count_if(F.col("part") == 0).alias("n_types")).write.mode("overwrite").parquet(f"{path}/sizes")
    written(ranged(freq.groupBy("token").agg(F.sum("freq").alias("totfreq")), "token"), "vocabulary", "token")


def read_index(spark: SparkSession, path: str, window: int = 5) -> Index:
    part = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(part("postings"), part("sizes"), part("vocabulary"), part(f"pairs/window={window}"), window)


def token_positions(index: Index, token: str) -> DataFrame:
    """``section_id, pos`` of each occurrence."""
    return index.postings.where(F.col("token") == token).select("section_id", F.explode("positions").alias("pos"))


def sections_with_token(index: Index, token: str) -> DataFrame:
    """As the scan of bags: sections that hold the token, with its frequency."""
    rows = index.postings.where(F.col("token") == token)
    return rows.groupBy("section_id").agg(F.sum(F.size("positions")).alias("freq"))


def token_evolution(index: Index, token: str, threshold: float = 5.0) -> DataFrame:
    """As the scan of bags: frequency and specificity of the token in all sections."""
    cells = index.sizes.select("section_id", "size").join(sections_with_token(index, token), "section_id", "left")
    return tx.evolution(cells.na.fill(0, ["freq"]).select("section_id", "size", "freq"), threshold)


def phrase(index: Index, words: list[str]) -> DataFrame:
    """``section_id, pos`` where the words stand one after the other; only their postings are read."""
    found = token_positions(index, words[0])
    for i, word in enumerate(words[1:], 1):
        here = token_positions(index, word).select("section_id", (F.col("pos") - i).alias("pos"))
        found = found.join(here, ["section_id", "pos"], "left_semi")
    return found


def concordance(index: Index, texts: DataFrame, id_col: str, column: str, word: str, before: int = 100, after: int = 100, trim: bool = True) -> DataFrame:
    """As the scan of all texts for a plain word; only texts that the index names are searched.

    Tokens may hold further signs around a word, so the vocabulary is searched by the pattern and the postings of
    what it finds are read: by name if these are few, else by a join.
    """
    regex = kwic.match_pattern(word, True, True)
    found = index.vocabulary.where(F.col("token").rlike(regex)).select("token")
    few = [r.token for r in found.limit(NAMED + 1).collect()]
    rows = index.postings.where(F.col("token").isin(few)) if len(few) <= NAMED else index.postings.join(found, "token", "left_semi")
    chosen = rows.select(F.col("section_id").alias(id_col)).distinct()
    return kwic.concordance(texts.join(chosen, id_col, "left_semi"), id_col, column, word, before, after, trim=trim)


def collocation_table(index: Index, token: str, pattern: str | None = None, threshold: float = 5.0) -> DataFrame:
    """Collocates of the token, scored from its own pairs."""
    scored = tx.collocation_specificity(index.pairs.where(F.col("x") == token), index.vocabulary, index.window, threshold)
    return tx.collocation_table(scored, index.vocabulary, token, pattern)


def collocation_graph(index: Index, token: str, k: int = 5, depth: int = 1) -> DataFrame:
    return tx.collocation_graph_of(index.pairs, index.vocabulary, index.window, token, k, depth)
