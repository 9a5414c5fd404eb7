"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import bloom
from ..plans.checkpoints import scratch_path, stored
from ..queries.base import table

__all__ = ["QUERIES", "SQL", "answer", "in_fold", "scratch_path", "stored", "table", "text_of", "unused", "without", "words_of"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def answer(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this package under its own name, with its SQL if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def text_of(col: str) -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is not in the only column of ``gone``; null ids stay.

    Rows that a bit map tells to stay are not shuffled; the others are joined exactly. ``docs`` is read twice.
    """
    gone = stored(gone.distinct(), "gone")
    key, name = unused(docs, "key"), gone.columns[0]
    bits, _ = bloom.map_bits(gone.count())
    # each id is put in twice
    marked = docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)))
    maybe = bloom.maybe_repeated(marked, key, bloom.repeated_map(gone.unionAll(gone), name, bits))
    stays, asked = marked.where(~maybe).drop(key), marked.where(maybe).drop(key)
    return stays.unionAll(asked.join(gone, asked[f"`{id_col}`"].cast("long") == gone[name], "left_anti"))


def in_fold(id_col: str = "doc_id") -> Column:
    """Rows that are held out of training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key`` alone; all rows where there are fewer.

    The choice depends neither on the order nor on the partitions of the rows. Used only to
    fit models, never to score.
    """
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where((F.xxhash64(F.lit("sample"), key) % (1 << 40)) / float(1 << 40) * 0.5 + 0.5 < bound / n)


def as_u64(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint64)


def as_i64(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)
