"""Two-pass Bloom filtering: which keys may occur more than once?

Pass one marks, in bit maps of bounded size, the places that one key and that two keys have
hit. Each task fills its own maps, page by page; pages are then merged by their number.
Pass two asks the second map. A key that occurs twice is always found; a key that occurs once
is found by chance with a small probability, which costs time and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 1 << 15  # bytes of a page of either map
PROBES = 4
#: A filter never takes more bits than this (64 MB), whatever the number of keys. With more
#: keys the work is done in rounds over disjoint parts of the key space, each with its own map.
MAX_BITS = 1 << 29
BITS_PER_KEY = 16


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each 64-bit key, one row per key; ``bits`` is a power of two."""
    mixed = keys.astype(np.uint64)
    step = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[None, :]
    return (((mixed[:, None] + steps * step[:, None]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & np.uint64(bits - 1)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def map_bits(keys: int, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> tuple[int, int]:
    """Bits of one map and number of rounds for so many keys."""
    wanted = max(keys * bits_per_key, PAGE * 8)
    bits = min(1 << (wanted - 1).bit_length(), max_bits)
    return bits, -(-wanted // max_bits) if wanted > max_bits else 1


def repeated_map(keys: DataFrame, key: str, bits: int, tasks: int = 64) -> np.ndarray:
    """The bit map of places that at least two occurrences of keys have hit.

    ``keys`` should be a narrow stored table: it is read by at most ``tasks`` tasks, so that a
    page has at most ``tasks`` versions to merge. The map has ``bits`` bits, on the driver too.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            values = batch[key].dropna().to_numpy(np.int64).view(np.uint64)
            # a key's own places are made distinct; places of different rows may then meet
            at = np.sort(places(values, bits), axis=1)
            own = np.ones(at.shape, bool)
            own[:, 1:] = at[:, 1:] != at[:, :-1]
            seen, counts = np.unique(at[own], return_counts=True)
            _set(twice, seen[(counts > 1) | _has(once, seen)])
            _set(once, seen)
        for page in np.flatnonzero(once.reshape(-1, PAGE).any(axis=1)):
            part = slice(page * PAGE, (page + 1) * PAGE)
            yield pd.DataFrame({"page": [page], "once": [once[part].tobytes()], "twice": [twice[part].tobytes()]})

    def merge(pages: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(PAGE, np.uint8), np.zeros(PAGE, np.uint8)
        for a, b in zip(pages["once"], pages["twice"]):
            more = np.frombuffer(a, np.uint8)
            twice |= np.frombuffer(b, np.uint8) | (once & more)
            once |= more
        return pd.DataFrame({"page": pages["page"].iloc[:1], "twice": [twice.tobytes()]})

    filled = keys.select(key).coalesce(tasks).mapInPandas(fill, "page long, once binary, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in filled.groupBy("page").applyInPandas(merge, "page long, twice binary").toLocalIterator():
        whole[row.page * PAGE : (row.page + 1) * PAGE] = np.frombuffer(row.twice, np.uint8)
    return whole


def asks(df: DataFrame, bitmap: np.ndarray):
    """A function of arrays of 64-bit keys: may the key occur more than once?"""
    shared = df.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    bits = len(bitmap) * 8

    def ask(values: np.ndarray) -> np.ndarray:
        found = np.frombuffer(shared.value, np.uint8)
        # most keys are told by their first place
        maybe = _has(found, ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & np.uint64(bits - 1))
        at = np.flatnonzero(maybe)
        if len(at):
            maybe[at] = _has(found, places(values[at], bits)).all(axis=1)
        return maybe

    return ask


def maybe_repeated(df: DataFrame, key: str, bitmap: np.ndarray) -> Column:
    """The same as a column."""
    ask = asks(df, bitmap)

    @F.pandas_udf("boolean")
    def flag(values: pd.Series) -> pd.Series:
        return pd.Series(ask(values.to_numpy(np.int64).view(np.uint64)))

    return flag(F.col(key))
