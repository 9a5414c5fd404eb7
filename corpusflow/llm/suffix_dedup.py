"""Removing passages that an earlier document has too, by sorting suffixes that are compared by hashes.

A window of 50 bytes holds 35 grams of 16 bytes; the least gram hash, its anchor, depends on nothing but the window.
Neighbouring windows of one anchor are a fragment of at most 84 bytes, and equal windows always lie in fragments of
one anchor. So texts are cut into fragments, the few anchors that occur again are found by bit maps of bounded size, and
only fragments of these shuffle: as two hashes where all fragments of an anchor are equal, else with their bytes.

The different fragments of an anchor are compared by the suffixes that start their windows. Prefix polynomial hashes
give the hash of any substring at once, binary search on its length the common extension of two suffixes, and a
mergesort over all anchors of a batch their order. What the order says is verified byte by byte; after a collision the batch is sorted anew
with other hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import lookup_join
from .common import answer, as_i64, as_u64, stored, table, text_of

WINDOW, GRAM = 50, 16
#: Windows that may share an anchor, and the most windows of a fragment.
SPAN = WINDOW - GRAM + 1
#: Bytes of text that are hashed together. A longer text is taken in pieces that overlap by a window less one.
BLOCK_BYTES = 1 << 16
#: Fragments that a task gathers before it hands them on, and different fragments that are sorted together at least.
CHUNK, BATCH = 1 << 18, 1 << 13
#: An anchor of more different fragments is hot: its windows are fragments of their own, so no task gets them all.
HOT = 4096
#: Text bytes for each bucket of a bit map, and the most bits of one (64 MB).
BUCKET_BYTES, LEAST_BUCKETS = 1 << 28, 64
MAX_BITS = 1 << 29
#: Null ids come after all others.
NO_ID = (1 << 63) - 1
SEED = 42

U = np.uint64
#: Hashes by which suffixes are compared: narrow, as every order that they give is verified.
NARROW = np.uint32
#: Hashes that are tried; each fails for a batch about once in a thousand times.
TRIES = 20


# ------------------------------------------------------------------ prefix polynomial hashes


@cache
def _base(seed: int) -> tuple[np.ndarray, int, int]:
    """A number for each byte, an odd base and its inverse, modulo 2^64."""
    rng = np.random.default_rng([seed, WINDOW])
    base = int(rng.integers(0, 1 << 63)) * 2 + 1
    return rng.integers(0, 1 << 64, 256, U), base, pow(base, -1, 1 << 64)


_powers: dict[tuple[int, type], tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, seed: int = SEED, width: type = U) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if (seed, width) not in _powers or len(_powers[seed, width][0]) < n:
        _, *bases = _base(seed)
        found = []
        for b in bases:
            steps = np.full(n, b & int(np.iinfo(width).max), width)
            steps[:1] = 1
            found.append(np.multiply.accumulate(steps, dtype=width))
        _powers[seed, width] = found[0], found[1]
    up, down = _powers[seed, width]
    return up[:n], down[:n]


class Hashed:
    """A text with the hashes of its prefixes: the hash of any substring costs two look-ups."""

    def __init__(self, data: np.ndarray, seed: int = SEED, width: type = U):
        up, self.down = powers(len(data) + 1, seed, width)
        self.data = data
        self.prefix = np.zeros(len(data) + 1, width)
        coded = _base(seed)[0].astype(width)[data]
        coded *= up[:-1]
        np.cumsum(coded, out=self.prefix[1:], dtype=width)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension from each place of ``a`` and of ``b``, at most ``most``: binary search on equal hashes."""
        from_a, from_b, down_a, down_b = self.prefix[a], self.prefix[b], self.down[a], self.down[b]
        low, step = np.zeros(len(a), np.int64), 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while step:
            # beyond its end a suffix is asked for its whole length again
            to = np.minimum(low + step, most)
            equal = (self.prefix[a + to] - from_a) * down_a == (self.prefix[b + to] - from_b) * down_b
            low = np.where(equal, to, low)
            step >>= 1
        return low

    @cached_property
    def words(self) -> np.ndarray:
        """Eight bytes from each place on, as a little-endian number."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))

    def first_bytes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first eight bytes of each text[start:end] as a number of the same order; zeros after its end."""
        length = np.minimum(end - start, 8)
        return np.where(length > 0, self.words[start].byteswap() & (~U(0) << (U(8) * (8 - np.maximum(length, 1)).astype(U))), U(0))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


# ------------------------------------------------------------------ suffix sort


def _stands_before(text: Hashed, start: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
    """Whether suffix ``x`` is smaller than ``y``, by hashes; equal ones count where ``or_equal``."""
    a, b = start[x], start[y]
    length_a, length_b = end[x] - a, end[y] - b
    shared = text.common(a, b, np.minimum(length_a, length_b))
    ended_a, ended_b = shared == length_a, shared == length_b
    last = len(text.data) - 1
    smaller = text.data[np.minimum(a + shared, last)] < text.data[np.minimum(b + shared, last)]
    return np.where(ended_a | ended_b, ended_a & (~ended_b | or_equal), smaller)


def sorted_suffixes(text: Hashed, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of the suffixes text[start:end] in order, within each group; ``group`` must be ascending.

    A mergesort from below: at each level every suffix finds by binary search how many of the run that it is merged
    with stand before it, and so its place. Groups that are already one run take no part. Two suffixes are
    compared by their first eight bytes, and if these agree by their common extension and the byte after it.
    """
    order, key = np.arange(len(start)), text.first_bytes(start, end)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(start)))
    begin, size = np.repeat(first, size), np.repeat(size, size)
    width = 1
    while len(begin) and width < size.max():
        at = np.flatnonzero(size > width)  # places, each held by one suffix
        rel, left = at - begin[at], begin[at]
        run = rel // width
        low = left + (run ^ 1) * width
        high = np.minimum(low + width, left + size[at])
        low = np.minimum(low, high)
        other, mine = low.copy(), order[at]
        right = (run & 1).astype(bool)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            me, they = mine[open_], order[mid]
            key_a, key_b = key[me], key[they]
            before = key_b < key_a  # they stand before me
            tied = np.flatnonzero(key_a == key_b)
            if len(tied):
                before[tied] = _stands_before(text, start, end, they[tied], me[tied], right[open_[tied]])
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        moved = order.copy()
        moved[left + (run & ~1) * width + rel % width + (low - other)] = mine
        order = moved
        width *= 2
    return order


def neighbours(text: Hashed, start: np.ndarray, end: np.ndarray, group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, bool]:
    """Common extension of each suffix in order with the one before (0 for the first of a group), and whether the bytes agree."""
    a, b = order[:-1], order[1:]
    most = np.where(group[a] == group[b], np.minimum(end[a] - start[a], end[b] - start[b]), 0)
    x, y = start[a], start[b]
    shared = text.common(x, y, most)
    right = True
    for i in range(0, int(shared.max(initial=0)), 8):  # what is said to be equal is equal
        rows = np.flatnonzero(shared > i)
        used = np.minimum(shared[rows] - i, 8).astype(U)
        right &= not ((text.words[x[rows] + i] ^ text.words[y[rows] + i]) & (~U(0) >> (U(64) - U(8) * used))).any()
    # then comes a smaller byte, or the end
    inner, ended = np.flatnonzero(shared < most), np.flatnonzero((shared == most) & (most > 0))
    right &= bool((text.data[x[inner] + shared[inner]] < text.data[y[inner] + shared[inner]]).all())
    right &= bool((end[a[ended]] - x[ended] <= end[b[ended]] - y[ended]).all())
    return np.concatenate([[0], shared]) if len(order) else np.zeros(0, np.int64), right


def earlier_windows(data: np.ndarray, bounds: np.ndarray, group: np.ndarray, least: np.ndarray, seed: int = SEED) -> np.ndarray:
    """For each fragment the windows, as bits, that a fragment of its group with a smaller ``least`` has too.

    ``data`` holds the fragments one after the other. A window whose hash no fragment of another ``least`` of the group has is in no other
    document. The suffixes that start the remaining windows are sorted, and windows are equal where neighbours
    share a whole one.
    """
    start = bounds[:-1]
    count = np.diff(bounds) - WINDOW + 1
    every = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    owner = np.repeat(np.arange(len(start)), count)
    for seed in range(seed, seed + TRIES):
        text = Hashed(data, seed, NARROW)
        code = text.of(every, WINDOW).astype(np.int64) + (group[owner] << 32)
        by_code = np.argsort(code)
        heads = np.flatnonzero(np.diff(code[by_code], prepend=-1))
        in_class = least[owner[by_code]]
        several = np.minimum.reduceat(in_class, heads) < np.maximum.reduceat(in_class, heads)
        kept = np.sort(by_code[np.repeat(several, np.diff(np.append(heads, len(code))))])
        window, of = every[kept], owner[kept]
        order = sorted_suffixes(text, window, window + WINDOW, group[of])
        shared, right = neighbours(text, window, window + WINDOW, group[of], order)
        if not right:
            continue
        masks = np.zeros(len(start), np.int64)
        if len(order):
            heads = np.flatnonzero(shared < WINDOW)
            smallest = np.repeat(np.minimum.reduceat(least[of[order]], heads), np.diff(np.append(heads, len(order))))
            found = order[smallest < least[of[order]]]
            np.bitwise_or.at(masks, of[found], np.int64(1) << (window[found] - start[of[found]]))
        return masks
    raise ArithmeticError(f"no hash of {TRIES} puts these suffixes in order")


# ------------------------------------------------------------------ fragments of texts


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


class Fragments:
    """Fragments of a block of texts: anchor, hash, first byte in the block, number of windows, text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.text = text = Hashed(data)
        n = len(data) - WINDOW + 1
        if n <= 0:
            self.anchor = self.hash = np.zeros(0, U)
            self.lo = self.count = self.of = np.zeros(0, np.int64)
            return
        grams = text.prefix[GRAM:] - text.prefix[:-GRAM]
        grams *= text.down[: len(data) - GRAM + 1]
        least = _sliding_min(grams, SPAN)
        begins = np.ones(n, bool)
        begins[1:] = least[1:] != least[:-1]
        start, end = bounds[:-1], bounds[1:]
        for border in (start, np.maximum(end - WINDOW + 1, start)):
            begins[border[border < n]] = True
        lo = np.flatnonzero(begins)
        count = np.diff(np.append(lo, n))
        of = np.searchsorted(bounds, lo, "right") - 1
        inside = lo + WINDOW <= end[of]
        lo, count, of = lo[inside], count[inside], of[inside]
        if len(count) and count.max() > SPAN:  # a text that repeats itself keeps an anchor for longer
            parts = -(-count // SPAN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            lo, of = np.repeat(lo, parts) + nth * SPAN, np.repeat(of, parts)
            count = np.minimum(SPAN, np.repeat(count, parts) - nth * SPAN)
        self.anchor, self.lo, self.count, self.of = least[lo], lo, count, of
        self.hash = mixed(text.of(lo, count + WINDOW - 1) + count.astype(U))

    def taken(self, which: np.ndarray) -> Fragments:
        out = object.__new__(Fragments)
        out.text = self.text
        for name in ("anchor", "hash", "lo", "count", "of"):
            setattr(out, name, getattr(self, name)[which])
        return out

    def dealt(self, hot: Bits) -> Fragments:
        """The same windows, those of hot anchors as fragments of their own."""
        is_hot = hot.has(self.anchor)
        if not is_hot.any():
            return self
        a, b = self.taken(~is_hot), self.taken(is_hot)
        out = object.__new__(Fragments)
        out.text = self.text
        lo = np.repeat(b.lo - (np.cumsum(b.count) - b.count), b.count) + np.arange(b.count.sum())
        single = {
            "anchor": np.repeat(b.anchor, b.count), "lo": lo, "count": np.ones(len(lo), np.int64), "of": np.repeat(b.of, b.count),
            "hash": mixed(self.text.of(lo, WINDOW) + U(1)),
        }
        for name, values in single.items():
            setattr(out, name, np.concatenate([getattr(a, name), values]))
        return out


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds of the texts in them, their rows, and where in its text the first byte of each stands."""
    text = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        begin, end = int(offsets[row]), int(offsets[row + 1])
        if end - begin > BLOCK_BYTES:
            for at in range(begin, end - WINDOW + 1, BLOCK_BYTES):
                piece = data[at : min(at + BLOCK_BYTES + WINDOW - 1, end)]
                yield piece, np.array([0, len(piece)]), np.array([row]), np.array([at - begin])
            row += 1
        else:
            to = max(row + 1, int(np.searchsorted(offsets, begin + BLOCK_BYTES, "right")) - 1)
            yield data[begin : int(offsets[to])], offsets[row : to + 1] - begin, np.arange(row, to), np.zeros(to - row, np.int64)
            row = to


# ------------------------------------------------------------------ bit maps of keys that occur often enough


class Bits:
    """Is a 64-bit key perhaps in the map? The top bits of a key are its place."""

    def __init__(self, data: bytes | None):
        self.data = np.frombuffer(data or b"", np.uint8)
        self.shift = U(64 - (len(self.data) * 8).bit_length() + 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.data):
            return np.zeros(len(keys), bool)
        at = keys >> self.shift
        return (self.data[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) > 0


def _by_bucket(keys: list[np.ndarray], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Codes of 32 bits behind the bucket's own bits; no key more than ``most`` times."""
    if not keys:
        return
    every = np.sort(np.concatenate(keys))
    keep = np.ones(len(every), bool)
    keep[most:] = every[most:] != every[:-most]
    every = every[keep]
    code = ((every >> U(32 - bits)) & U(0xFFFFFFFF)).astype("<u4")
    border = np.searchsorted((every >> U(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    for lo in range(0, 1 << bits, 64):
        named = [b for b in range(lo, min(lo + 64, 1 << bits)) if border[b + 1] > border[b]]
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(named, pa.int32()), "codes": pa.array([code[border[b] : border[b + 1]].tobytes() for b in named], pa.binary())}
        )


def bit_maps(coded: DataFrame, bucket_bits: int, map_bits: int, least: list[int]) -> list[bytes]:
    """One map for each of ``least``: the keys that occur at least so often, and by chance some others.

    Each bucket makes its own part of the maps, so only parts of the maps reach the driver: ``map_bits`` bits for each.
    """
    size = map_bits >> bucket_bits

    def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        every = np.sort(np.concatenate([np.frombuffer(c, "<u4") for c in rows["codes"]]))
        made = {}
        for n in least:
            later = every[n - 1 :]
            often = later[later == every[: len(later)]]
            bits = np.zeros(size, np.uint8)
            bits[(often >> np.uint32(32 - (size.bit_length() - 1))) if size > 1 else 0] = 1
            made[f"m{n}"] = [np.packbits(bits, bitorder="little").tobytes() if len(often) else None]
        return pd.DataFrame({"bucket": [key[0]], **made})

    schema = "bucket int, " + ", ".join(f"m{n} binary" for n in least)
    maps = [bytearray(map_bits // 8) for _ in least]
    for row in coded.groupBy("bucket").applyInPandas(part, schema).toLocalIterator():
        for whole, n in zip(maps, least):
            if row[f"m{n}"] is not None:
                whole[row.bucket * size // 8 : (row.bucket + 1) * size // 8] = row[f"m{n}"]
    return [bytes(m) for m in maps]


def _coded(df: DataFrame, keys, bits: int, most: int) -> DataFrame:
    """Keys that ``keys`` makes of each batch of ``df``, by bucket."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for found in keys(batch):
                held.append(found)
                if sum(map(len, held)) >= CHUNK * 4:
                    yield from _by_bucket(held, bits, most)
                    held = []
        yield from _by_bucket(held, bits, most)

    return df.mapInArrow(fill, "bucket int, codes binary")


# ------------------------------------------------------------------ the operator


def _merged(parts: list[dict[str, np.ndarray]], pieces: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Each fragment of a chunk once: its smallest and largest document and its number; with its bytes, if given."""
    if not parts:
        return
    c = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    order = np.lexsort((c["hash"], c["anchor"]))
    anchor, digest, doc = c["anchor"][order], c["hash"][order], c["doc"][order]
    heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])]))
    columns = {
        "anchor": as_i64(anchor[heads]), "hash": as_i64(digest[heads]),
        "least": np.minimum.reduceat(doc, heads), "most": np.maximum.reduceat(doc, heads), "n": np.diff(np.append(heads, len(doc))),
    }
    for lo in range(0, len(heads), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        out = {name: pa.array(values[part]) for name, values in columns.items()}
        if pieces is not None:
            out["bytes"] = pa.array([pieces[i] for i in order[heads[part]]], pa.binary())
        yield pa.RecordBatch.from_pydict(out)


FRAGMENTS = "anchor long, hash long, least long, most long, n long"


def _each_fragment(docs: DataFrame, wanted, open_: object = None, hot: object = None) -> DataFrame:
    """``FRAGMENTS`` of the windows whose anchor is in ``wanted``; with the bytes, and hot anchors dealt by window, if ``open_`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, heat = Bits(wanted.value), Bits(hot.value if hot is not None else None)
        parts, pieces, held = [], ([] if open_ is not None else None), 0
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for data, bounds, rows, _ in blocks(batch):
                found = Fragments(data, bounds)
                found = found.taken(want.has(found.anchor)).dealt(heat)
                if not len(found.lo):
                    continue
                parts.append({"anchor": found.anchor, "hash": found.hash, "doc": doc[rows[found.of]]})
                if pieces is not None:
                    raw, is_hot = data.tobytes(), heat.has(found.anchor)
                    pieces += [
                        None if h else raw[lo : lo + n + WINDOW - 1] for lo, n, h in zip(found.lo.tolist(), found.count.tolist(), is_hot.tolist())
                    ]
                held += len(found.lo)
                if held >= (CHUNK * 2 if pieces is None else CHUNK // 2):
                    yield from _merged(parts, pieces)
                    parts, pieces, held = [], (None if pieces is None else []), 0
        yield from _merged(parts, pieces)

    return docs.mapInArrow(run, FRAGMENTS + (", bytes binary" if open_ is not None else ""))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by (anchor, hash) to the ones that matter, with the windows that earlier documents have."""

    def solved(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        anchor, digest = as_u64(t["anchor"].to_numpy()), as_u64(t["hash"].to_numpy())
        heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])]))
        least = np.minimum.reduceat(t["least"].to_numpy(), heads)
        most = np.maximum.reduceat(t["most"].to_numpy(), heads)
        n = np.add.reduceat(t["n"].to_numpy(), heads)
        anchor, digest = anchor[heads], digest[heads]
        masks = np.zeros(len(heads), np.int64)
        texts = t["bytes"].take(pa.array(heads)).combine_chunks()
        open_ = np.flatnonzero(~texts.is_null().to_numpy(zero_copy_only=False))
        if len(open_):
            raw = texts.take(pa.array(open_)).to_pylist()
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
            group = np.cumsum(np.concatenate([[0], anchor[open_][1:] != anchor[open_][:-1]]))
            masks[open_] = earlier_windows(np.frombuffer(b"".join(raw), np.uint8), bounds, group, least[open_])
        keep = (most > least) | (masks != 0)
        return pa.RecordBatch.from_pydict({
            "anchor": pa.array(as_i64(anchor[keep])), "hash": pa.array(as_i64(digest[keep])), "least": pa.array(least[keep]),
            "mask": pa.array(masks[keep]), "n": pa.array(n[keep]),
        })

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            whole = pa.Table.from_batches(held).combine_chunks()
            # the last anchor may go on in the next batch; one of a single window ends with its hash
            last = whole["anchor"].to_numpy()
            same = last == last[-1]
            if not whole["bytes"][-1].is_valid:
                same &= whole["hash"].to_numpy() == whole["hash"][-1].as_py()
            cut = len(same) - int(same[::-1].cumprod().sum())
            if cut:
                yield solved(whole.slice(0, cut).to_batches())
                held = whole.slice(cut).to_batches()
                rows = whole.num_rows - cut
    if rows:
        yield solved(held)


def _found(docs: DataFrame, wanted, hot, known) -> DataFrame:
    """``doc, same, anchor, hash, lo, count`` of the fragments in texts that may matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, heat, may = Bits(wanted.value), Bits(hot.value), Bits(known.value)
        for batch in batches:
            doc, same = batch.column("doc").to_numpy(), batch.column("same").to_numpy()
            for data, bounds, rows, base in blocks(batch):
                found = Fragments(data, bounds)
                found = found.taken(want.has(found.anchor)).dealt(heat)
                found = found.taken(may.has(found.hash))
                if len(found.lo):
                    row = rows[found.of]
                    yield pa.RecordBatch.from_pydict({
                        "doc": pa.array(doc[row]), "same": pa.array(same[row]), "anchor": pa.array(as_i64(found.anchor)), "hash": pa.array(as_i64(found.hash)),
                        "lo": pa.array(found.lo - bounds[found.of] + base[found.of]), "count": pa.array(found.count.astype(np.int32)),
                    })

    return docs.mapInArrow(run, "doc long, same long, anchor long, hash long, lo long, count int")


KEPT = T.StructType([
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept", T.BinaryType()),
])
KEPT_ARROW = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


@F.arrow_udf(KEPT)
def _cut_out(text: pa.Array, lo: pa.Array, mask: pa.Array) -> pa.Array:
    """Removed runs, and what is left of the text without the windows that start at ``lo`` plus the bits of ``mask``."""
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    lengths = lo.value_lengths().to_numpy()
    border = np.concatenate([[0], np.cumsum(lengths)])
    starts, bits = lo.flatten().to_numpy(), mask.flatten().to_numpy()
    parts, row = [], 0
    while row < len(text):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        own = slice(int(border[row]), int(border[to]))
        parts.append(_runs_and_rest(whole[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], lengths[row:to], starts[own], bits[own]))
        row = to
    return pa.concat_arrays(parts) if parts else pa.array([], KEPT_ARROW)


def _runs_and_rest(data: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> pa.Array:
    """Spans and kept bytes of the texts of a block; a text has ``lengths`` of the starts and bits. An unused place stands behind each text."""
    n = len(bounds) - 1
    at = bounds[:-1] + np.arange(n)
    which, bit = np.nonzero((bits[:, None] >> np.arange(SPAN)) & 1)
    windows = (starts + np.repeat(at, lengths))[which] + bit
    size = len(data) + n
    change = np.bincount(windows, minlength=size) - np.bincount(windows + WINDOW, minlength=size)
    gone = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    first, last = edges[::2], edges[1::2]
    of = np.searchsorted(at, first, "right") - 1
    span = pa.StructArray.from_arrays([pa.array(first - at[of]), pa.array(last - at[of])], ["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), span)
    stays = ~np.delete(gone, bounds[1:] + np.arange(n))
    ends = np.concatenate([[0], np.cumsum(stays)])[bounds].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[stays].tobytes())])
    return pa.StructArray.from_arrays([spans, kept], ["spans", "kept"])


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans, kept``.

    Texts are UTF-8 bytes. ``spans`` are the maximal runs (start, end) of bytes covered by a string of 50 bytes that also
    starts in a document of a smaller id, judged on the whole input; ``kept`` is the rest as bytes, since a
    run may end within a character. A null text counts as empty; texts under 50 bytes are kept whole. Null ids come after
    all others. Rows of one id never remove bytes of each other; repeated rows give equal results. An empty table gives an empty result; other
    columns are not read.

    Fragments with their smallest document are merged in each task before they shuffle, and found again in the texts by
    a join that spreads those of many texts.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text")).withColumn(
        "doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    )
    # rows that share an id are told apart by their text
    repeated = not base.groupBy("doc").count().where("count > 1").isEmpty()
    base = base.withColumn("same", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    texts = base.select("doc", "same", "text")
    size = texts.select(F.sum(F.octet_length("text"))).head()[0] or 0
    bucket_bits = (max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)) - 1).bit_length()
    map_bits = min(1 << max((size // 8).bit_length(), bucket_bits + 3), MAX_BITS)
    share = lambda maps: [spark.sparkContext.broadcast(m) for m in maps]

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for data, bounds, _, _ in blocks(batch):
            yield Fragments(data, bounds).anchor

    column = lambda name: lambda batch: [as_u64(batch.column(name).to_numpy())]
    [again] = share(bit_maps(_coded(texts, anchors, bucket_bits, 2), bucket_bits, map_bits, [2]))
    every = stored(
        _each_fragment(texts, again).groupBy("anchor", "hash").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")),
        "fragments",
    )
    open_, hot = share(bit_maps(_coded(every.select("anchor"), column("anchor"), bucket_bits, HOT), bucket_bits, map_bits, [2, HOT]))
    # a hot anchor's windows are dealt out one by one
    rows = _each_fragment(texts, open_, open_, hot)
    placed = rows.repartition("anchor", F.when(F.col("bytes").isNull(), F.col("hash"))).sortWithinPartitions("anchor", "hash")
    compared = stored(placed.mapInArrow(_resolve, "anchor long, hash long, least long, mask long, n long"), "compared")

    @F.arrow_udf(T.BooleanType())
    def closed(anchor: pa.Array) -> pa.Array:
        return pa.array(~Bits(open_.value).has(as_u64(anchor.to_numpy())))

    def closed_hashes(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [as_u64(batch.column("hash").to_numpy())[~Bits(open_.value).has(as_u64(batch.column("anchor").to_numpy()))]]

    shared = every.where("most > least")
    # asked within one function: a second one in the same task would be a second worker with its own memory
    coded = _coded(shared.select("anchor", "hash"), closed_hashes, bucket_bits, 1).union(_coded(compared.select("hash"), column("hash"), bucket_bits, 1))
    [known] = share(bit_maps(coded, bucket_bits, map_bits, [1]))
    alone = shared.where(closed("anchor")).select("anchor", "hash", "least", F.lit(0).cast("long").alias("mask"), "n")
    matter = alone.unionByName(compared).select(F.struct("anchor", "hash").alias("fragment"), F.struct("least", "mask").alias("found"), "n")
    places = _found(texts, again, hot, known).withColumn("fragment", F.struct("anchor", "hash")).drop("anchor", "hash")
    joined = lookup_join(places, matter, "fragment", "found", F.col("n"), F.struct("doc", "lo"))
    whole = F.expr("shiftleft(1L, count) - 1")
    gone = joined.select(
        "doc", "same", "lo",
        F.when(F.col("doc") > F.col("found.least"), whole).when(F.col("doc") == F.col("found.least"), F.col("found.mask")).alias("mask"),
    ).where("mask != 0")
    lists = stored(gone.groupBy("doc", "same").agg(F.collect_list(F.struct("lo", "mask")).alias("windows")), "windows")
    return _without_windows(base, lists, bucket_bits, map_bits)


def _without_windows(base: DataFrame, lists: DataFrame, bucket_bits: int, map_bits: int) -> DataFrame:
    """Rows with removed windows meet them by a join; the texts of other rows don't shuffle."""
    column = lambda batch: [as_u64(batch.column("key").to_numpy())]
    coded = _coded(lists.select(F.xxhash64("doc", "same").alias("key")), column, bucket_bits, 1)
    some = base.sparkSession.sparkContext.broadcast(bit_maps(coded, bucket_bits, map_bits, [1])[0])

    @F.arrow_udf(T.BooleanType())
    def concerned(key: pa.Array) -> pa.Array:
        return pa.array(Bits(some.value).has(as_u64(key.to_numpy())))

    marked = base.withColumn("concerned", concerned(F.xxhash64("doc", "same")))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    whole = [F.array().cast(KEPT["spans"].dataType).alias("spans"), F.col("text").alias("kept")]
    joined = marked.where("concerned").join(lists, ["doc", "same"], "left")
    cut = joined.where("windows IS NOT NULL").select("doc_id", "text", _cut_out("text", F.col("windows.lo"), F.col("windows.mask")).alias("cut"))
    return (
        cut.select("doc_id", n_bytes, "cut.spans", "cut.kept")
        .union(joined.where("windows IS NULL").select("doc_id", n_bytes, *whole))
        .union(marked.where("NOT concerned").select("doc_id", n_bytes, *whole))
    )


@answer(
    r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t, strlen(coalesce(text, '')) AS n FROM documents),
o AS (SELECT doc_id, o, substring(t, 2 * o + 1, 498) AS t FROM (SELECT doc_id, unnest(range(0, n - 49, 200)) AS o, t FROM d WHERE n >= 50)),
w AS (SELECT doc_id, o + i AS p, substring(t, 2 * i + 1, 100) AS s FROM (SELECT doc_id, o, unnest(range(len(t) // 2 - 49)) AS i, t FROM o)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, p, first FROM w JOIN f USING (s)),
r AS (SELECT doc_id, p, p > 49 + coalesce(max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -99) + 1 AS fresh FROM x WHERE first < doc_id),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (
  SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r) GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM s
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
j AS (SELECT doc_id, string_agg(t[2 * lo + 1:2 * hi], '' ORDER BY lo) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN j USING (doc_id) LEFT JOIN c USING (doc_id)"""
)
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to documents of smaller ids; nulls and ties as in ``remove_repeated_passages``."""
    made = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
