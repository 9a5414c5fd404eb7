"""Fill-in-the-middle: texts are cut at unit borders and the middle is moved to the end.

Both cuts are found with a wavelet matrix over character classes. Each code point gets a symbol of
two bits, whether the character before it and whether it itself is not white. A unit ends where white
space follows a word, so the borders before a place are the rank of that one symbol, and the j-th
border is found by bisection on ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import answer, table, text_of

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text that share a wavelet matrix; a longer text has its own.
BLOCK_BYTES = 4 << 20
#: The symbol of white space after a word.
BORDER = 0b10


class Bits:
    """A bit array with rank: words of 64 bits and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The number of ones in front of each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Symbols of a few bits; each level holds one bit of all symbols, sorted stably by the bits above it."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels = []
        for shift in range(width - 1, -1, -1):
            bit = (symbols >> shift) & 1
            self.levels.append((shift, Bits(bit)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs in front of each place."""
        first = np.zeros(1, np.int64)
        for shift, bits in self.levels:
            if symbol >> shift & 1:
                first, at = bits.zeros + bits.ones(first), bits.zeros + bits.ones(at)
            else:
                first, at = first - bits.ones(first), at - bits.ones(at)
        return at - first

    def select(self, symbol: int, nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the nth occurrence (from 1, of the whole array), known to lie in [low, high)."""
        low, high = low.copy(), high.copy()
        while len(low) and (high - low).max() > 1:
            mid = (low + high) >> 1
            there = self.rank(symbol, mid) >= nth
            high = np.where(there, mid, high)
            low = np.where(there, low, mid)
        return low


def symbols_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One symbol per code point of UTF-8 code units; ``starts`` are the first code points of texts.

    White space is ASCII, so the first byte of a code point tells its class. Before a text stands white space.
    """
    word = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[starts[starts < len(word)]] = False
    return (before.view(np.uint8) << 1) | word.view(np.uint8)


def cuts_of(data: np.ndarray, offsets: np.ndarray, draw1: np.ndarray, draw2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text and its two cuts in code points, after the smaller and the larger of the draws modulo units + 1."""
    first = (data & 0xC0) != 0x80
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=points[1:])
    bounds = points[offsets - offsets[0]]
    start, end = bounds[:-1], bounds[1:]
    matrix = WaveletMatrix(symbols_of(data[first], start), 2)
    ranks = matrix.rank(BORDER, bounds)
    n = ranks[1:] - ranks[:-1] + (end > start)
    found = []
    for units in np.sort(np.stack([draw1 % (n + 1), draw2 % (n + 1)]), axis=0):
        cut = np.where(units == 0, start, end)
        inner = np.flatnonzero((units > 0) & (units < n))
        cut[inner] = matrix.select(BORDER, ranks[:-1][inner] + units[inner], start[inner], end[inner])
        found.append(cut - start)
    return n, found[0], found[1]


CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")])


@F.arrow_udf(CUTS)
def cuts(text: pa.Array, draw1: pa.Array, draw2: pa.Array) -> pa.Array:
    """Cuts of the texts of a batch, one wavelet matrix for each block of texts."""
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    one, two = (d.to_numpy(zero_copy_only=False).astype(np.int64) for d in (draw1, draw2))
    parts, row = [], 0
    while row < len(text):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        parts.append(cuts_of(data[offsets[row] : offsets[to]], offsets[row : to + 1], one[row:to], two[row:to]))
        row = to
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged, from the output and its form alone.

    No text with a sentinel is rearranged, and a sentinel can't arise where two parts meet.
    """
    after = lambda s: F.substring_index(output, s, -1)
    inside = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    prefix, suffix, middle = SENTINELS
    return (
        F.when(form == "psm", F.concat(inside(prefix, suffix), after(middle), inside(suffix, middle)))
        .when(form == "spm", F.concat(inside(prefix, middle), after(middle), inside(suffix, prefix)))
        .otherwise(output)
    )


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80
) -> DataFrame:
    """All rows of ``docs`` as ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A unit is a word with the white space in front of it, or white space at the end of the text; ``n`` counts
    them. The draws come from the SHA-256 of seed and id, so they depend on neither rows nor partitions. ``percent`` of
    the texts are rearranged, ``spm_percent`` of these with the suffix first. ``form`` is plain, psm or spm; lengths are
    in code points and null for plain texts. A null text counts as empty; empty texts and those that hold a sentinel
    stay plain. A null id draws as an empty one; repeated rows give repeated results. An empty table
    gives an empty result; other columns are not read. Rows are independent: nothing shuffles.
    """
    group = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")
    drawn = docs.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("h"),
    )
    sentinel = F.lit(False)
    for s in SENTINELS:
        sentinel = sentinel | F.contains("text", F.lit(s))
    placed = drawn.select(
        "doc_id", "text", cuts("text", group(0), group(1)).alias("cut"),
        F.when((F.col("text") == "") | sentinel | (group(2) % 100 >= percent), "plain")
        .when(group(3) % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
    )
    moved = F.col("form") != "plain"
    prefix = F.expr("substring(text, 1, int(cut.first))")
    middle = F.expr("substring(text, int(cut.first) + 1, int(cut.second - cut.first))")
    suffix = F.expr("substring(text, int(cut.second) + 1)")
    p, s, m = map(F.lit, SENTINELS)
    return placed.select(
        "doc_id", F.col("cut.n").alias("n"), "form",
        F.when(moved, F.col("cut.first")).alias("prefix_chars"),
        F.when(moved, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col("text")).alias("output"),
    )


@answer(
    r"""WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS p,
    array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every rearranged document and of the text restored from it; nulls as in ``fill_in_middle``."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
