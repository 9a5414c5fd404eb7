"""Which terms set a source apart from the other sources of its language?

The terms that enough documents of a language hold are found by iceberg prefix refinement. Level by
level the byte prefixes of terms get longer; a prefix that too few documents hold can't begin a frequent term, so
no longer prefix of it is counted. A prefix that ends with the term's end mark is a complete term and final.
What passes a level is known to the next as a bit map of bounded size: a fuller map lets more prefixes be counted, and
exact counts decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import answer, stored, table, text_of

#: The mark behind a complete term: a byte that is in no term.
END = b"\0"
#: Bytes outside of terms become end marks, A-Z lower case; all other letters are bytes of 0x80 and above.
FOLDED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256))
FIRST_LEVEL, LEVEL_FACTOR = 4, 3
#: A bit map of prefixes takes at most so many bits (16 MB).
MAX_BITS = 1 << 27
BITS_PER_KEY, PROBES = 16, 3
#: Counts that a task brings together before it hands them on, and their bytes.
MOST_ENTRIES, MOST_BYTES = 800_000, 1 << 27
#: Bytes of text of one language that are cut into terms at a time.
SLICE = 1 << 23
#: Sources that are compared in one block, and terms in it.
BLOCK_SOURCES, BLOCK_TERMS = 64, 8192
SEED = 42


def pieces(text: bytes) -> Iterator[bytes]:
    """A UTF-8 text, folded, in pieces of bounded size that are cut between terms."""
    folded, start = text.translate(FOLDED), 0
    while len(folded) - start > SLICE:
        to = folded.find(END, start + SLICE)
        if to < 0:
            break
        yield folded[start:to]
        start = to
    yield folded[start:]


def marked_terms(folded: list[bytes], least: int = 0) -> tuple[np.ndarray, pa.Array]:
    """The terms of at least ``least`` bytes of folded texts in order, with repeats: the number of each one's text, and the terms with end marks."""
    joined = np.frombuffer(END.join(folded) + END, np.uint8)
    inside = joined != 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    first, mark = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(np.cumsum([len(f) + 1 for f in folded]), first, "right")
    inside[mark] = True
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(mark - first + 1, out=offsets[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])
    if least:
        long = mark - first >= least
        return of[long], terms.filter(pa.array(long))
    return of, terms


# ------------------------------------------------------------------ bit maps of prefixes


class Passing:
    """Is a prefix of a language perhaps in the map? Everything is, where there is no map."""

    def __init__(self, bits: bytes | None):
        self.bits = bits
        self.last = len(bits or b"") * 8 - 1

    def __call__(self, lang_seed: int, prefix: bytes) -> bool:
        if self.bits is None:
            return True
        h = xxhash.xxh64_intdigest(prefix, lang_seed)
        at, step = h & 0xFFFFFFFF, h >> 32
        for _ in range(PROBES):
            place = at & self.last
            if not self.bits[place >> 3] >> (place & 7) & 1:
                return False
            at += step
        return True


def bit_map(prefixes: DataFrame) -> bytes:
    """A Bloom filter of ``lang, prefix``: at most ``MAX_BITS`` bits, merged by a group of 64 bits."""
    wanted = max(prefixes.count() * BITS_PER_KEY, 1 << 10)
    bits = min(1 << (wanted - 1).bit_length(), MAX_BITS)
    h = prefixes.select(F.xxhash64("lang", "prefix").alias("h"))
    low, high = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32)
    at = h.select(F.explode(F.array(*[(low + high * i).bitwiseAND(bits - 1) for i in range(PROBES)])).alias("at"))
    words = (
        at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, int(at & 63))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    whole = np.zeros(bits // 64, "<i8")
    whole[words["word"].to_numpy()] = words["bits"].to_numpy()
    return whole.tobytes()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], list[bytes]]]:
    """Language, sources and texts (UTF-8) of rows of one language, of bounded size unless one text is larger."""
    waiting: dict[str, tuple[list[str], list[bytes]]] = {}
    size: Counter = Counter()
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        texts = batch.column("text").cast(pa.large_binary())
        for i, lang in enumerate(langs):
            text = texts[i].as_py()
            if size[lang] and size[lang] + len(text) > SLICE:
                yield lang, *waiting.pop(lang)
                del size[lang]
            of, held = waiting.setdefault(lang, ([], []))
            of.append(sources[i])
            held.append(text)
            size[lang] += len(text) + 1
        # many languages share the room of four
        if size.total() > 4 * SLICE:
            for lang, rows in waiting.items():
                yield lang, *rows
            waiting, size = {}, Counter()
    for lang, rows in waiting.items():
        yield lang, *rows


def _handed_on(counts: Iterator[pa.Table], names: list[str], n: str) -> Iterator[pa.RecordBatch]:
    """Sums of counts by names, as far as a task brings them together."""

    def sums() -> pa.Table:
        return pa.concat_tables(parts).group_by(names, use_threads=False).aggregate([(n, "sum")]).select([*names, f"{n}_sum"]).rename_columns([*names, n])

    parts: list[pa.Table] = []
    for table_ in counts:
        parts.append(table_)
        if sum(p.num_rows for p in parts) > MOST_ENTRIES or sum(p.nbytes for p in parts) > MOST_BYTES:
            parts = [sums()]
            if parts[0].num_rows > MOST_ENTRIES // 2 or parts[0].nbytes > MOST_BYTES // 2:
                yield from parts.pop().to_batches(1 << 16)
    if parts:
        yield from sums().to_batches(1 << 16)


# ------------------------------------------------------------------ levels


def _held(texts: list[bytes], level: int, before: int) -> tuple[pa.Array, np.ndarray]:
    """Prefixes of terms of at least ``before`` bytes, and in how many of the texts each is."""
    # a text in pieces holds a prefix once, however many of its pieces hold it
    several = [list(pieces(t)) for t in texts]
    whole = [p[0] for p in several if len(p) == 1]
    of, terms = marked_terms(whole, before)
    prefixes = [pc.binary_slice(terms, 0, level)]
    for cut in several:
        if len(cut) > 1:
            once = pc.unique(pa.chunked_array([pc.unique(pc.binary_slice(marked_terms([p], before)[1], 0, level)) for p in cut]))
            of = np.concatenate([of, np.full(len(once), (of[-1] if len(of) else -1) + 1)])
            prefixes.append(once)
    coded = pa.concat_arrays(prefixes).dictionary_encode()
    held = pd.unique(of.astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy())
    return coded.dictionary, np.bincount(held % max(1, len(coded.dictionary)), minlength=len(coded.dictionary))


def _documents_by_prefix(rows: DataFrame, level: int, before: int, passed: bytes | None) -> DataFrame:
    """``lang, prefix, docs``: documents that hold a term of that prefix, where the shorter prefix of the last level has passed."""
    shared = rows.sparkSession.sparkContext.broadcast(passed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = Passing(shared.value)

        def counted() -> Iterator[pa.Table]:
            for lang, _, texts in slices(batches):
                # a term that ended within the last level is final; the others are asked for
                prefixes, docs = _held(texts, level, before)
                if before:
                    seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
                    shorter = pc.binary_slice(prefixes, 0, before).dictionary_encode()
                    asked = np.array([passing(seed, p) for p in shorter.dictionary.to_pylist()], bool)[shorter.indices.to_numpy()]
                    prefixes, docs = prefixes.filter(pa.array(asked)), docs[asked]
                yield pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(docs)), "prefix": prefixes, "docs": pa.array(docs, pa.int64())})

        yield from _handed_on(counted(), ["lang", "prefix"], "docs")

    return rows.mapInArrow(count, "lang string, prefix binary, docs long")


def frequent_terms(rows: DataFrame, least_docs: int) -> DataFrame:
    """``lang, prefix``: all terms that at least ``least_docs`` documents (rows) of the language hold, as bytes with end mark.

    Each level is one pass over the texts; levels go on until no prefix that passes is incomplete.
    """
    complete, passed, before, level = [], None, 0, FIRST_LEVEL
    while True:
        survivors = stored(
            _documents_by_prefix(rows, level, before, passed)
            .groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs),
            f"level{level}",
        )
        ended = F.endswith("prefix", F.lit(END))
        complete.append(survivors.where(ended).select("lang", "prefix"))
        longer = survivors.where(~ended).select("lang", "prefix")
        if longer.isEmpty():
            return stored(reduce(DataFrame.union, complete), "terms")
        passed, before, level = bit_map(longer), level, level * LEVEL_FACTOR


def occurrences(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, prefix, n``: how often each of the terms (with end mark) occurs in each group of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_map(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = Passing(shared.value)

        def counted() -> Iterator[pa.Table]:
            for lang, sources, texts in slices(batches):
                seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
                of_text, names = pd.factorize(np.array(sources, object))
                # a long text stands alone; its pieces are counted one after the other
                cut = [list(pieces(t)) for t in texts]
                for part in range(max(map(len, cut))):
                    there = np.array([part < len(c) for c in cut])
                    of, terms = marked_terms([c[part] for c in cut if part < len(c)])
                    coded = terms.dictionary_encode()
                    asked = np.array([passing(seed, t) for t in coded.dictionary.to_pylist()], bool)
                    code = coded.indices.to_numpy()
                    kept = asked[code]
                    cells, n = np.unique(of_text[there][of[kept]] * max(1, len(asked)) + code[kept], return_counts=True)
                    source, code = np.divmod(cells, max(1, len(asked)))
                    yield pa.table({
                        "lang": pa.repeat(pa.scalar(lang, pa.string()), len(n)), "source": pa.array(names[source], pa.string()),
                        "prefix": coded.dictionary.take(pa.array(code)), "n": pa.array(n, pa.int64()),
                    })

        yield from _handed_on(counted(), ["lang", "source", "prefix"], "n")

    counted = rows.mapInArrow(count, "lang string, source string, prefix binary, n long")
    # what the map let through by chance goes here
    return counted.groupBy("lang", "source", "prefix").agg(F.sum("n").alias("n")).join(terms, ["lang", "prefix"], "left_semi")


# ------------------------------------------------------------------ shares and differences


def share(n: Column, total: Column, kept: Column, scale: int, prior: int) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * kept)) in exact arithmetic; 0 where no term is kept."""
    above = F.lit(scale).cast("decimal(18,0)") * (n + F.lit(prior)).cast("decimal(20,0)")
    below = (total + F.lit(prior) * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", above, below)).otherwise(F.lit(0)).cast("long")


def _differences(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the sum of absolute differences of two sources' shares over all kept terms.

    Sources are compared in blocks, over shards of terms, so a task has at most two blocks of sources by one shard
    of terms, in numpy. Terms that neither block holds differ by what the sources' shares of absent terms differ by; they are only counted.
    """
    nth = Window.partitionBy("lang").orderBy("source")
    of_lang = Window.partitionBy("lang")
    placed = groups.withColumn("nth", F.row_number().over(nth) - 1).withColumn("blocks", F.ceil(F.count("*").over(of_lang) / BLOCK_SOURCES).cast("int"))
    block = F.expr(f"int(nth div {BLOCK_SOURCES})")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pair = lambda df: (
        df.withColumn("_other", other).withColumn("a", F.least(block, "_other")).withColumn("b", F.greatest(block, "_other"))
    )
    shard = F.pmod(F.xxhash64("prefix"), F.expr(f"kept div {BLOCK_TERMS} + 1")).cast("int")
    sources = placed.select("lang", "source", "nth", "absent", "blocks")
    held = pair(
        cells.join(sources, ["lang", "source"]).withColumn("shard", shard)
    ).select("lang", "a", "b", "shard", "nth", "absent", "prefix", "p")
    # each source stands in each shard, even without a term of it
    standing = pair(placed.withColumn("shard", F.explode(F.expr(f"sequence(0, int(kept div {BLOCK_TERMS}))")))).select(
        "lang", "a", "b", "shard", "nth", "absent", F.lit(None).cast("binary").alias("prefix"), F.col("absent").alias("p")
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nth, of = np.unique(rows["nth"].to_numpy(), return_inverse=True)
        absent = np.zeros(len(nth), np.int64)
        absent[of] = rows["absent"].to_numpy()
        code, found = pd.factorize(rows["prefix"])
        p = np.tile(absent, (len(found), 1))
        there = code >= 0
        p[code[there], of[there]] = rows["p"].to_numpy()[there]
        value = np.stack([np.abs(p - p[:, [i]]).sum(axis=0) for i in range(len(nth))])
        blocks = nth // BLOCK_SOURCES
        # a block meets itself in one pair of blocks and every other block in another
        wanted = (blocks[:, None] != blocks[None, :]) if key[1] != key[2] else ~np.eye(len(nth), dtype=bool)
        x, y = np.nonzero(wanted)
        return pd.DataFrame({"lang": key[0], "x": nth[x], "y": nth[y], "value": value[x, y], "held": len(found)})

    parts = held.unionByName(standing).groupBy("lang", "a", "b", "shard").applyInPandas(compare, "lang string, x int, y int, value long, held long")
    sums = parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))
    named = lambda end, name: placed.select("lang", F.col("nth").alias(end), F.col("source").alias(name), F.col("absent").alias(f"absent_{end}"))
    kept = groups.select("lang", "kept").distinct()
    return sums.join(named("x", "source"), ["lang", "x"]).join(named("y", "item"), ["lang", "y"]).join(kept, "lang").select(
        "lang", "source", "item", (F.col("value") + (F.col("kept") - F.col("held")) * F.abs(F.col("absent_x") - F.col("absent_y"))).alias("value")
    )


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = 30,
    top: int = 50,
    scale: int = 1_000_000_000,
    prior: int = 5,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each language and source that occurs.

    Terms are runs of letters: A-Z in lower case, and every character beyond ASCII. Part ``pair`` has a row for each
    other source of the language: the sum over all kept terms of the absolute difference of both sources' shares.
    Part ``term`` has the ``top`` terms of the source whose share is above that of the language, and the difference. Ranks
    start at 1 by value, ties by the bytes of the item. Shares are smoothed by ``prior`` and whole numbers of ``1 / scale``.

    Null texts, languages and sources count as empty ones; empty texts make their group occur. A repeated
    row counts again. A language without kept terms has pairs of value 0, one of a single source no pairs, an empty table an empty result.
    Other columns are not read.
    """
    rows = docs.select(text_of(text_col).alias("text"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"))
    terms = frequent_terms(rows, least_docs)
    cells = stored(occurrences(rows, terms), "cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        rows.select("lang", "source").distinct()
        .join(sizes, ["lang", "source"], "left")
        .join(terms.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
        .na.fill(0, ["total", "kept"])
    )
    groups = stored(groups.withColumn("absent", share(F.lit(0), F.col("total"), F.col("kept"), scale, prior)), "groups")
    shares = cells.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"]).withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("kept"), scale, prior)
    )
    in_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    whole = cells.groupBy("lang", "prefix").agg(F.sum("n").alias("lang_n")).join(in_lang, "lang")
    distinctive = (
        shares.join(whole, ["lang", "prefix"])
        .withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), scale, prior))
        .where("value > 0")
        .select("lang", "source", F.expr("cast(substring(prefix, 1, length(prefix) - 1) as string)").alias("item"), "value")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(by_value))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = ranked(_differences(shares.select("lang", "source", "prefix", "p", "kept"), groups), "pair")
    return pairs.select(*columns).union(ranked(distinctive, "term").where(F.col("rank") <= top).select(*columns))


@answer(
    r"""WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT lang, source, term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) AS n, v
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS p FROM dense),
whole AS (SELECT lang, term, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS q FROM whole JOIN v USING (lang)),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(f, 0) AS value
  FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS t, sum(abs(a.p - b.p)) AS f
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x
  ON x.lang = g.lang AND x.s = g.source AND x.t = h.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= 50)"""
)
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the sources of each language of the documents; nulls and ties as in ``source_divergence``."""
    return source_divergence(table(spark, sf_dir, "documents"))
