"""Near-duplicates by SimHash fingerprints in sharded BK-trees.

A BK-tree keeps each node's children by their whole Hamming distance to it; a search follows only
edges whose distance is within the radius of its own distance to the node. Trees are built per
shard inside tasks: all fingerprints never meet in one place. A shard with many fingerprints is
cut into blocks of bounded size, and the tree of each block is sent to every block of its shard. A
task links only what its own links have not joined yet, so a group of m copies gives m - 1 links.

Two ways to shard, both in front of the same trees:

* by bits, exact for a small radius: of ``blocks`` parts of the bits at most ``radius`` can differ,
  so two fingerprints within the radius agree on some ``blocks - radius`` parts;
* by anchors, for a given Jaccard similarity: two texts share the smallest of their shingle hashes
  under a random order with a probability equal to their similarity, so with 6 orders and a
  similarity of 0.8 or more they share none once in 15,000 pairs. All texts that share an anchor are
  compared: near fingerprints first, by the trees, then the rest. Links are verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import bloom
from ..plans.skew import lookup_join
from .common import answer, stored, table, unused, without, words_of
from .components import components

SEED = 42
#: Hash rows that are turned into bits at once: bounds memory for very long texts.
CHUNK = 1 << 16
#: Places of the map that bounds what two sets of shingles can have in common.
PLACES = 1 << 20


# ------------------------------------------------------------------ fingerprints


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero if there are none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row; a null or empty text has fingerprint zero."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = [signed(fingerprint(shingle_hashes(words_of(t), size))) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array(fps, np.int64)})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(compute, "doc_id long, fp long")


# ------------------------------------------------------------------ trees


class BKTree:
    """Fingerprints with children keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while new:
            distance = (value ^ self.values[node]).bit_count()
            child = self.children[node].setdefault(distance, new)
            if child == new:
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes within the radius, in the order they are met."""
        values, children = self.values, self.children
        waiting = [0] if values else []
        while waiting:
            node = waiting.pop()
            distance = (value ^ values[node]).bit_count()
            if distance <= radius:
                yield node
            for edge, child in children[node].items():
                if -radius <= edge - distance <= radius:
                    waiting.append(child)


def shard_links(
    members: list[tuple[int, int, int]], radius: int, accept: Callable[[int, int], bool] | None = None
) -> list[tuple[int, int]]:
    """Links that join the members ``(id, fp, block)`` of one or two blocks of a shard.

    With two blocks only links from one to the other are looked for: each block is also met alone.
    """
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    blocks = {m[2] for m in members}
    first = min(blocks)
    crossing, tree, at, links = len(blocks) > 1, BKTree(), [], []
    mask = (1 << 64) - 1
    for i in sorted(range(len(members)), key=lambda i: (members[i][2], members[i][0])):
        key, fp, block = members[i]
        if not crossing or block != first:
            for near in tree.within(fp & mask, radius):
                j = at[near]
                a, b = root(i), root(j)
                if a != b and (accept is None or accept(i, j)):
                    parent[a] = b
                    links.append((key, members[j][0]))
        if not crossing or block == first:
            tree.add(fp & mask)
            at.append(i)
    return links


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def similar_links(members: list[tuple[int, int, int]], sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join the members whose sets are similar, whatever their fingerprints.

    Near fingerprints are linked first. Members that are still apart are then compared by what their
    sets can have in common at the most, and verified only where that would do.
    """
    sizes = np.array([len(s) for s in sets])

    # both ways round, a set that is too small or too large cannot be similar enough
    def fits(i: int, j: int | np.ndarray):
        return similarity * np.maximum(sizes[i], sizes[j]) <= np.minimum(sizes[i], sizes[j])

    links = shard_links(members, radius, lambda i, j: fits(i, j) and jaccard(sets[i], sets[j]) >= similarity)
    number = {m[0]: i for i, m in enumerate(members)}
    group = np.arange(len(members))
    for a, b in links:
        group[group == group[number[a]]] = group[number[b]]
    block = np.array([m[2] for m in members])
    crossing = len(set(block.tolist())) > 1
    mark = np.zeros(PLACES, bool)
    for i in range(1, len(members)):
        others = np.flatnonzero((group[:i] != group[i]) & fits(i, np.arange(i)) & ((block[:i] != block[i]) | (not crossing)))
        if not len(others):
            continue
        own = sets[i] & np.uint32(PLACES - 1)
        mark[own] = True
        while len(others):
            part, others = others[:64], others[64:]
            starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
            flat = mark[np.concatenate([sets[j] for j in part]) & np.uint32(PLACES - 1)]
            common = np.add.reduceat(flat, starts, dtype=np.int64) if len(flat) else sizes[part]
            for j in part[common >= similarity * (sizes[i] + sizes[part] - common)].tolist():
                if group[i] != group[j] and jaccard(sets[i], sets[j]) >= similarity:
                    links.append((members[i][0], members[j][0]))
                    group[group == group[i]] = group[j]
            others = others[group[others] != group[i]]
        mark[own] = False
    return links


def tree_links(entries: DataFrame, keys: list[str], radius: int, block: int, similarity: float | None = None) -> DataFrame:
    """``a, b``: links between ids that connect, within each shard, all that are within the radius.

    With a ``similarity`` they connect all whose sets are that similar, whatever their fingerprints.
    ``entries`` has the shard's ``keys``, ``id``, ``fp``, and then ``shingles`` (sorted distinct 32-bit
    hashes). Shards of one entry are dropped by their count.
    Larger ones are dealt into blocks of about ``block`` entries; each pair of blocks is one group.
    """
    whole = entries.withColumn("_shard", F.struct(*keys)).drop(*keys)
    sizes = whole.groupBy("_shard").agg(F.count("*").alias("_size")).where("_size > 1")
    blocks = F.ceil(F.col("_size") / block).cast("int")
    # a shard of many entries is never brought together, not even to learn its size
    placed = (
        lookup_join(whole, sizes, "_shard", "_size", F.col("_size"), F.col("id"))
        .withColumn("_blocks", blocks)
        .withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_lo", F.least("_own", "_other"))
        .withColumn("_hi", F.greatest("_own", "_other"))
    )
    carried = ["id", "fp", F.col("_own").alias("block"), *(["shingles"] if similarity is not None else [])]
    groups = placed.groupBy("_shard", "_lo", "_hi").agg(F.collect_list(F.struct(*carried)).alias("members")).where(F.size("members") > 1)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for members in batch["members"]:
                plain = [(m["id"], m["fp"], m["block"]) for m in members]
                if similarity is None:
                    found += shard_links(plain, radius)
                    continue
                sets = [np.frombuffer(m["shingles"], "<u4") for m in members]
                found += similar_links(plain, sets, radius, similarity)
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return groups.select("members").mapInPandas(link, "a long, b long")


def bit_shards(fp: Column, radius: int, blocks: int) -> Column:
    """An array of (part, bits): one for each choice of the parts that must agree."""
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [(1 << bounds[i + 1]) - (1 << bounds[i]) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    return F.array(*[F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(chosen)])


def fingerprint_groups(fps: DataFrame, radius: int = 2, blocks: int = 4, block: int = 2048) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``doc_id, fp``.

    Fingerprints link at ``radius`` or fewer differing bits; a component's id is the smallest
    ``doc_id`` reachable. Exact for any data, as long as ``blocks`` is larger than ``radius``.
    Rows that repeat an id are one document: their components are joined. A row without id links
    nothing and gets a null component, unless documents with an id have its very fingerprint.
    """
    fps = stored(fps, "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "distinct")
    entries = distinct.where("id IS NOT NULL").select("id", "fp", F.explode(bit_shards(F.col("fp"), radius, blocks)).alias("s"))
    links = tree_links(entries.select("id", "fp", "s.*"), ["part", "bits"], radius, block)
    return with_components(fps, distinct, "fp", links)


def with_components(rows: DataFrame, classes: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """Add ``component_id`` to ``rows`` of (doc_id, key), given links between the ids of ``classes``.

    ``classes`` has one row per key: its smallest ``id`` and its number of rows ``n``. Only class ids
    enter the search for components; the rows of a class get its answer by a join that spreads hot keys.
    """
    known = classes.where("id IS NOT NULL").select(key, "id", "n")
    # an id that stands under several keys links them
    repeats = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("_low"), F.max(key).alias("_high")).where("_low <> _high")
    again = rows.join(repeats, "doc_id").select("doc_id", key).join(known, key).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.unionByName(again))
    named = known.join(found, known["id"] == found["node"], "left").select(key, F.coalesce("component", "id").alias("component_id"), "n")
    return lookup_join(rows, stored(named, "components"), key, "component_id", F.col("n"), F.col("doc_id"), "left")


# ------------------------------------------------------------------ near-duplicate texts


def describe(docs: DataFrame, size: int, anchors: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, fp, anchors, shingles`` of every text; equal words give an equal key."""
    factors = np.array([xxhash.xxh64_intdigest(b"anchor", i) | 1 for i in range(anchors)], np.uint64)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, fps, least, sets = [], [], [], []
            for text in batch["text"]:
                words = words_of(text)
                hashes = shingle_hashes(words, size)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                hashes = np.unique(hashes)  # the similarity is one of sets
                fps.append(signed(fingerprint(hashes)))
                # a text without words has no shingles, hence one anchor that only such texts share
                mixed = [(hashes * f).min() if len(hashes) else np.uint64(1) for f in factors]
                least.append((np.array(mixed, np.uint64) ^ factors).view(np.int64).tolist())
                sets.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": keys, "fp": np.array(fps, np.int64), "anchors": least, "shingles": sets})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.where("doc_id IS NOT NULL").mapInPandas(
        compute, "doc_id long, text_key binary, fp long, anchors array<long>, shingles binary"
    )


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    similarity: float = 0.8,
    radius: int = 20,
    anchors: int = 6,
    block: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, component_id`` of every row with an id: groups of texts of similar word shingles.

    Texts link if their sets of ``size``-word shingles have a Jaccard similarity of at least
    ``similarity``. Candidates share one of ``anchors`` smallest shingle hashes. Those with
    fingerprints of the distinct shingles within ``radius`` are compared first, then all others that are
    not yet joined: only a pair without a common anchor is missed (at 0.8, once in 15,000). Texts with the same words are one text from the start and are never compared.
    A null text is empty; empty texts are one group. Rows that repeat an id are one document.
    """
    every = stored(describe(docs, size, anchors, id_col, text_col), "described")
    texts = stored(
        every.groupBy("text_key").agg(
            F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("anchors").alias("anchors"), F.first("fp").alias("fp")
        ),
        "texts",
    )
    entries = texts.select(F.explode("anchors").alias("key"), "id", "fp")
    shared = stored(entries.join(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("key", "id", "fp"), "shared")
    # only texts that share an anchor bring their shingles along; each of their ids is put in twice
    wanted = shared.select("id")
    bits, _ = bloom.map_bits(texts.count())
    known = bloom.maybe_repeated(every, "doc_id", bloom.repeated_map(wanted.unionAll(wanted), "id", bits))
    owners = texts.select("text_key", "id").join(wanted.distinct(), "id")
    sets = every.where(known).select(F.col("doc_id").alias("id"), "text_key", "shingles").join(owners, ["id", "text_key"])
    sets = sets.select("id", "shingles").dropDuplicates(["id"])
    links = tree_links(shared.join(sets, "id"), ["key"], radius, block, similarity)
    return with_components(every.select("doc_id", "text_key"), texts, "text_key", links).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose group has a smaller id.

    Rows without id stay.
    """
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(unused(docs, "gone")))
    return without(docs, gone, id_col)


# ------------------------------------------------------------------ query


@answer()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = fingerprint_groups(fingerprints(table(spark, sf_dir, "documents")))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
