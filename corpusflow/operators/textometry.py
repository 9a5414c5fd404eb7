"""Sections, tokens, bags of words, specificity, co-occurrence and collocations.

Column contract: sections are ``(section_id, label, text)``; tokens are
``(section_id, tokens)`` with one array per section, or, for sections made of many
rows, bounded stretches ``(section_id, tokens, core)``; counts are long form.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import characters
from ..functions.hypergeom import with_specificity
from ..functions.patterns import WORD_LIMIT, spark_regex
from ..plans.checkpoints import stored
from ..plans.ordered import running_total
from ..plans.skew import lookup_join

EDGE_TYPE = "suit"  # fixed value: the type of all edges of a collocation graph
PAIR_TOKENS = 1 << 21  # tokens whose pairs a task counts at a time
PIECE_TOKENS = 1 << 21  # tokens of one text whose pairs are counted at a time
PAIR_PLACES = 1 << 18  # tokens whose pairs are listed at a time
PAIR_ROWS = 1 << 16  # pairs that leave a task at a time
TASK_TOKENS = 1 << 20  # tokens whose pairs a task adds up
TOP_WORDS = 1 << 16  # most frequent tokens that are numbered and broadcast with their totals
STRETCH = 4096  # tokens per stretch of a section that is made of many rows


# ---------------------------------------------------------------- sections


def sections_by_row(df: DataFrame, id_col: str, label_col: str, columns: list[str]) -> DataFrame:
    """One section per row: its columns joined by newlines."""
    return df.select(
        F.col(id_col).alias("section_id"),
        F.col(label_col).cast("string").alias("label"),
        F.concat_ws("\n", *[F.col(c).cast("string") for c in columns]).alias("text"),
    )


def sections_by_group(df: DataFrame, group_col: str, order_cols: list[str], columns: list[str]) -> DataFrame:
    """One section per group, kept as its ordered pieces ``(section_id, piece.., text)``.

    Every cell ends with a newline. The pieces of a group are never joined into
    one value: a group may hold a large share of the corpus.
    """
    text = F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n")) for c in columns])
    return df.select(F.col(group_col).alias("section_id"), *order_cols, text.alias("text"))


def group_order(df: DataFrame, group_col: str) -> DataFrame:
    """Groups with their number of rows, largest first."""
    return df.groupBy(F.col(group_col).alias("section_id")).agg(F.count("*").alias("n_rows")).orderBy(
        F.desc("n_rows"), "section_id"
    )


# ---------------------------------------------------------------- tokens


def token_array(text: Column, wordlimit: str = WORD_LIMIT, lower: bool = True) -> Column:
    """Split at the word limit; empty strings at the edges are kept."""
    return F.split(F.lower(text) if lower else text, spark_regex(wordlimit))


def tokenize(sections: DataFrame, wordlimit: str = WORD_LIMIT, lower: bool = True) -> DataFrame:
    return sections.select("section_id", token_array(F.col("text"), wordlimit, lower).alias("tokens"))


def tokenize_groups(
    pieces: DataFrame, order_cols: list[str], wordlimit: str = WORD_LIMIT, lower: bool = True
) -> DataFrame:
    """Tokens of sections made of many pieces, one row per piece.

    Same tokens as splitting the joined text: between pieces the newline is a
    limit, so empty tokens can only stand at the very start and the very end.
    Both edges are found with one small aggregation per group.
    """
    limit = spark_regex(wordlimit)
    edges = pieces.groupBy("section_id").agg(
        F.min_by(
            F.struct(*order_cols, F.col("text").rlike(r"\A" + limit).alias("blank_start")),
            F.struct(*order_cols),
        ).alias("first"),
        F.max(F.struct(*order_cols)).alias("last"),
    )
    filled = pieces.select(
        "section_id",
        F.struct(*order_cols).alias("place"),
        F.filter(token_array(F.col("text"), wordlimit, lower), lambda t: t != "").alias("tokens"),
    )
    blank = F.array(F.lit(""))
    leading = edges.where(F.col("first.blank_start")).select(
        "section_id", F.struct(*[F.col(f"first.{c}") for c in order_cols]).alias("place"),
        F.lit(0).alias("rank"), blank.alias("tokens"),
    )
    trailing = edges.select(
        "section_id", F.col("last").alias("place"), F.lit(2).alias("rank"), blank.alias("tokens")
    )
    return (
        filled.select("section_id", "place", F.lit(1).alias("rank"), "tokens")
        .unionByName(leading)
        .unionByName(trailing)
    )


def stretches(piece_tokens: DataFrame, n: int) -> DataFrame:
    """Cut the token sequence of each section into stretches of bounded length.

    A stretch holds ``STRETCH`` tokens of its own (``core``) and the next ``n - 1``
    tokens of the section, so every window of ``n`` tokens lies in the stretch of
    its first token, across the borders of pieces too.
    """
    sized = piece_tokens.withColumn("size", F.size("tokens"))
    offsets = running_total(
        sized.select("section_id", "place", "rank", "size"),
        ["section_id"],
        ["place", "rank"],
        F.col("size"),
        "offset",
    ).drop("size")
    placed = sized.join(offsets, ["section_id", "place", "rank"]).select(
        "section_id", "offset", F.posexplode("tokens").alias("i", "token")
    )
    position = F.col("offset") + F.col("i")
    own = (position / STRETCH).cast("long")
    # the earliest stretch whose windows still reach this token
    earliest = F.greatest(F.lit(0).cast("long"), F.ceil((position - n + 2) / STRETCH) - 1)
    copies = F.sequence(F.least(own, earliest), own)
    return (
        placed.select("section_id", "token", position.alias("position"), F.explode(copies).alias("stretch"))
        .groupBy("section_id", "stretch")
        .agg(F.array_sort(F.collect_list(F.struct("position", "token"))).alias("t"))
        .select(
            "section_id",
            F.col("t.token").alias("tokens"),
            F.size(F.filter("t", lambda e: e.position < (F.col("stretch") + 1) * STRETCH)).alias("core"),
        )
    )


def bag_of_words(tokens: DataFrame) -> DataFrame:
    """(section, token) with its frequency."""
    return (
        # outer: the plain form would add a filter on the size of the array, which
        # tokenises the text a second time
        tokens.select("section_id", F.explode_outer("tokens").alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("section_id", "token")
        .agg(F.count("*").alias("freq"))
    )


def sized_bag(tokens: DataFrame) -> DataFrame:
    """As :func:`bag_of_words` with the ``size`` of the section, for sections that are dealt out by their id: nothing more is shuffled."""
    return bag_of_words(tokens).withColumn("size", F.sum("freq").over(Window.partitionBy("section_id")))


def vocabulary(bow: DataFrame) -> DataFrame:
    return bow.groupBy("token").agg(F.sum("freq").alias("totfreq"))


def vocabulary_ids(bow: DataFrame) -> DataFrame:
    """Vocabulary with dense ids from 0 in alphabetical order."""
    ranked = running_total(vocabulary(bow), [], ["token"], F.lit(1), "token_id")
    return ranked.select("token_id", "token", "totfreq")


def section_sizes(bow: DataFrame) -> DataFrame:
    """Tokens per section, taken from the bags so that hot sections are pre-summed."""
    return bow.groupBy("section_id").agg(F.sum("freq").alias("size"), F.count("*").alias("n_types"))


def corpus_size(tokens: DataFrame) -> DataFrame:
    return tokens.agg(
        F.sum(F.size("tokens").cast("long")).alias("corpus_size"),
        F.count("*").alias("n_sections"),
    )


def lexical_table(bow: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Types by sections in sparse form with both margins; ``bow`` is read three times, so store it.

    ``bow`` may bring the sizes along, as from :func:`sized_bag`; cells are then shuffled once.
    """
    # each is read for its sum, its hot and its other keys
    totals = stored(vocabulary(bow), "vocabulary") if vocab is None else vocab
    with_total = lookup_join(bow, totals, "token", "totfreq", F.col("totfreq"), F.col("section_id"))
    columns = ["token", "section_id", "freq", "totfreq", "size"]
    if "size" in bow.columns:
        return with_total.where("section_id IS NOT NULL").select(columns)  # a null id has no margin, as in the look-up
    sizes = stored(section_sizes(bow), "sizes")
    return lookup_join(with_total, sizes, "section_id", "size", F.col("size"), F.col("token")).select(columns)


def lexical_matrix(bow: DataFrame, section_ids: list) -> DataFrame:
    """Wide table for a short, given list of sections."""
    return (
        bow.groupBy("token")
        .pivot("section_id", section_ids)
        .agg(F.sum("freq"))
        .na.fill(0)
    )


# ---------------------------------------------------------------- specificity


def specificity(bow: DataFrame, threshold: float = 5.0, absent: bool = True) -> DataFrame:
    """Signed specificity of every token in every section.

    Non-zero frequencies come from the bags. A token that is absent from a section
    can be significantly rare there; such cells are produced by ``absent_cells`` and
    all others are 0 by construction and not listed.
    """
    bow = stored(bow, "bags")  # read by each of the joins below
    vocab = stored(vocabulary(bow), "vocabulary")
    cells = lexical_table(bow, vocab)
    if absent:
        cells = cells.unionByName(absent_cells(bow, threshold, vocab=vocab))
    corpus = bow.select(F.sum("freq")).scalar()
    scored = with_specificity(
        cells.withColumn("_corpus", corpus), F.col("_corpus"), F.col("size"), F.col("totfreq"), F.col("freq"), threshold
    ).drop("_corpus")
    return scored.where((F.col("freq") > 0) | (F.col("spec") != 0))


def _rarity(totfreq: Column, size: Column, corpus: Column) -> Column:
    """Lower bound of -ln P(X = 0); infinite where the bound does not apply."""
    share = size / (corpus - totfreq + 1)
    return F.when(share < 1, -totfreq * F.log1p(-share)).otherwise(F.lit(float("inf")))


def absent_cells(bow: DataFrame, threshold: float = 5.0, sections_per_block: int = 256, vocab: DataFrame | None = None) -> DataFrame:
    """Cells of frequency 0 whose probability may fall below the threshold.

    The bound grows with the total frequency, so each section names the lowest power of two from
    which tokens are frequent enough, and stands once, in a block of sections of its power. The
    tokens, which are few for any section, are copied to the blocks of all powers up to their own:
    one copy for about ``sections_per_block`` cells. The bound is checked for each pair and the
    cells that do occur are removed; if the tokens are at most ``TOP_WORDS``, only their own cells are shuffled for that.
    """
    needed = math.log(100 / threshold)
    corpus = bow.select(F.sum("freq")).scalar()
    first = F.get(
        F.filter(
            F.sequence(F.lit(0), F.lit(62)),
            lambda b: _rarity(F.pow(F.lit(2.0), b + 1) - 1, F.col("size"), F.greatest(F.col("corpus"), F.pow(F.lit(2.0), b + 1))) >= needed,
        ),
        0,
    )
    wanted = stored(
        section_sizes(bow).select("section_id", "size").withColumn("corpus", corpus).withColumn("power", first),
        "wanted",
    ).where("power IS NOT NULL")
    # at most 63 rows, whatever the corpus
    sizes = {r.power: -(-r["count"] // sections_per_block) for r in wanted.groupBy("power").count().collect()}
    if not sizes:
        return _cells_of_none(bow)
    blocks = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    totals = vocabulary(bow) if vocab is None else vocab
    tokens = totals.withColumn("_own", F.floor(F.log2("totfreq")).cast("int")).where(F.col("_own") >= min(sizes))
    copies = tokens.withColumn("power", F.explode(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda p: p <= F.col("_own")))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("power")) - 1))
    )
    pairs = (
        wanted.withColumn("block", F.pmod(F.xxhash64("section_id"), F.element_at(blocks, F.col("power"))).cast("int"))
        .join(copies, ["power", "block"])
        .where(_rarity(F.col("totfreq").cast("double"), F.col("size"), F.col("corpus")) >= needed)
        .select("token", "section_id", F.lit(0).cast("long").alias("freq"), "totfreq", "size")
    )
    present = bow.select("section_id", "token")
    if tokens.limit(TOP_WORDS + 1).count() <= TOP_WORDS:
        present = present.join(F.broadcast(tokens.select("token")), "token", "left_semi")
    return pairs.join(present, ["section_id", "token"], "left_anti").select(
        "token", "section_id", "freq", "totfreq", "size"
    )


def _cells_of_none(bow: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return bow.limit(0).select("token", "section_id", zero.alias("freq"), zero.alias("totfreq"), zero.alias("size"))


def specificity_of_selection(bow: DataFrame, chosen: Column, threshold: float = 5.0) -> DataFrame:
    """Specificity of every token of the corpus in the union of the chosen sections."""
    totals = bow.groupBy("token").agg(
        F.sum("freq").alias("totfreq"),
        F.coalesce(F.sum(F.when(chosen, F.col("freq"))), F.lit(0)).alias("freq"),
    )
    sums = totals.withColumn("_size", totals.select(F.sum("freq")).scalar()).withColumn(
        "_corpus", totals.select(F.sum("totfreq")).scalar()
    )
    return with_specificity(
        sums, F.col("_corpus"), F.col("_size"), F.col("totfreq"), F.col("freq"), threshold
    ).drop("_size", "_corpus")


def token_table(
    bow: DataFrame, chosen: Column, pattern: str | None = None, threshold: float = 5.0
) -> DataFrame:
    """Tokens of a selection, most specific first; ``pattern`` filters the tokens."""
    table = specificity_of_selection(bow, chosen, threshold)
    if pattern:
        table = table.where(F.col("token").rlike(spark_regex(pattern)))
    return table.orderBy(F.desc("spec"), F.desc("freq"), "token")


def sections_with_token(bow: DataFrame, token: str) -> DataFrame:
    return bow.where(F.col("token") == token).select("section_id", "freq")


def sections_specific(spec: DataFrame, token: str, sign: int = 1) -> DataFrame:
    """Sections where the token is over-represented (sign 1) or under-represented (-1)."""
    return spec.where((F.col("token") == token) & (F.col("spec") * sign > 0)).select(
        "section_id", "freq", "spec"
    )


def token_evolution(bow: DataFrame, token: str, threshold: float = 5.0) -> DataFrame:
    """Frequency and specificity of one token in all sections, with the extremes."""
    sizes = bow.groupBy("section_id").agg(
        F.sum("freq").alias("size"),
        F.coalesce(F.sum(F.when(F.col("token") == token, F.col("freq"))), F.lit(0)).alias("freq"),
    )
    return evolution(sizes, threshold)


def evolution(sizes: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Specificity of a token from ``section_id, size, freq`` of all sections, with the extremes."""
    cells = sizes.withColumn("_corpus", sizes.select(F.sum("size")).scalar()).withColumn(
        "_totfreq", sizes.select(F.sum("freq")).scalar()
    )
    scored = with_specificity(
        cells, F.col("_corpus"), F.col("size"), F.col("_totfreq"), F.col("freq"), threshold
    ).drop("_corpus", "_totfreq")
    return (
        scored.withColumn("min_spec", scored.select(F.min("spec")).scalar())
        .withColumn("max_spec", scored.select(F.max("spec")).scalar())
        .withColumn("max_freq", scored.select(F.max("freq")).scalar())
    )


def selection_summary(tokens: DataFrame, chosen: Column) -> DataFrame:
    size = F.size("tokens").cast("long")
    return tokens.agg(
        F.coalesce(F.sum(F.when(chosen, size)), F.lit(0)).alias("selected_tokens"),
        F.count_if(chosen).alias("selected_sections"),
        F.sum(size).alias("corpus_size"),
    )


# ---------------------------------------------------------------- co-occurrence


def token_ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """Contiguous n-grams of each section in order."""
    grams = F.transform(
        F.slice(F.col("tokens"), F.lit(1), F.greatest(F.size("tokens") - n + 1, F.lit(0))),
        lambda t, i: F.array_join(F.slice(F.col("tokens"), i + 1, F.lit(n)), " "),
    )
    return tokens.select("section_id", F.posexplode(grams).alias("pos", "ngram"))


def cooccurrences(tokens: DataFrame, n: int, of: list[str] | None = None) -> DataFrame:
    """Directed counts of tokens that stand at most ``n - 1`` positions apart; with ``of`` only those whose ``x`` is one of these.

    Each unordered pair is counted once in the shuffle and mirrored afterwards,
    which halves the rows that are exchanged. Equal tokens count in both directions.
    """
    return _directed(tokens, n, False, of)


def _directed(tokens: DataFrame, n: int, every_window: bool, of: list[str] | None) -> DataFrame:
    both = _mirrored(_counted(tokens, n, every_window, of))
    return both if of is None else both.where(F.col("x").isin(of))


def _counted(tokens: DataFrame, n: int, every_window: bool, of: list[str] | None = None) -> DataFrame:
    """Counts of unordered pairs, ``x <= y``: tasks count many texts at once as numpy arrays, so that few rows are left to add up."""
    return _added_up(_packed(tokens, n, every_window, False, of).repartition("x"))


def _by_arrow(tokens: DataFrame, n: int, every_window: bool) -> DataFrame:
    core = F.col("core") if "core" in tokens.columns and not every_window else F.size("tokens")
    return tokens.select("tokens", core.cast("int").alias("core"))


def _slices(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows dealt into lists of batches, each ended by the row that makes it ``bound`` tokens."""
    kept, size = [], 0
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            end = min(batch.num_rows, int(np.searchsorted(total, before + bound - size)) + 1)
            kept.append(batch.slice(start, end - start))
            size += int(total[end - 1]) - before
            start, before = end, int(total[end - 1])
            if size >= bound:
                yield kept
                kept, size = [], 0
    if kept:
        yield kept


def coded(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens in order, the number of each token among them, and tokens per row."""
    lists = pa.concat_arrays([b.column("tokens") for b in batches])
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return encoded.dictionary.take(pa.array(order)), rank[encoded.indices.to_numpy()], sizes


def _pair_counts(
    batches: Iterator[pa.RecordBatch], n: int, every_window: bool, of: list[str] | None = None
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Words in order, keys ``x * len(words) + y`` of unordered pairs, ascending, and their counts, for some millions of tokens at a time.

    One array holds the pairs and is sorted where it lies: a task has about ``8 * (n - 1)`` bytes for a token.
    """
    for part in _slices(batches, PAIR_TOKENS):
        words, codes, sizes = coded(part)
        core = np.concatenate([pc.fill_null(b.column("core"), 0).to_numpy(zero_copy_only=False) for b in part])
        asked = None if of is None else pc.is_in(words, value_set=pa.array(of, pa.string())).to_numpy(zero_copy_only=False)[codes]
        # a text may be longer than all that is counted at a time
        pieces = max(1, round(len(codes) / PIECE_TOKENS))
        for i in range(pieces):
            key = _pair_keys(codes, sizes, core, len(words), n, every_window, asked, len(codes) * i // pieces, len(codes) * (i + 1) // pieces)
            key.sort()
            weights = None
            if every_window:
                weights = np.empty(len(key), np.int32)
                np.remainder(key, n, out=weights, casting="unsafe")
                np.floor_divide(key, n, out=key)
            first = np.flatnonzero(np.concatenate([key[:1] >= 0, key[1:] != key[:-1]]))
            if not len(first):
                continue
            counts = np.diff(first, append=len(key)) if weights is None else np.add.reduceat(weights, first, dtype=np.int64)
            key = key[first]
            del first, weights
            yield words, key, counts


def _pair_keys(
    codes: np.ndarray, sizes: np.ndarray, core: np.ndarray, width: int, n: int, every_window: bool, asked: np.ndarray | None, start: int, stop: int
) -> np.ndarray:
    """Keys of the pairs whose first token stands at ``start`` to ``stop``; with ``every_window`` times ``n``, plus the number of windows."""
    ends = np.cumsum(sizes)
    keys, filled = np.empty((n - 1) * (stop - start), np.int64), 0
    for low in range(start, stop, PAIR_PLACES):
        high = min(stop, low + PAIR_PLACES)
        place = np.arange(low, high)
        row = np.searchsorted(ends, place, side="right")
        end, size = ends[row], sizes[row]
        left = np.minimum(end, end - size + core[row])
        for d in range(1, n):
            m = min(high, len(codes) - d) - low
            if m <= 0:
                break
            a, b = codes[low : low + m], codes[low + d : low + d + m]
            chosen = (place[:m] + d < end[:m]) & (place[:m] < left[:m])
            if asked is not None:
                chosen &= asked[low : low + m] | asked[low + d : low + d + m]
            if every_window:
                at = place[:m] - (end[:m] - size[:m])
                windows = np.minimum(at, size[:m] - n) - np.maximum(0, at + d - n + 1) + 1
                chosen &= windows > 0
            pair = np.minimum(a, b)[chosen] * width + np.maximum(a, b)[chosen]
            keys[filled : filled + len(pair)] = pair * n + windows[chosen] if every_window else pair
            filled += len(pair)
    return keys[:filled]


def packed_cooccurrences(tokens: DataFrame, n: int, ranges: int | None = None) -> DataFrame:
    """As :func:`cooccurrences`, in ranges of ``x`` and sorted by ``x, y``.

    The collocates of a token travel as one row for some millions of tokens of text. A token has at most as many as there are words.
    """
    packed = _packed(tokens, n, False, True)
    return _added_up(packed.repartitionByRange(ranges, "x") if ranges else packed.repartitionByRange("x")).sortWithinPartitions("x", "y")


def _packed(tokens: DataFrame, n: int, every_window: bool, mirrored: bool, of: list[str] | None = None) -> DataFrame:
    kind = "long" if every_window else "int"
    return _by_arrow(tokens, n, every_window).mapInArrow(
        lambda batches: (rows for counts in _pair_counts(batches, n, every_window, of) for rows in _packed_rows(*counts, mirrored, kind)),
        f"x string, joined string, ys array<string>, ns array<{kind}>",
    )


def _added_up(packed: DataFrame) -> DataFrame:
    """Sums of the counts of packed rows that are dealt out by ``x``."""
    ys = F.coalesce("ys", F.split("joined", "\x00"))
    both = packed.select("x", F.inline(F.arrays_zip(ys.alias("y"), F.col("ns").alias("n"))).alias("y", "n"))
    return both.groupBy("x", "y").agg(F.sum("n").alias("cooc"))


def _packed_rows(words: pa.Array, key: np.ndarray, count: np.ndarray, mirrored: bool, kind: str = "long") -> Iterator[pa.RecordBatch]:
    """Rows of ``x`` with its collocates, with ``mirrored`` all of them; about ``PAIR_ROWS`` pairs, or the row of one token, leave at a time."""
    width = len(words)
    back, back_count = key[:0], count[:0]
    if mirrored:
        turned = key % width * width + key // width
        same = turned == key
        count = np.where(same, 2 * count, count)
        order = np.argsort(turned)
        order = order[~same[order]]
        back, back_count = turned[order], count[order]
        del turned, same, order
    # the pairs of a token may stand in both sequences
    total = np.cumsum(np.bincount(key // width, minlength=width) + np.bincount(back // width, minlength=width))
    cuts = np.unique([0, *(np.flatnonzero(np.diff(total // PAIR_ROWS)) + 1), width])
    at, back_at = np.searchsorted(key, cuts * width), np.searchsorted(back, cuts * width)
    # tokens that hold the sign between two travel as they are
    plain = not pc.any(pc.match_substring(words, "\0")).as_py()
    for i in range(len(cuts) - 1):
        here, there = slice(at[i], at[i + 1]), slice(back_at[i], back_at[i + 1])
        both, n = np.concatenate([key[here], back[there]]), np.concatenate([count[here], back_count[there]])
        if not len(both):
            continue
        order = np.argsort(both)
        x, y = np.divmod(both[order], width)
        owners, first = np.unique(x, return_index=True)
        offsets = pa.array(np.append(first, len(order)), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, words.take(pa.array(y)))
        joined = pc.binary_join(lists, "\0") if plain else pa.nulls(len(owners), pa.string())
        ys = pa.nulls(len(owners), pa.list_(pa.string())) if plain else lists
        ns = pa.ListArray.from_arrays(offsets, pa.array(n[order], pa.int64() if kind == "long" else pa.int32()))
        yield pa.RecordBatch.from_arrays([words.take(pa.array(owners)), joined, ys, ns], names=["x", "joined", "ys", "ns"])


def cooccurrences_with_totals(tokens: DataFrame, vocab: DataFrame, n: int) -> DataFrame:
    """As :func:`cooccurrences` with the total frequencies of both tokens, ``x, y, cooc, x_total, y_total``.

    Each unordered pair stands under the rarer of its tokens, whose place in the shuffle also holds its total: no
    token has many partners that are more frequent. The ``TOP_WORDS`` most frequent ones travel as numbers and get
    their totals by a bounded broadcast, so that only pairs of two other tokens are shuffled a second time.
    """
    top = stored(vocab.orderBy(F.desc("totfreq"), "token").limit(TOP_WORDS), "top")
    words = top.orderBy(F.desc("totfreq"), "token").toArrow()
    frequent, totals = words.column("token").combine_chunks().cast(pa.string()), words.column("totfreq").to_pylist()
    numbered = tokens.sparkSession.createDataFrame(
        pa.table({"rank": pa.array(range(len(totals)), pa.int32()), "y": frequent, "y_total": pa.array(totals, pa.int64())})
    )
    packed = _by_arrow(tokens, n, False).mapInArrow(
        lambda batches: (_ranked_rows(*counts, frequent) for counts in _pair_counts(batches, n, False)),
        "x string, ranks array<int>, ns array<int>, ys array<string>, ms array<int>",
    )
    no_word, no_rank = F.lit(None).cast("string"), F.lit(-1)
    pairs = F.concat(
        F.transform(F.arrays_zip("ranks", "ns"), lambda p: F.struct(p["ranks"].alias("rank"), no_word.alias("y"), p["ns"].alias("n"))),
        F.transform(F.arrays_zip("ys", "ms"), lambda p: F.struct(no_rank.alias("rank"), p["ys"].alias("y"), p["ms"].alias("n"))),
    )
    # packed rows are small for the pairs they hold, so tasks are told by tokens; x alone deals them out, which serves the sums and the look-up of x
    size = vocab.agg(F.sum("totfreq")).first()[0] or 0
    tasks = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_TOKENS))
    counted = packed.repartition(tasks, "x").select("x", F.inline(pairs)).groupBy("x", "rank", "y").agg(F.sum("n").alias("cooc"))
    known = counted.join(vocab.select(F.col("token").alias("x"), F.col("totfreq").alias("x_total")), "x")
    columns = ["x", "y", "cooc", "x_total", "y_total"]
    by_rank = known.where("rank >= 0").drop("y").join(F.broadcast(numbered), "rank").select(columns)
    others = vocab.select(F.col("token").alias("y"), F.col("totfreq").alias("y_total"))
    both = by_rank.unionByName(known.where("rank < 0").join(others, "y").select(columns))
    back = F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("cooc"), F.col("y_total").alias("x_total"), F.col("x_total").alias("y_total"))
    twice = F.struct("x", "y", (F.col("cooc") * 2).alias("cooc"), "x_total", "y_total")
    return both.select(F.inline(F.when(F.col("x") == F.col("y"), F.array(twice)).otherwise(F.array(F.struct(*columns), back))))


def _ranked_rows(words: pa.Array, key: np.ndarray, count: np.ndarray, frequent: pa.Array) -> pa.RecordBatch:
    """One row per token with its more frequent partners: their ranks, or the words if both are rare, and counts."""
    x, y = np.divmod(key, max(1, len(words)))
    rank = pc.fill_null(pc.index_in(words, value_set=frequent), len(frequent)).to_numpy(zero_copy_only=False).astype(np.int64)
    swapped = rank[x] < rank[y]
    x, y = np.where(swapped, y, x), np.where(swapped, x, y)
    order = np.lexsort((y, rank[y], x))
    x, y, count = x[order], y[order], count[order]
    rare = rank[y] == len(frequent)
    owners, columns = np.unique(x), []
    for chosen, values, kind in ((~rare, lambda y: pa.array(rank[y], pa.int32()), pa.int32()), (rare, lambda y: words.take(pa.array(y)), pa.string())):
        offsets = pa.array(np.append(np.searchsorted(x[chosen], owners), chosen.sum()), pa.int32())
        columns += [pa.ListArray.from_arrays(offsets, values(y[chosen]).cast(kind)), pa.ListArray.from_arrays(offsets, pa.array(count[chosen], pa.int32()))]
    return pa.RecordBatch.from_arrays([words.take(pa.array(owners)), *columns], names=["x", "ranks", "ns", "ys", "ms"])


def _mirrored(counted: DataFrame) -> DataFrame:
    same = F.col("x") == F.col("y")
    both = F.when(
        same, F.array(F.struct(F.col("x"), F.col("y"), (F.col("cooc") * 2).alias("cooc")))
    ).otherwise(
        F.array(
            F.struct(F.col("x"), F.col("y"), F.col("cooc")),
            F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("cooc")),
        )
    )
    return counted.select(F.inline(both))


def cooccurrences_multi(tokens: DataFrame, n: int) -> DataFrame:
    """Variant: a pair counts once for every window of ``n`` tokens that contains it."""
    return _directed(tokens, n, True, None)


def collocation_specificity(
    cooc: DataFrame, vocab: DataFrame, n: int, threshold: float = 5.0
) -> DataFrame:
    """Signed index of each collocate of each token; zeros are dropped.

    The collocate's surroundings are taken as a section of ``n`` times its frequency.
    ``cooc`` may bring both totals along, as from :func:`cooccurrences_with_totals`.
    """
    if "x_total" in cooc.columns:
        corpus = vocab.select(F.sum("totfreq")).scalar()
        both = cooc.select(
            F.col("x").alias("token"), F.col("y").alias("collocate"), "cooc",
            F.col("x_total").alias("totfreq"), (F.col("y_total") * n).alias("around"),
        )
        return _collocation_scores(both, corpus, threshold)
    vocab = stored(vocab, "vocabulary")  # read by the sum and by both look-ups
    corpus = vocab.select(F.sum("totfreq")).scalar()
    # a token has at most 2(n-1) partners per occurrence, so its frequency bounds its rows
    with_total = lookup_join(
        cooc.withColumnRenamed("x", "token"), vocab, "token", "totfreq", F.col("totfreq"), F.col("y")
    )
    around = vocab.select(
        F.col("token").alias("collocate"), (F.col("totfreq") * n).alias("around")
    )
    both = lookup_join(
        with_total.withColumnRenamed("y", "collocate"),
        around, "collocate", "around", F.col("around"), F.col("token"),
    )
    return _collocation_scores(both, corpus, threshold)


def _collocation_scores(both: DataFrame, corpus: Column, threshold: float) -> DataFrame:
    return (
        with_specificity(
            both.withColumn("_corpus", corpus), F.col("_corpus"), F.col("around"), F.col("totfreq"), F.col("cooc"), threshold
        )
        .where(F.col("spec") != 0)
        .select("token", "collocate", "totfreq", "cooc", "spec", "log10p")
    )


def collocation_table(
    collspec: DataFrame, vocab: DataFrame, token: str, pattern: str | None = None
) -> DataFrame:
    """Collocates of one token with their total frequency, most specific first."""
    rows = collspec.where(F.col("token") == token)
    if pattern:
        rows = rows.where(F.col("collocate").rlike(spark_regex(pattern)))
    totals = vocab.select(F.col("token").alias("collocate"), F.col("totfreq").alias("collocate_freq"))
    return (
        rows.join(totals, "collocate")
        .select("collocate", "collocate_freq", "cooc", "spec")
        .orderBy(F.desc("spec"), F.desc("collocate"))
    )


def collocation_graph(collspec: DataFrame, token: str, k: int = 5, depth: int = 1) -> DataFrame:
    """Edges from the token to its ``k`` best collocates, and on for ``depth`` more levels.

    ``level`` is that of the source. Each level is a semi join with at most
    ``k ** level`` nodes, so the frontier is bounded by the parameters.
    """
    best = (
        collspec.withColumn(
            "rank",
            F.row_number().over(
                Window.partitionBy("token").orderBy(F.desc("spec"), F.desc("collocate"))
            ),
        )
        .where(F.col("rank") <= k)
        .select(F.col("token").alias("source"), F.col("collocate").alias("target"), "spec", "rank")
    )
    best = stored(best, "best")  # read once per level; at most k rows per token
    edges = best.where(F.col("source") == token).withColumn("level", F.lit(0))
    frontier = edges
    for level in range(1, depth + 1):
        nodes = frontier.select(F.col("target").alias("source")).distinct()
        frontier = best.join(nodes, "source", "left_semi").withColumn("level", F.lit(level))
        edges = edges.unionByName(frontier)
    return edges.withColumn("type", F.lit(EDGE_TYPE))


def collocation_graph_of(
    cooc: DataFrame | Callable[[list[str]], DataFrame], vocab: DataFrame, n: int, token: str, k: int = 5, depth: int = 1, threshold: float = 5.0
) -> DataFrame:
    """Edges from the token to its ``k`` best collocates, and on for ``depth`` more levels.

    ``level`` is that of the source. Only pairs of the tokens that are asked for are scored: of the start, then of the
    collocates that the last level found, at most ``k ** level``. ``cooc`` is all pairs, or gives those of some tokens.
    """
    order = Window.partitionBy("token").orderBy(F.desc("spec"), F.desc("collocate"))
    pairs_of = (lambda words: cooc.where(F.col("x").isin(words))) if isinstance(cooc, DataFrame) else cooc
    edges, asked = None, [token]
    for level in range(depth + 1):
        best = (
            collocation_specificity(pairs_of(asked), vocab, n, threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("token").alias("source"), F.col("collocate").alias("target"), "spec", "rank", F.lit(level).alias("level"))
        )
        best = stored(best, "best")
        edges = best if edges is None else edges.unionByName(best)
        if level < depth:
            asked = [r.target for r in best.select("target").distinct().collect()]
    return edges.withColumn("type", F.lit(EDGE_TYPE))


def graph_levels(edges: DataFrame, token: str) -> DataFrame:
    """Smallest distance of every node from the start."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("label"), F.col("level")),
        F.struct(F.col("target").alias("label"), (F.col("level") + 1).alias("level")),
    )).alias("n"))
    return ends.groupBy("n.label").agg(F.min("n.level").alias("level"))


def graph_json(edges: DataFrame, token: str) -> DataFrame:
    """Edges and node levels as JSON; their number is bounded by k and depth."""
    links = edges.agg(
        F.to_json(F.transform(
            F.array_sort(F.collect_list(F.struct("level", "source", "rank", "target", "spec", "type"))),
            lambda e: F.struct(e.source.alias("source"), e.target.alias("target"), e.spec.alias("spec"), e.type.alias("type")),
        )).alias("links")
    )
    levels = graph_levels(edges, token).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "level"))))).alias("levels")
    )
    return links.withColumn("levels", levels.select("levels").scalar())


# ---------------------------------------------------------------- display


def describe_symbols(vocab: DataFrame) -> DataFrame:
    """Add ``names`` to the distinct tokens that have no word character: their Unicode names."""
    symbols = vocab.where(F.col("token").rlike(spark_regex(r"^\W+\z")))
    names = F.broadcast(characters(vocab.sparkSession, ["char_name"]))  # the size of Unicode
    parts = symbols.select("token", F.posexplode(F.split("token", "")).alias("pos", "char")).join(names, "char", "left")
    named = parts.groupBy("token").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "char_name"))), lambda s: s["char_name"]), " - "
        ).alias("names")
    )
    return symbols.join(named, "token")
