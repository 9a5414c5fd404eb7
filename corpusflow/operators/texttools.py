"""New or changed text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.cells import sentence_breaks, split_blanks
from ..functions.patterns import never_empty, spark_regex, spark_replacement
from ..plans import bloom
from ..plans.checkpoints import stored
from ..plans.skew import lookup_join

SAID_TOKENS = 1 << 20  # tokens that a task replaces at a time


def regex_replace_columns(df: DataFrame, columns: list[str], find: str, replace: str) -> DataFrame:
    regex = spark_regex(find, ignore_case=True, multiline=True)
    return df.withColumns(
        {c: F.regexp_replace(F.col(c), F.lit(regex), F.lit(spark_replacement(replace))) for c in columns}
    )


def replacement_counts(df: DataFrame, columns: list[str], find: str) -> DataFrame:
    """Occurrences and changed cells over all given columns."""
    regex = spark_regex(find, ignore_case=True, multiline=True)
    hits = F.inline(F.array(*[F.struct(F.regexp_count(F.col(c), F.lit(regex)).cast("long").alias("n")) for c in columns]))
    return df.select(hits).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("replacements"), F.count_if(F.col("n") > 0).alias("replaced_cells")
    )


def replace_counted(df: DataFrame, columns: list[str], find: str, replace: str) -> tuple[DataFrame, dict[str, int]]:
    """The table with replaced columns, written once, and its ``replacements`` and ``replaced_cells``.

    Both counts are metrics of the pass that writes the table, so the texts are read once. They are those of
    ``replacement_counts``; a null cell has no occurrence, an empty table gives zeros.
    """
    regex = F.lit(spark_regex(find, ignore_case=True, multiline=True))
    hits = [F.coalesce(F.regexp_count(F.col(c), regex), F.lit(0)).cast("long") for c in columns]
    counts = Observation()
    # counted on the old cells, which the replacement comes after
    counted = df.observe(
        counts,
        F.coalesce(F.sum(sum(hits[1:], hits[0])), F.lit(0)).alias("replacements"),
        F.coalesce(F.sum(sum([(h > 0).cast("long") for h in hits[1:]], (hits[0] > 0).cast("long"))), F.lit(0)).alias("replaced_cells"),
    )
    replaced = stored(regex_replace_columns(counted, columns, find, replace), "replaced")
    return replaced, counts.get


def find_preview(text: Column, find: str) -> Column:
    """First match with ten characters on both sides, newlines as blanks; null without match."""
    regex = spark_regex(never_empty(find), ignore_case=True, multiline=True)
    start = F.regexp_instr(text, F.lit(regex))
    match = F.regexp_substr(text, F.lit(regex))
    left = F.substring(text, F.greatest(F.lit(1), start - 10), F.least(F.lit(10), start - 1))
    right = F.substring(text, start + F.length(match), F.lit(10))
    return F.regexp_replace(F.concat(left, match, right), r"\n+", " ")


def derive_columns(df: DataFrame, columns: list[str], fn: Callable[[Column], Column], affix: str) -> DataFrame:
    """Write ``fn(column)`` to ``column + affix`` with its cell statistics.

    ``fn`` takes and gives a Column: built-in expressions or a ``pandas_udf``.
    """
    out = df.withColumns({c + affix: fn(F.col(c)) for c in columns})
    stats: dict[str, Column] = {}
    for c in columns:
        stats[f"{c}{affix}_nb_sentences"] = sentence_breaks(F.col(c + affix)).cast("long")
        stats[f"{c}{affix}_nb_characters"] = F.length(c + affix).cast("long")
    return out.withColumns(stats)


# ------------------------------------------------------------- annotations

ANNOTATION_FIELDS = 6  # word / tag / chunk / verb phrase / preposition / lemma


def project_annotation(annotated: Column, mode: str) -> Column:
    """Lemmas, tags, both, or everything of slash-annotated tokens, line by line.

    Tokens without the right number of fields are left out; ``&slash;`` stands for a slash.
    """
    def unprotected(c: Column) -> Column:
        return F.regexp_replace(c, "(?i)&slash;", "/")

    if mode == "complete":
        return unprotected(annotated)
    shown = {
        "lemma": lambda f: f[5],
        "tag": lambda f: f[1],
        "lemma-tag": lambda f: F.concat(f[5], F.lit("-"), f[1]),
    }[mode]
    lines = F.filter(
        F.transform(F.split(annotated, "\n"), lambda line: split_blanks(line)), lambda t: F.size(t) > 0
    )
    return F.array_join(
        F.transform(
            lines,
            lambda tokens: F.concat(
                F.array_join(
                    F.transform(
                        F.filter(
                            F.transform(tokens, lambda t: F.split(t, "/")),
                            lambda f: F.size(f) == ANNOTATION_FIELDS,
                        ),
                        lambda f: F.concat(unprotected(shown(f)), F.lit(" ")),
                    ),
                    "",
                ),
                F.lit("\n"),
            ),
        ),
        "",
    )


def lemmatize_with(df: DataFrame, id_col: str, column: str, lexicon: DataFrame, out: str, mode: str = "lemma") -> DataFrame:
    """Replace each token by its lemma, tag or both from ``lexicon(form, lemma, tag)``; others stay.

    Of several readings of a form the first by lemma and tag counts. Distinct forms are looked up,
    not tokens, so a frequent word is joined once per text, and the result is put back by the text's
    own forms, for many texts at once as Arrow columns.
    """
    shown = {
        "lemma": lambda: F.col("lemma"), "tag": lambda: F.col("tag"),
        "lemma-tag": lambda: F.concat("lemma", F.lit("-"), "tag"),
    }[mode]()
    tokens = df.select(id_col, F.split(F.col(column), spark_regex(r"\s+")).alias("_tokens"))
    forms = stored(tokens.select(id_col, F.explode(F.array_distinct("_tokens")).alias("form")), "forms")
    tagged = lexicon if "tag" in lexicon.columns else lexicon.withColumn("tag", F.lit(None).cast("string"))
    entries = (
        tagged.where(F.col("form").isNotNull()).groupBy("form").agg(F.min(F.struct("lemma", "tag")).alias("first"))
        .select("form", "first.*").select("form", shown.alias("said")).where(F.col("said").isNotNull())
    )
    counted = stored(entries.join(forms.groupBy("form").agg(F.count("*").alias("n")), "form"), "entries")
    found = (
        # "the" stands in nearly every text
        lookup_join(forms, counted, "form", "said", F.col("n"), F.col(id_col))
        .groupBy(id_col)
        .agg(F.map_from_entries(F.collect_list(F.struct("form", "said"))).alias("_said"))
    )
    said = tokens.join(found, id_col, "left").select(
        id_col, "_tokens", F.map_keys("_said").alias("_forms"), F.map_values("_said").alias("_said")
    )
    done = said.mapInArrow(lambda batches: _said_batches(batches, out), StructType([said.schema[id_col], StructField(out, StringType())]))
    return df.join(done, id_col)


def _said_batches(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    """Rows ``id, tokens, forms, said`` as ``id, text``: each token that is among the row's forms as it is said there."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("_tokens")), 0).to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SAID_TOKENS, prepend=0)).tolist()
        for start, end in zip([0, *bounds], [*bounds, batch.num_rows]):
            if start < end:
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0), _said(*part.columns[1:])], names=[part.schema.names[0], out])


def _said(tokens: pa.ListArray, forms: pa.ListArray, said: pa.ListArray) -> pa.Array:
    sizes, known = (pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (tokens, forms))
    words, replies = tokens.flatten(), said.flatten()
    # a row's forms and tokens are numbered alike, then looked up by row and number
    coded = pa.concat_arrays([words, forms.flatten()]).dictionary_encode()
    codes, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    rows = np.arange(len(sizes))
    asked, keys = np.repeat(rows, sizes) * n + codes[: len(words)], np.repeat(rows, known) * n + codes[len(words) :]
    order = np.argsort(keys)
    at = np.searchsorted(keys[order], asked)
    at = order[np.minimum(at, len(order) - 1)] if len(order) else np.zeros(len(asked), np.int64)
    hit = keys[at] == asked if len(order) else np.zeros(len(asked), bool)
    chosen = pa.concat_arrays([words, replies]).take(pa.array(np.where(hit, len(words) + at, np.arange(len(words)))))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, chosen), " ")
    return pc.if_else(tokens.is_valid(), joined, pa.scalar(None, pa.string()))


def _longest_first(text: str, words: set[str]) -> str:
    """Cut at the longest word that begins at a place, else after one character; lengths are tried by the first two characters."""
    lengths: dict[str, list[int]] = {}
    for w in sorted((w for w in words if len(w) > 1), key=len, reverse=True):
        sizes = lengths.setdefault(w[:2], [])
        if not sizes or sizes[-1] != len(w):
            sizes.append(len(w))
    out, i, none = [], 0, ()
    while i < len(text):
        size = 1
        for k in lengths.get(text[i : i + 2], none):
            if text[i : i + k] in words:
                size = k
                break
        out.append(text[i : i + size])
        i += size
    return " ".join(out)


def _piece_hashes(text: str, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the hashes of all pieces of the text of that length, by a running polynomial."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    total, wanted = np.zeros(len(points) + 1, np.uint64), set(lengths)
    for k in range(1, min(max(lengths, default=0), len(points)) + 1):
        total = total[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[k - 1 :]
        if k in wanted:
            yield k, total ^ (total >> np.uint64(32))


def segment_with(df: DataFrame, id_col: str, column: str, lexicon: DataFrame, out: str) -> DataFrame:
    """Forward maximum matching against ``lexicon(form)``, words joined by blanks; ids are unique.

    The lexicon may have any size: it reaches the texts as a bit map of bounded size, which names the
    pieces of a text that may be forms. Those are looked up exactly, and each text is cut with its own
    forms: where a word ends decides where the next begins, which built-in functions cannot express.
    """
    forms = lexicon.select("form").where(F.length("form") > 1).distinct()
    lengths = sorted(r.n for r in forms.select(F.length("form").alias("n")).distinct().collect())  # one per length

    @pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series([int(next(h for _, h in _piece_hashes(v, [len(v)]))[0].view(np.int64)) for v in values], dtype="int64")

    keyed = stored(forms.withColumn("h", hashed("form")), "forms")
    bits, _ = bloom.map_bits(keyed.count())
    # a form is put in twice, so that its places count as hit by two
    ask = bloom.asks(df, bloom.repeated_map(keyed.select("h").unionAll(keyed.select("h")), "h", bits))

    @pandas_udf("array<string>")
    def candidates(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[str]:
            if not text:
                return []
            return list({text[i : i + k] for k, h in _piece_hashes(text, lengths) for i in np.flatnonzero(ask(h)).tolist()})

        return texts.map(of)

    pieces = stored(df.select(id_col, F.explode(candidates(F.col(column))).alias("form")), "pieces")
    counted = stored(keyed.select("form").join(pieces.groupBy("form").agg(F.count("*").alias("n")), "form").withColumn("known", F.lit(True)), "counted")
    found = (
        lookup_join(pieces, counted, "form", "known", F.col("n"), F.col(id_col)).groupBy(id_col).agg(F.collect_list("form").alias("_forms"))
    )

    @pandas_udf("string")
    def segment(texts: pd.Series, words: pd.Series) -> pd.Series:
        rows = ((t, set(w) if w is not None else set()) for t, w in zip(texts, words))
        return pd.Series([None if t is None else _longest_first(t, w) for t, w in rows], dtype=object)

    done = df.select(id_col, F.col(column).alias("_text")).join(found, id_col, "left").select(id_col, segment("_text", "_forms").alias(out))
    return df.join(done, id_col)


# ------------------------------------------------------------- plain normal forms


def normalize_text(text: Column) -> Column:
    """White space squeezed, three dots as an ellipsis, curly apostrophes straight."""
    out = F.regexp_replace(text, spark_regex(r"\s+"), " ")
    out = F.replace(out, F.lit("..."), F.lit("…"))
    return F.translate(out, "‘’", "''")


def punct_tokenize(text: Column) -> Column:
    """Punctuation after a word and opening signs stand apart, then split at blanks."""
    spaced = F.regexp_replace(normalize_text(text), spark_regex(r"(?<=\w)([!,?.:;»«])"), " $1")
    spaced = F.regexp_replace(spaced, "(['(»«‘’])", "$1 ")
    return split_blanks(spaced)
