"""Tables of a corpus: wide views, filters, groups, duplicates, reductions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import preview, sentence_breaks
from ..functions.patterns import spark_regex

# Kinds of the columns every corpus has; others are judged by name.
COLUMN_KINDS = {
    "rowid": "nb", "link_origin_rowid": "nb", "nb_sentences": "nb", "nb_characters": "nb",
    "url": "txt", "source": "txt", "time": "time",
}
OTHER_GROUP = "_other_"


# ------------------------------------------------------------------ wide views


def textualize(sources: DataFrame, texts: DataFrame, columns: dict[int, str], view_id: int) -> DataFrame:
    """Long cells to one row per source with text, characters and sentences per column.

    A source that lacks one of the columns is left out, as with inner joins. One
    aggregation on the source id replaces a self-join per column.
    """
    wanted = texts.where((F.col("textualid") == view_id) & F.col("columnid").isin(*columns))
    aggregates: list[Column] = []
    for number, name in columns.items():
        here = F.col("columnid") == number
        for value, suffix in (("nb_characters", "_nb_characters"), ("nb_sentences", "_nb_sentences"), ("text", "")):
            aggregates.append(F.first(F.when(here, F.col(value)), ignorenulls=True).alias(name + suffix))
    present = reduce(and_, [F.bool_or(F.col("columnid") == number) for number in columns])
    wide = (
        wanted.groupBy(F.col("sourceid").alias("rowid"))
        .agg(*aggregates, present.alias("_present"))
        .where("_present")
        .drop("_present")
    )
    return sources.drop("source").join(wide, "rowid")


def cells_of(df: DataFrame, id_col: str, columns: dict[int, str], view_id: int = 1) -> DataFrame:
    """Wide text columns to long cells with statistics."""
    entries = F.array(
        *[F.struct(F.lit(n).alias("columnid"), F.col(c).cast("string").alias("text")) for n, c in columns.items()]
    )
    return with_cell_stats(
        df.select(F.col(id_col).alias("sourceid"), F.lit(view_id).alias("textualid"), F.inline(entries))
    )


def with_cell_stats(cells: DataFrame) -> DataFrame:
    return cells.select(
        "*",
        sentence_breaks(F.col("text")).cast("long").alias("nb_sentences"),
        F.length("text").cast("long").alias("nb_characters"),
    )


def distinct_columns(texts: DataFrame) -> DataFrame:
    return texts.select("columnid").distinct()


def view_columns(texts: DataFrame, registry: DataFrame, names: DataFrame, view_id: int) -> DataFrame:
    """Registered columns of a view that really have cells.

    Registry and names are lists of column definitions, a few rows each.
    """
    used = distinct_columns(texts)
    return (
        registry.where(F.col("textualid") == view_id)
        .join(names, F.col("columnid") == F.col("id"))
        .join(used, "columnid", "left_semi")
        .select("columnid", "name")
    )


# ------------------------------------------------------------------ columns


def column_kind(name: str) -> str:
    if name in COLUMN_KINDS:
        return COLUMN_KINDS[name]
    last = name.rsplit("_", 1)[-1] if "_" in name else ""
    # "x_nb_characters" keeps its kind in the last two words
    return "nb" if last.startswith("nb") or last == "rowid" or "_nb_" in name else "txt"


def text_columns_of(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c not in without and column_kind(c) == "txt"]


@dataclass(frozen=True)
class Visible:
    """The columns a user sees, as an immutable choice over ``all``."""

    all: tuple[str, ...]
    shown: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame) -> "Visible":
        return Visible(tuple(df.columns), tuple(df.columns))

    def _keep(self, chosen: set[str]) -> "Visible":
        return Visible(self.all, tuple(c for c in self.all if c in chosen))

    def only(self, *names: str) -> "Visible":
        return self._keep(set(names))

    def hide(self, *names: str) -> "Visible":
        return self._keep(set(self.shown) - set(names))

    def show(self, *names: str) -> "Visible":
        return self._keep(set(self.shown) | set(names))

    def invert(self) -> "Visible":
        return self._keep(set(self.all) - set(self.shown))

    def show_all(self) -> "Visible":
        return self._keep(set(self.all))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*self.shown)


# ------------------------------------------------------------------ filters


@dataclass(frozen=True)
class Condition:
    """One line of a filter: column, operation, value.

    Operations: ``= <= >= !=`` for numbers, ``whole word``, ``contains``, ``equals`` for
    text, ``before`` and ``after`` (both inclusive) for times.
    """

    column: str
    operation: str
    value: object

    def predicate(self) -> Column:
        c, v = F.col(self.column), self.value
        # a backslash stands for itself; percent and underscore are wild
        plain = str(v).replace("\\", "\\\\")
        like = {"whole word": f"% {plain} %", "contains": f"%{plain}%"}
        if self.operation in like:
            return c.ilike(like[self.operation])
        if self.operation in ("before", "after"):
            moment = F.lit(v).cast("timestamp")
            return c <= moment if self.operation == "before" else c >= moment
        if self.operation in ("=", "equals"):
            return c == v
        if self.operation == "!=":
            return c != v
        if self.operation == "<=":
            return c <= v
        if self.operation == ">=":
            return c >= v
        raise ValueError(f"unknown operation {self.operation!r}")


def all_of(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition.predicate()
    return out


def filter_rows(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    return df.where(all_of(conditions))


def count_filtered(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    return filter_rows(df, conditions).agg(F.count("*").alias("n_rows"))


@dataclass(frozen=True)
class SavedSelection:
    """A named view with its columns and conditions that can be applied again."""

    name: str
    columns: tuple[str, ...]
    conditions: tuple[Condition, ...] = field(default=())

    def apply(self, df: DataFrame) -> DataFrame:
        return filter_rows(df, list(self.conditions)).select(*self.columns)

    def register(self, df: DataFrame) -> DataFrame:
        out = self.apply(df)
        out.createOrReplaceTempView(self.name)
        return out


# ------------------------------------------------------------------ groups


def group_key(column: Column, pattern: str, ignore_case: bool = True) -> Column:
    """First capture of the first match, else the group of all others."""
    regex = spark_regex(pattern, ignore_case=ignore_case, multiline=True)
    key = F.when(column.rlike(regex), F.nullif(F.regexp_extract(column, regex, 1), F.lit("")))
    key = F.coalesce(key, F.lit(OTHER_GROUP))
    return F.lower(key) if ignore_case else key


def group_by_capture(df: DataFrame, id_col: str, column: str, pattern: str, ignore_case: bool = True) -> DataFrame:
    """``(group_key, id)`` in long form; a group is never collected into one value."""
    return df.select(group_key(F.col(column), pattern, ignore_case).alias("group_key"), id_col)


def group_sizes(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("group_key").agg(F.count("*").alias("n_rows")).orderBy(
        F.desc("n_rows"), "group_key"
    )


def rows_of_groups(df: DataFrame, id_col: str, grouped: DataFrame, keys: list[str]) -> DataFrame:
    chosen = grouped.where(F.col("group_key").isin(*keys)).select(id_col)
    return df.join(chosen, id_col, "left_semi")


# ------------------------------------------------------------------ duplicates

KEEP_FIRST = "all but first"
KEEP_LAST = "all but last"
KEEP_SHORTEST = "all but shortest url"
KEEP_LONGEST = "all but longest url"


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that can have a duplicate: a null equals nothing, not even a null."""
    return df.dropna("any", subset=columns)


def _content(columns: list[str]) -> Column:
    """Digest of the compared values, with lengths so that borders cannot shift."""
    parts = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def select_duplicates(
    df: DataFrame, id_col: str, columns: list[str], mode: str = KEEP_FIRST, url: str = "url"
) -> DataFrame:
    """Ids of the rows that can be removed so that one of each group of equals stays.

    The survivor of each group is found by one aggregation with map-side combine, and all
    other rows follow by an anti join on the unique id, so a group that holds a third of all
    rows is never brought together.
    """
    place = {
        KEEP_FIRST: (F.min, [id_col]),
        KEEP_LAST: (F.max, [id_col]),
        KEEP_SHORTEST: (F.min, ["_length", id_col]),
        KEEP_LONGEST: (F.max, ["_length", id_col]),
    }
    best, order = place[mode]
    rows = _complete(df, columns)
    measured = rows.select(
        F.col(id_col),
        _content(columns).alias("_content"),
        (F.length(url) if "_length" in order else F.lit(0)).alias("_length"),
    )
    survivors = measured.groupBy("_content").agg(best(F.struct(*order)).alias("kept")).select(
        F.col(f"kept.{id_col}").alias(id_col)
    )
    return rows.select(id_col).join(survivors, id_col, "left_anti")


def duplicate_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of groups of equal rows and of the rows that could go."""
    groups = (
        _complete(df, columns)
        .groupBy(_content(columns).alias("_content"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
    return groups.agg(
        F.count("*").alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removable_rows"),
    )


# ------------------------------------------------------------------ reductions


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def remove_rows(df: DataFrame, condition: Column) -> DataFrame:
    """A row whose condition is unknown stays."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def remove_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_anti")


def reduce_corpus(sources: DataFrame, texts: DataFrame, removed: DataFrame, view_id: int) -> tuple[DataFrame, DataFrame]:
    """Delete the view's cells of the removed ids, then sources without any cell."""
    doomed = removed.select(F.col("rowid").alias("sourceid"))
    other_views = texts.where(F.col("textualid") != view_id)
    kept = texts.where(F.col("textualid") == view_id).join(doomed, "sourceid", "left_anti")
    cells = kept.unionByName(other_views)
    alive = cells.select(F.col("sourceid").alias("rowid"))
    return sources.join(alive, "rowid", "left_semi"), cells


def drop_columns(
    sources: DataFrame, texts: DataFrame, names: DataFrame, dropped: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop source columns, and text columns with their cells and their names."""
    gone = names.where(F.col("name").isin(*dropped)).select(F.col("id").alias("columnid"))
    return (
        sources.drop(*[c for c in dropped if c in sources.columns]),
        texts.join(gone, "columnid", "left_anti"),  # names are few: AQE makes this a broadcast
        names.where(~F.col("name").isin(*dropped)),
    )


def drop_view(texts: DataFrame, views: DataFrame, view_id: int) -> tuple[DataFrame, DataFrame]:
    return texts.where(F.col("textualid") != view_id), views.where(F.col("id") != view_id)


CELL_KEY = ["sourceid", "textualid", "columnid"]


def upsert_cells(texts: DataFrame, entered: DataFrame, overwrite: bool = True) -> DataFrame:
    """Insert or replace on (source, view, column); among new cells the last ``seq`` wins.

    Without ``overwrite`` an existing cell stays.
    """
    value = [c for c in texts.columns if c not in CELL_KEY]
    last = entered.groupBy(*CELL_KEY).agg(
        F.max_by(F.struct(*value), "seq").alias("v")
    ).select(*CELL_KEY, "v.*")
    if overwrite:
        return texts.join(last.select(*CELL_KEY), CELL_KEY, "left_anti").unionByName(last)
    return texts.unionByName(last.join(texts.select(*CELL_KEY), CELL_KEY, "left_anti"))


def repair_schema(old: DataFrame, current: DataFrame) -> DataFrame:
    """The old rows with all current columns, missing ones as nulls, in current order."""
    empty = current.where(F.lit(False))
    return empty.unionByName(old, allowMissingColumns=True).select(*current.columns)


# ------------------------------------------------------------------ statistics and look-up


def recompute_stats(view: DataFrame, column: str, todo: DataFrame, done: DataFrame) -> DataFrame:
    """One row: pages, characters, sentences, links to do and done."""
    return view.agg(
        F.count("*").alias("nb_pages"),
        F.sum(f"{column}_nb_characters").alias("nb_characters"),
        F.sum(f"{column}_nb_sentences").alias("nb_sentences"),
    ).select(
        "*",
        todo.select(F.count("*")).scalar().alias("nb_links_todo"),
        done.select(F.count("*")).scalar().alias("nb_links_done"),
    )


def next_source(df: DataFrame, id_col: str, current: int) -> DataFrame:
    return df.where(F.col(id_col) > current).orderBy(id_col).limit(1)


def prev_source(df: DataFrame, id_col: str, current: int) -> DataFrame:
    return df.where(F.col(id_col) < current).orderBy(F.desc(id_col)).limit(1)


def source_by_url(df: DataFrame, url: str, column: str = "url") -> DataFrame:
    return df.where(F.col(column) == url)


def source_by_id(df: DataFrame, id_col: str, value: int) -> DataFrame:
    return df.where(F.col(id_col) == value)


def sample_prefix(df: DataFrame, id_col: str, column: str, n_chars: int) -> DataFrame:
    """Texts in order, joined until at least ``n_chars`` characters are there.

    Every non-empty text has a character, so the first ``n_chars`` of them suffice: they are
    chosen by their lengths, and only the texts that are needed are fetched.
    """
    first = (
        df.where(F.length(column) > 0).select(id_col, F.length(column).alias("_n")).orderBy(id_col).limit(n_chars)
    )
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    chosen = first.withColumn("_before", before).where(F.col("_before") < n_chars).select(id_col)
    return df.select(id_col, F.col(column).alias("_t")).join(chosen, id_col, "left_semi").where(F.length("_t") > 0).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(id_col, "_t"))), lambda s: s["_t"]), ""
        ).alias("sample")
    )


def preview_rows(df: DataFrame, limit: int = 200) -> DataFrame:
    """Display form: long texts cut in the middle, epoch seconds as a date, URLs whole."""
    shown: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name == "time" and kind != "timestamp":
            c = F.from_unixtime(c.cast("long"))
        elif kind == "string" and name != "url":
            c = preview(c, limit)
        shown.append(c.alias(name))
    return df.select(*shown)
