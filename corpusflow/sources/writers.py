"""Exports: combined text and HTML, one file per page, tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import escape_tags
from ..operators.concordance import mark_matches
from ..plans.checkpoints import cut
from ..plans.ordered import running_rank

# Default separators and the marks that are replaced in them.
PAGE_BEFORE = '<page name="page" id="iii" url="uuu" time="ttt" group="ggg">'
PAGE_AFTER = "</page>"
PAGE_HTML_BEFORE = '<div name="page" id="iii" url="uuu" time="ttt" group="ggg">'
PAGE_HTML_AFTER = "</div>"
GROUP_BEFORE = '<group name="ggg">'
GROUP_AFTER = "</group>"
SLASHES_INTO = "---"
CLASH_SUFFIX = "__1"
NAME_LIMIT = 255
NAME_CUT = 247
NAME_CUT_END = "-ETC.txt"


def _filled(template: str, id_col: Column, url: Column, time: Column, group: Column | None) -> Column:
    out = F.replace(F.lit(template), F.lit("iii"), id_col.cast("string"))
    out = F.replace(out, F.lit("uuu"), url)
    out = F.replace(out, F.lit("ttt"), time)
    if group is None:
        return F.replace(out, F.lit('group="ggg"'), F.lit(""))
    return F.replace(out, F.lit("ggg"), group)


def export_text(
    df: DataFrame,
    id_col: str,
    url: str,
    time: str,
    columns: list[str],
    group: str | None = None,
    with_names: bool = True,
    before: str = PAGE_BEFORE,
    after: str = PAGE_AFTER,
) -> DataFrame:
    """``(id, [group], page)``: the text of each page as it stands in the combined file."""
    shown = F.date_format(time, "yyyy-MM-dd HH:mm:ss")
    parts: list[Column] = []
    for c in columns:
        piece = F.concat(shown if c == time else F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))
        parts.append(F.concat(F.lit(f"<{c}>\n"), piece, F.lit(f"\n</{c}>\n")) if with_names else piece)
    g = F.col(group) if group else None
    page = F.concat(_filled(before + "\n", F.col(id_col), F.col(url), shown, g), *parts, F.lit(after + "\n\n"))
    return df.select(id_col, *([F.col(group).alias("group_key")] if group else []), page.alias("page"))


def column_colours(n: int) -> list[str]:
    """Evenly spread colours, the last column black."""
    step = (256**3 - 2_000_000) / n
    colours = [f"{int(i * step):06x}" for i in range(1, n + 1)]
    return [*colours[:-1], "000"]


def export_html(
    df: DataFrame,
    id_col: str,
    url: str,
    time: str,
    columns: list[str],
    group: str | None = None,
    match: str | None = None,
    match_before: str = "<span class='match'>",
    match_after: str = "</span>",
) -> DataFrame:
    """``(id, [group], page)``: escaped, marked pages with a colour per column."""
    shown = F.date_format(time, "yyyy-MM-dd HH:mm:ss")
    parts: list[Column] = []
    for c, colour in zip(columns, column_colours(len(columns))):
        piece = shown if c == time else escape_tags(F.coalesce(F.col(c).cast("string"), F.lit("")))
        if match:
            piece = mark_matches(piece, match, match_before, match_after)
        piece = F.replace(piece, F.lit("\n"), F.lit("<br/>"))
        parts.append(F.concat(F.lit(f"<div name='{c}' style='color: #{colour};'>\n"), piece, F.lit("\n</div>\n")))
    g = F.col(group) if group else None
    page = F.concat(
        _filled(PAGE_HTML_BEFORE, F.col(id_col), F.col(url), shown, g), *parts, F.lit(PAGE_HTML_AFTER + "\n")
    )
    return df.select(id_col, *([F.col(group).alias("group_key")] if group else []), page.alias("page"))


def html_frame(template: str, name: str, info: str, date: str, direction: str) -> tuple[str, str]:
    """Head and foot of an HTML export from a template with ``%corpus%`` in it."""
    filled = template
    for mark, value in (("%name%", name), ("%info%", info), ("%date%", date), ("%dir%", direction)):
        filled = filled.replace(mark, value)
    head, _, foot = filled.partition("%corpus%")
    return head, foot


def with_group_lines(pages: DataFrame, id_col: str, before: str = GROUP_BEFORE, after: str = GROUP_AFTER) -> DataFrame:
    """Pages ``(id, group_key, page)`` with one opening and one closing line per group.

    ``rank`` is 0, 1 or 2; the export order is (group_key, rank, id).
    """
    groups = pages.select("group_key").distinct()
    opening = groups.select(
        F.lit(None).cast(pages.schema[id_col].dataType).alias(id_col), "group_key",
        F.replace(F.lit(before + "\n"), F.lit("ggg"), F.col("group_key")).alias("page"), F.lit(0).alias("rank"),
    )
    closing = opening.withColumn("page", F.lit(after + "\n\n")).withColumn("rank", F.lit(2))
    return pages.withColumn("rank", F.lit(1)).unionByName(opening).unionByName(closing)


def with_frame(pages: DataFrame, id_col: str, head: str, foot: str) -> DataFrame:
    """Pages with group lines, with the head of the export as rank -1 and its foot as rank 3.

    The export order is (rank is -1 first, rank is 3 last, group_key, rank, id), see ``FRAMED_ORDER``.
    """
    ends = pages.sparkSession.createDataFrame([(head, -1), (foot, 3)], "page string, rank int")
    return pages.unionByName(ends, allowMissingColumns=True)


#: Order of a framed export, but for the id.
FRAMED_ORDER = ["CASE rank WHEN -1 THEN -1 WHEN 3 THEN 1 ELSE 0 END", "group_key", "rank"]


def write_combined(pages: DataFrame, order: list[str], path: str) -> None:
    """Text files whose concatenation in name order is the export, written in parallel.

    Every page ends with a newline; the last one of each is written by the text format.
    """
    lines = pages.orderBy(*order).select(F.regexp_replace("page", r"\n\z", "").alias("page"))
    lines.write.text(path)


def export_sources(sources: DataFrame, view: DataFrame, id_col: str, url: str = "url", source: str = "source") -> DataFrame:
    """``(id, page)`` of the sources of the pages in the view."""
    kept = sources.join(view.select(url), url, "left_semi")
    return kept.select(
        id_col, F.concat(F.col(url), F.lit("<hr>\n"), F.col(source), F.lit("<hr>\n\n")).alias("page")
    )


# ------------------------------------------------------------------ one file per page


def file_names(df: DataFrame, id_col: str, url: str | None = None, overwrite: bool = False) -> DataFrame:
    """``(id, file_name)``: the number of the row, or its URL after ``//`` with dashes for slashes.

    Unless files may be overwritten, the k-th row of an equal name gets the suffix k-1
    times. Names that are too long are cut and numbered.
    """
    if url is None:
        named = running_rank(df.select(id_col), [], [id_col], "_no").select(
            id_col, F.col("_no").cast("string").alias("name")
        )
    else:
        rest = F.get(F.split(F.col(url), "//"), 1)
        named = df.select(
            id_col, F.replace(F.coalesce(rest, F.col(url)), F.lit("/"), F.lit(SLASHES_INTO)).alias("name")
        )
    if not overwrite:
        named = running_rank(named, ["name"], [id_col], "_k").select(
            id_col, F.concat("name", F.repeat(F.lit(CLASH_SUFFIX), (F.col("_k") - 1).cast("int"))).alias("name")
        )
    full = named.select(id_col, F.concat("name", F.lit(".txt")).alias("file_name"))
    long = F.length("file_name") > NAME_LIMIT
    shortened = full.where(long).select(id_col, F.concat(F.left("file_name", F.lit(NAME_CUT)), F.lit(NAME_CUT_END)).alias("file_name"))
    shortened = running_rank(shortened, ["file_name"], [id_col], "_k")
    number = (F.col("_k") - 1).cast("string")
    renamed = shortened.select(
        id_col,
        F.when(F.col("_k") == 1, F.col("file_name"))
        .otherwise(F.concat(F.left("file_name", F.length("file_name") - F.length(number)), number))
        .alias("file_name"),
    )
    given = full.where(~long).unionByName(renamed)
    return given if overwrite else _apart(given, id_col)


def _apart(names: DataFrame, id_col: str) -> DataFrame:
    """New names may meet others: those that do are changed again until none does."""
    turn = 0
    while True:
        ranked = running_rank(names, ["file_name"], [id_col], "_k")
        names = cut(ranked.select(id_col, "file_name", "_k"))
        if names.where("_k > 1").isEmpty():
            return names.drop("_k")
        turn += 1
        stem = F.expr("left(file_name, length(file_name) - 4)")
        suffixed = F.concat(stem, F.repeat(F.lit(CLASH_SUFFIX), (F.col("_k") - 1).cast("int")), F.lit(".txt"))
        number = (F.col("_k") - 1 + 1000 * turn).cast("string")
        numbered = F.concat(F.left(stem, F.length(stem) - F.length(number)), number, F.lit(".txt"))
        again = F.when(F.length(suffixed) <= NAME_LIMIT, suffixed).otherwise(numbered)
        names = names.select(id_col, F.when(F.col("_k") == 1, F.col("file_name")).otherwise(again).alias("file_name"))


def file_contents(df: DataFrame, id_col: str, columns: list[str], layout: str = "plain") -> DataFrame:
    """``(id, content)`` in the layout plain, ``column:`` or ``<column>``."""
    heads = {"plain": "", "colon": "{}:\n", "angle": "<{}>\n"}
    if layout not in heads:
        raise ValueError(f"unknown layout {layout!r}")
    parts = [
        F.concat(F.lit(heads[layout].format(c)), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))
        for c in columns
    ]
    return df.select(id_col, F.concat(*parts).alias("content"))


def write_files(named: DataFrame, folder: str) -> DataFrame:
    """Write ``(file_name, content)`` rows as files of exactly these names, from the tasks.

    ``folder`` is a URI that every executor can reach. Each file is written under a name of
    its own attempt and then renamed, so a repeated task leaves the same files.
    Gives ``(file_name, n_chars)`` when run. Equal names are refused: one file would replace another.
    """
    if not named.groupBy("file_name").count().where("count > 1").isEmpty():
        raise ValueError("two rows have the same file name")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        target, base = pafs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch["file_name"], batch["content"]):
                partial = f"{base}/.{uuid.uuid4().hex}"
                with target.open_output_stream(partial) as out:
                    out.write(content.encode("utf-8"))
                target.move(partial, f"{base}/{name}")
            yield pd.DataFrame({"file_name": batch["file_name"], "n_chars": batch["content"].str.len()})

    return named.select("file_name", "content").mapInPandas(write, "file_name string, n_chars long")


# ------------------------------------------------------------------ tables


def table_cells(df: DataFrame) -> DataFrame:
    """Newlines and tabs in text become visible signs, so that a row stays one line."""
    return df.select(
        *[
            F.translate(F.col(c), "\n\t", "↩⇥").alias(c) if kind == "string" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def save_table(df: DataFrame, path: str) -> None:
    table_cells(df).write.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
