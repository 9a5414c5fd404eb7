"""Stored pages to text, title, links, statistics and selected fields."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, html, urls
from ..plans.skew import lookup_join


def page_texts(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """Add ``text``, ``title`` and the page statistics to a table of sources."""
    return page_stats(
        pages.withColumn("text", html.html_to_text(html.clean_html(F.col(source)))).withColumn(
            "title", html.page_title(F.col(source), F.col(url))
        )
    )


def page_stats(df: DataFrame) -> DataFrame:
    text, title = F.col("text"), F.col("title")
    return df.select(
        "*",
        F.length(text).cast("long").alias("nb_characters"),
        cells.sentences_by_line(text).cast("long").alias("nb_sentences"),
        F.length(title).cast("long").alias("title_nb_characters"),
        cells.title_sentences(title).cast("long").alias("title_nb_sentences"),
    )


def raw_links(source: Column) -> Column:
    """Every href of an anchor or area tag in page order, cut at ``#`` and decoded.

    Comments, scripts and styles hold no links.
    """
    return F.transform(
        F.regexp_extract_all(F.regexp_replace(source, urls.NO_LINKS, " "), F.lit(urls.ANCHOR), F.lit(0)),
        lambda tag: html.decode_entities(
            F.substring_index(
                F.concat(F.regexp_extract(tag, urls.HREF, 1), F.regexp_extract(tag, urls.HREF, 2)), "#", 1
            )
        ),
    )


def extract_links(pages: DataFrame, id_col: str, url: str = "url", source: str = "html") -> DataFrame:
    """``(id, pos, link)`` in absolute, normal form; duplicates and order are kept."""
    kept = F.filter(
        raw_links(F.col(source)),
        lambda link: ~F.lower(F.trim(link)).rlike("^(javascript|mailto):"),
    )
    # finished inside the array: a later filter on the link stays above the generator
    links = F.transform(
        F.transform(kept, lambda link: urls.resolve(F.col(url), link)), lambda link: urls.normal_form(link)
    )
    return pages.select(F.col(id_col), F.posexplode(links).alias("pos", "link"))


def select_links(
    links: DataFrame,
    id_col: str,
    known: DataFrame,
    restrict: bool = True,
    allow: str | None = None,
    deny: str | None = None,
) -> DataFrame:
    """First occurrence per page of every wanted link that is not in ``known(url)``, unique URLs."""
    wanted = links.where(urls.link_wanted(F.col("link"), restrict, allow, deny))
    first = wanted.groupBy(id_col, "link").agg(F.min("pos").alias("pos"))
    # one row per link says whether it is known; a link that very many pages share,
    # known or not, is answered by the bounded side of the look-up
    marked = (
        first.groupBy("link")
        .agg(F.count("*").alias("n"))
        .join(known.select(F.col("url").alias("link"), F.lit(True).alias("_known")), "link", "left")
        .select("link", "n", F.coalesce("_known", F.lit(False)).alias("is_known"))
    )
    looked_up = lookup_join(first, marked, "link", "is_known", F.col("n"), F.col(id_col))
    return looked_up.where(~F.col("is_known")).select(id_col, "pos", "link")


# ------------------------------------------------------------- fields by selector

# Elements without content and end tag.
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class _Selector(HTMLParser):
    """Outer source of each element that has exactly the wanted tag, id and class."""

    def __init__(self, tag: str | None, id_: str | None, class_: str | None):
        super().__init__(convert_charrefs=False)
        self.wanted = (tag, id_, class_)
        self.open: list[tuple[str, int | None]] = []  # open tags with their slot in found
        self.found: list[list[str]] = []
        self.active: list[int] = []

    def _emit(self, piece: str) -> None:
        for slot in self.active:
            self.found[slot].append(piece)

    def _matches(self, tag: str, attrs: dict[str, str | None]) -> bool:
        want_tag, want_id, want_class = self.wanted
        return (
            (not want_tag or tag == want_tag)
            and (not want_id or attrs.get("id") == want_id)
            and (not want_class or attrs.get("class") == want_class)
        )

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        written = "".join(f' {k}="{escape(v or "", quote=True)}"' for k, v in attrs)
        slot = None
        if self._matches(tag, dict(attrs)):
            slot = len(self.found)
            self.found.append([])
            self.active.append(slot)
        self._emit(f"<{tag}{written}>")
        if tag in VOID_ELEMENTS:
            if slot is not None:
                self.active.remove(slot)
        else:
            self.open.append((tag, slot))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if all(name != tag for name, _ in self.open):
            return
        while self.open:
            name, slot = self.open.pop()
            self._emit(f"</{name}>")
            if slot is not None:
                self.active.remove(slot)
            if name == tag:
                return

    def close(self) -> None:
        super().close()
        while self.open:
            name, slot = self.open.pop()
            self._emit(f"</{name}>")
            if slot is not None:
                self.active.remove(slot)

    def handle_data(self, data: str) -> None:
        self._emit(data)

    def handle_entityref(self, name: str) -> None:
        self._emit(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._emit(f"&#{name};")


def _outer_sources(source: str, tag: str | None, id_: str | None, class_: str | None) -> str:
    parser = _Selector(tag, id_, class_)
    parser.feed(source or "")
    parser.close()
    return "".join("".join(piece) + " " for piece in parser.found)


def extract_field(
    pages: DataFrame,
    name: str,
    tag: str | None = None,
    id: str | None = None,
    class_: str | None = None,
    as_text: bool = True,
    source: str = "html",
) -> DataFrame:
    """Add column ``name``: all elements with the given tag, id and class.

    Without any condition nothing is selected. As text, the elements are cleaned by
    built-in expressions; as source, they are wrapped in an ``html`` element.
    """
    # html.parser has no counterpart among the built-in functions: only the sources that can match go there
    @F.pandas_udf("string")
    def select(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: _outer_sources(s, tag, id, class_) if s else "")

    possible = F.contains(F.lower(F.col(source)), F.lit(f"<{tag.lower()}")) if tag else F.lit(bool(id or class_))
    selected = pages.withColumn("_outer", F.coalesce(select(F.when(possible, F.col(source))), F.lit("")))
    value = (
        html.field_to_text(F.col("_outer"))
        if as_text
        else F.concat(F.lit("<html>\n"), F.col("_outer"), F.lit("\n</html>"))
    )
    return selected.withColumn(name, value).drop("_outer")


def field_stats(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.select(
        "*",
        cells.field_words(c).cast("long").alias(f"{column}_nb_words"),
        cells.sentences_by_line(c).cast("long").alias(f"{column}_nb_sentences"),
    )


def is_source_column(df: DataFrame, column: str, order: str) -> DataFrame:
    """Whether the first non-empty cell starts with an ``html`` tag; one row, or none."""
    return (
        df.where(F.col(column) != "")
        .orderBy(order)
        .limit(1)
        .select(F.startswith(F.col(column), F.lit("<html>")).alias("is_source"))
    )
