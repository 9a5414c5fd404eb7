"""Statistics and display forms of single text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SENTENCE_SPLIT, spark_regex


def sentence_breaks(text: Column) -> Column:
    """Number of matches of the sentence splitter in the whole text."""
    return F.regexp_count(text, F.lit(spark_regex(SENTENCE_SPLIT)))


def sentences_by_line(text: Column) -> Column:
    """Each line counts its sentence breaks, but at least one."""
    return F.aggregate(
        F.split(text, "\n"),
        F.lit(0).cast("long"),
        lambda n, line: n + F.greatest(F.lit(1), sentence_breaks(line)).cast("long"),
    )


def title_sentences(title: Column) -> Column:
    return F.greatest(F.lit(1), sentence_breaks(title))


def is_lingua_continua(text: Column, threshold: float = 0.9) -> Column:
    """Writing without spaces: almost no character is a blank."""
    return F.length(F.replace(text, F.lit(" "), F.lit(""))) / (F.length(text) + 1) > threshold


def field_words(text: Column) -> Column:
    """Characters for writing without spaces, else the pieces between blanks."""
    return F.when(is_lingua_continua(text), F.length(text)).otherwise(
        F.size(F.split(text, spark_regex(r"\s+")))
    )


def preview(text: Column, limit: int = 200) -> Column:
    """First and last half of a text that is longer than ``limit``."""
    half = limit // 2
    return F.when(
        F.length(text) > limit,
        F.concat(F.left(text, F.lit(half)), F.lit("\n ... \n"), F.right(text, F.lit(half))),
    ).otherwise(text)


def escape_tags(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def split_blanks(text: Column) -> Column:
    """The non-empty pieces between runs of white space."""
    trimmed = F.regexp_replace(text, spark_regex(r"^\s+|\s+\z"), "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, spark_regex(r"\s+"))
    )
