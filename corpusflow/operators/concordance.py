"""Keyword in context and marking of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import split_blanks
from ..functions.patterns import never_empty, spark_regex
from ..plans.ordered import running_total


def match_pattern(pattern: str, whole_word: bool, ignore_case: bool) -> str:
    body = rf"\b(?:{pattern})\b" if whole_word else f"(?:{pattern})"
    return spark_regex(body, ignore_case=ignore_case, multiline=True)


def _without_first_word(text: Column) -> Column:
    words = split_blanks(text)
    return F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")


def _without_last_word(text: Column) -> Column:
    words = split_blanks(text)
    return F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")


def concordance(
    df: DataFrame,
    id_col: str,
    column: str,
    pattern: str,
    before: int = 100,
    after: int = 100,
    whole_word: bool = True,
    ignore_case: bool = True,
    trim: bool = True,
) -> DataFrame:
    """``(id, pos, left, match, right)`` for every match, ``pos`` from 0 in each text.

    The text is cut into pieces at the matches. A match has a character, so the nearest
    ``2 * before + 1`` pieces hold the whole left context: the work is linear in the text
    and no text is copied per match. With ``trim`` the word that a cut context
    starts or ends with is dropped.
    """
    regex = match_pattern(never_empty(pattern), whole_word, ignore_case)
    text = F.col(column)
    cut = df.where(text.rlike(regex)).select(
        id_col, F.split(text, regex).alias("_seg"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("_mat")
    )
    pieces = F.flatten(
        F.zip_with("_seg", "_mat", lambda s, m: F.when(m.isNull(), F.array(s)).otherwise(F.array(s, m)))
    )

    def near_left(seg: Column, i: Column) -> Column:
        # pieces before match i are numbers 1 .. 2i+1
        count = F.least(2 * i + 1, F.lit(2 * before + 1))
        return F.when(F.length(seg) > before, F.right(seg, F.lit(before + 1))).otherwise(
            F.array_join(F.slice(F.col("_pieces"), 2 * i + 2 - count, count), "")
        )

    def near_right(i: Column) -> Column:
        seg = F.get(F.col("_seg"), i + 1)
        return F.when(F.length(seg) > after, F.left(seg, F.lit(after + 1))).otherwise(
            F.array_join(F.slice(F.col("_pieces"), 2 * i + 3, F.lit(2 * after + 1)), "")
        )

    rows = (
        cut.withColumn("_pieces", pieces)
        .select(
            id_col,
            F.posexplode(
                F.transform(
                    "_mat",
                    lambda m, i: F.struct(
                        m.alias("match"),
                        near_left(F.get(F.col("_seg"), i), i).alias("l"),
                        near_right(i).alias("r"),
                    ),
                )
            ).alias("pos", "k"),
        )
    )
    left, right = F.right(F.col("k.l"), F.lit(before)), F.left(F.col("k.r"), F.lit(after))
    if trim:
        left = F.when(F.length("k.l") > before, _without_first_word(left)).otherwise(left)
        right = F.when(F.length("k.r") >= after, _without_last_word(right)).otherwise(right)
    return rows.select(
        id_col, F.col("pos").cast("long").alias("pos"), left.alias("left"), F.col("k.match").alias("match"), right.alias("right")
    )


def numbered_concordance(df: DataFrame, id_col: str, column: str, pattern: str, **options) -> DataFrame:
    """Concordance with a running number over all texts in the order of their ids."""
    regex = match_pattern(
        never_empty(pattern), options.get("whole_word", True), options.get("ignore_case", True)
    )
    counts = df.where(F.col(column).rlike(regex)).select(
        id_col, F.regexp_count(F.col(column), F.lit(regex)).alias("_n")
    )
    offsets = running_total(counts, [], [id_col], F.col("_n"), "_offset").select(id_col, "_offset")
    return (
        concordance(df, id_col, column, pattern, **options)
        .join(offsets, id_col)
        .withColumn("number", F.col("_offset") + F.col("pos") + 1)
        .drop("_offset")
    )


def mark_matches(
    text: Column, pattern: str, before: str, after: str, whole_word: bool = True, ignore_case: bool = True
) -> Column:
    """Surround every match with markers."""
    regex = match_pattern(never_empty(pattern), whole_word, ignore_case)
    safe = [m.replace("\\", "\\\\").replace("$", r"\$") for m in (before, after)]
    return F.regexp_replace(text, F.lit(regex), F.lit(f"{safe[0]}$0{safe[1]}"))


def highlight(text: Column, word: str) -> Column:
    return mark_matches(text, word, "<span style='color:red'>", "</span>", ignore_case=False)
