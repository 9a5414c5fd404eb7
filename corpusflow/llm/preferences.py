"""Preference pairs for chat models: a prompt rendered once, and two masked completions.

Everything is a row per turn: no conversation is gathered into one task, however long it is, and
all work is done by DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from .common import answer, stored, table

#: Turns are rendered as header, text and end mark; {role} is the turn's role.
HEADER, END_MARK = "<|{role}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _turns(conversations: DataFrame, side: int, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns of one side, with values for nulls: a null turn comes first."""
    return conversations.where(F.col(pair_col).isNotNull()).select(
        F.col(pair_col).cast("long").alias("pair_id"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.lit(side).alias("side"),
    )


def _compared(turns: DataFrame) -> DataFrame:
    """Turns of both sides with their place ``nth`` within the turn, and whether the other side ``differs`` there.

    Repeated rows are one; different rows of one turn stand in the order of role and text. Both sides of a turn
    meet in one task by a single exchange, which serves all windows.
    """
    turn = ["pair_id", "turn"]
    said = F.struct("role", "text")
    equal = Window.partitionBy(*turn, "side", "role", "text").orderBy("pair_id")
    order = Window.partitionBy(*turn, "side").orderBy("role", "text")
    place = Window.partitionBy(*turn, "nth")
    return (
        turns.repartition(*turn)
        .withColumn("_copy", F.row_number().over(equal)).where("_copy = 1")
        .withColumn("nth", F.row_number().over(order))
        .withColumn("differs", (F.count("*").over(place) < 2) | (F.min(said).over(place) != F.max(said).over(place)))
        .drop("_copy")
    )


def rendered(role: Column, text: Column) -> Column:
    before, after = HEADER.split("{role}")
    return F.concat(F.lit(before), role, F.lit(after), text, F.lit(END_MARK))


def preference_segments(
    chosen: DataFrame,
    rejected: DataFrame,
    pair_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = TRAINED_ROLE,
) -> DataFrame:
    """``pair_id, part, turn, nth, role, segment, loss_start, loss_end`` of every pair.

    ``chosen`` and ``rejected`` hold turns under a common pair id. The longest common turn prefix is all
    turns before the first that differs in place, role or text; it is rendered once, as part
    ``prompt``. What follows is rendered for each side, as parts ``chosen`` and ``rejected``. ``loss_start``
    and ``loss_end`` bound the code points of ``segment`` that are trained on: the text and end mark of turns of
    ``trained_role`` in completions; both are 0 where the whole segment is masked.

    A pair id on one side only has an empty other side, hence no common prefix; equal sides
    are all prompt. Null ids belong to no pair. Null roles and texts are empty, null turns come first, rows that
    repeat a turn whole are one. Segments are ordered by ``part, turn, nth``.
    """
    columns = (pair_col, turn_col, role_col, text_col)
    turns = stored(_compared(_turns(chosen, 0, *columns).unionByName(_turns(rejected, 1, *columns))), "turns")
    place = F.struct("turn", "nth")
    first = turns.groupBy("pair_id").agg(F.min(F.when(F.col("differs"), place)).alias("first"), F.count("*").alias("n"))
    # the pair's row is never null, so that equal sides are told from pairs that have no row
    split = lookup_join(
        turns.drop("differs"), stored(first.select("pair_id", F.struct("first").alias("split"), "n"), "splits"),
        "pair_id", "split", F.col("n"), F.hash("turn", "nth"),
    )
    common = F.col("split.first").isNull() | (place < F.col("split.first"))
    rows = split.where(~common | (F.col("side") == 0)).withColumn(
        "part", F.when(common, "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    )
    trained = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    header = F.length("role") + len(HEADER.format(role=""))
    return rows.select(
        "pair_id", "part", F.when(F.col("turn") > -(1 << 62), F.col("turn")).alias("turn"), "nth", "role",
        rendered(F.col("role"), F.col("text")).alias("segment"),
        F.when(trained, header).otherwise(0).alias("loss_start"),
        F.when(trained, header + F.length("text") + len(END_MARK)).otherwise(0).alias("loss_end"),
    )


def assembled(segments: DataFrame) -> DataFrame:
    """``pair_id, prompt, chosen, rejected, chosen_loss, rejected_loss``: one row per pair.

    For conversations that fit in a row. The losses are arrays of spans (start, end) in the completion.
    """
    order = F.sort_array(F.collect_list(F.struct("turn", "nth", "segment", "loss_start", "loss_end")))
    joined = F.array_join(F.transform("s", lambda x: x["segment"]), "")
    spans = F.aggregate(
        "s", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["segment"])).alias("at"),
            F.when(x["loss_end"] > 0, F.array_append(a["found"], F.struct((a["at"] + x["loss_start"]).alias("start"), (a["at"] + x["loss_end"]).alias("end"))))
            .otherwise(a["found"]).alias("found"),
        ),
    )["found"]
    parts = segments.groupBy("pair_id", "part").agg(order.alias("s")).select("pair_id", "part", joined.alias("text"), spans.alias("loss"))
    of = lambda part, col: F.max(F.when(F.col("part") == part, F.col(col)))
    return parts.groupBy("pair_id").agg(
        *[F.coalesce(of(p, "text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")],
        *[
            F.coalesce(F.max_by("loss", F.when(F.col("part") == p, 1)), F.array().cast("array<struct<start:int,end:int>>")).alias(f"{p}_loss")
            for p in ("chosen", "rejected")
        ],
    )


def last_replies(conversations: DataFrame) -> DataFrame:
    """``conv_id, last``: the turn of the last assistant reply of a conversation."""
    return conversations.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max("turn").alias("last"))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Rejected twins: every conversation up to its last reply, which is that of the next conversation.

    Where the next id has no reply the twin has none; a conversation without reply is its own twin.
    """
    last = last_replies(conversations)
    replies = conversations.where(F.col("role") == TRAINED_ROLE).join(last, "conv_id").where(F.col("turn") == F.col("last"))
    other = replies.groupBy((F.col("conv_id") - 1).alias("conv_id")).agg(F.min("text").alias("text"))
    before = conversations.join(last, "conv_id", "left").where(F.col("last").isNull() | (F.col("turn") < F.col("last")))
    swapped = last.join(other, "conv_id").select("conv_id", F.col("last").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), "text")
    return before.select("conv_id", "turn", "role", "text").unionByName(swapped)


@answer(
    r"""WITH conv AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS last FROM conv WHERE role = 'assistant' GROUP BY ALL),
other AS (SELECT conv_id - 1 AS conv_id, min(text) AS text FROM conv JOIN last USING (conv_id) WHERE role = 'assistant' AND turn = last GROUP BY 1),
twin AS (SELECT conv_id, turn, role, text FROM conv LEFT JOIN last USING (conv_id) WHERE last IS NULL OR turn < last
  UNION ALL SELECT conv_id, last, 'assistant', text FROM last JOIN other USING (conv_id)),
met AS (SELECT coalesce(c.conv_id, r.conv_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.role AS crole, c.text AS ctext, r.role AS rrole, r.text AS rtext
  FROM conv c FULL JOIN twin r ON c.conv_id = r.conv_id AND c.turn = r.turn),
split AS (SELECT *, min(CASE WHEN crole IS DISTINCT FROM rrole OR ctext IS DISTINCT FROM rtext THEN turn END) OVER (PARTITION BY pair_id) AS first FROM met),
parts AS (SELECT pair_id, turn, 'prompt' AS part, crole AS role, ctext AS text FROM split WHERE first IS NULL OR turn < first
  UNION ALL SELECT pair_id, turn, 'chosen', crole, ctext FROM split WHERE turn >= first AND crole IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'rejected', rrole, rtext FROM split WHERE turn >= first AND rrole IS NOT NULL)
SELECT pair_id, part, turn, 1 AS nth, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS loss_start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 + length(text) + 8 ELSE 0 END AS loss_end
FROM parts"""
)
def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its twin with another last reply."""
    conversations = table(spark, sf_dir, "conversations")
    return preference_segments(conversations, swapped_replies(conversations))
