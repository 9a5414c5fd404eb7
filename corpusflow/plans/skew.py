"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it carries more than 1/HOT_SHARE of the total weight, so
# there can never be more than HOT_SHARE hot keys: the broadcast is bounded
# whatever the size of the data.
HOT_SHARE = 4096


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    value: str,
    weight: Column,
    spread: Column,
    how: str = "inner",
) -> DataFrame:
    """Attach ``dim.value`` to ``facts`` by ``key`` (unique in ``dim``).

    ``weight`` is a column of ``dim`` that is proportional to, or above, the number
    of fact rows of the key. Hot keys are answered by a bounded broadcast; their
    rows are then spread by ``spread`` in the shuffle join that serves all
    other keys, so no reducer receives a hot key.
    """
    weighted = dim.select(key, value, weight.cast("double").alias("_weight"))
    total = weighted.select(F.sum("_weight")).scalar()
    hot = weighted.where(F.col("_weight") * HOT_SHARE > total).select(
        F.col(key).alias("_hot_key"), F.col(value).alias("_hot_value")
    )
    # generated, since the planner would fold a constant and deal the rows out by the key alone
    rest = weighted.select(
        F.col(key).alias("_rest_key"), F.explode(F.array(F.lit(0))).alias("_rest_spread"), F.col(value).alias("_rest_value")
    )
    marked = facts.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_spread", F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(F.abs(F.hash(spread)) + 1)
    )
    joined = marked.join(
        rest,
        (F.col(key) == F.col("_rest_key")) & (F.col("_spread") == F.col("_rest_spread")),
        "left",
    ).withColumn(value, F.coalesce("_hot_value", "_rest_value"))
    if how == "inner":
        joined = joined.where(F.col("_hot_key").isNotNull() | F.col("_rest_key").isNotNull())
    return joined.drop("_hot_key", "_hot_value", "_rest_key", "_rest_value", "_rest_spread", "_spread")
