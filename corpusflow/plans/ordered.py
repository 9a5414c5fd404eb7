"""Running totals in a given order without sorting a whole group in one task.

A plain ``sum().over(orderBy)`` moves each group to a single task. Here the rows
are range-partitioned on (group, order), so a hot group is cut into many ranges;
the range number is fixed by a checkpoint, each range is summed on its own, and
only one total per (group, range) is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut


def running_total(
    df: DataFrame,
    group: list[str],
    order: list[Column | str],
    value: Column,
    out: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come before.

    ``order`` must be unique within a group. Pass only the columns that are
    needed; the rows are written once to the shared folder.
    """
    spark = df.sparkSession
    if ranges is None:
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut(
        df.withColumn("_value", value.cast("long"))
        .repartitionByRange(ranges, *[F.col(g) for g in group], *order)
        .withColumn("_range", F.spark_partition_id())
    )
    keys = [*group, "_range"]
    between_ranges = Window.partitionBy(*[F.col(g) for g in group]).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        placed.groupBy(*keys)
        .agg(F.sum("_value").alias("_subtotal"))
        .withColumn("_start", F.coalesce(F.sum("_subtotal").over(between_ranges), F.lit(0)))
        .drop("_subtotal")
    )
    within_range = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        placed.withColumn("_local", F.coalesce(F.sum("_value").over(within_range), F.lit(0)))
        .join(starts, keys)
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_start", "_local", "_range", "_value")
    )


def running_rank(
    df: DataFrame, group: list[str], order: list[Column | str], out: str, ranges: int | None = None
) -> DataFrame:
    """1-based position in the group, for groups of any size."""
    return running_total(df, group, order, F.lit(1), "_before", ranges).withColumn(
        out, F.col("_before") + 1
    ).drop("_before")
