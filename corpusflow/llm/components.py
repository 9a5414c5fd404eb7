"""Connected components by alternating stars, for any number of nodes and any diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable, for every node that has an edge.

    Each round hangs every node below its smallest neighbour, first looking up, then looking down,
    so stars remain after a number of rounds that grows with the logarithm of the longest path.
    Each round is cut by a reliable checkpoint. Nothing but two numbers reaches the driver.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = cut(links)
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upper = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = upper.groupBy("u").agg(F.min("v").alias("m"))
        lower = upper.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = cut(lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
