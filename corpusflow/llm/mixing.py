"""Mixing sources by temperature, up to an entropy or a limit of repetition, laid out in budgeted blocks.

Each source's share of tokens is raised to an exponent between 0 (all sources equal) and 1 (as they are)
and normalised. The exponent is bisected to meet the target. The mixture is then written as blocks that
each hold every source's weight of the block's budget, in a random order within.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import running_total
from ..plans.skew import lookup_join
from .common import answer, stored, table, text_of, unused

#: Rounds of bisection: the exponent is exact to 2^-40.
ROUNDS = 40
#: Points of one round that are evaluated in one pass: five bisections at a time.
POINTS = 32
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 1 << 20


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, tokens``: words between white space; rows that repeat an id are one unit.

    A unit has the smallest of its sources; a null source is a source of its own, with a null name.
    Rows without id are left out.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("tokens"),
    )
    return rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens"))


def _statistics(exponent: Column) -> tuple[Column, Column]:
    """Sums over sources for one exponent, with shares relative to the largest: stable for any counts."""
    mass = F.exp(exponent * F.col("log_share"))
    return F.sum(mass), F.sum(mass * exponent * F.col("log_share"))


def exponent_for(
    sources: DataFrame, repetition_limit: float | None = None, target_entropy: float | None = None
) -> float:
    """The largest exponent that meets the target, by bisection; ``sources`` has ``source, tokens``.

    ``repetition_limit``: the smallest source is read at most that often while the largest is read once;
    the smallest exponent that keeps the limit. ``target_entropy``: the entropy of the weights, in nats, is at
    least that; if even equal weights fall short, the exponent is 0. Sources without tokens don't count.
    The sources stay where they are: each pass brings a fixed number of sums to the driver.
    """
    if (repetition_limit is None) == (target_entropy is None):
        raise ValueError("give one of repetition_limit and target_entropy")
    logs = sources.where("tokens > 0").select(F.log("tokens").alias("log_tokens"))
    largest, smallest = logs.agg(F.max("log_tokens"), F.min("log_tokens")).first()
    if largest is None or largest == smallest:
        return 1.0
    logs = logs.select((F.col("log_tokens") - largest).alias("log_share"))
    low, high = 0.0, 1.0
    for _ in range(-(-ROUNDS // 5)):
        points = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        if repetition_limit is not None:
            # repeats of the smallest source: (largest / smallest) ^ (1 - exponent)
            right = [exp((largest - smallest) * (1 - p)) <= repetition_limit for p in points]
            index = next((i for i, ok in enumerate(right) if ok), POINTS)
        else:
            sums = logs.agg(*[c for p in points for c in _statistics(F.lit(p))]).first()
            entropy = [log(sums[2 * i]) - sums[2 * i + 1] / sums[2 * i] for i in range(POINTS + 1)]
            # entropy falls as the exponent grows
            index = min(POINTS, max((i for i, e in enumerate(entropy) if e >= target_entropy), default=-1) + 1)
        low, high = points[max(0, index - 1)], points[index]
        if low == high:
            break
    return high if repetition_limit is not None else low


def mixture(sources: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """``source, tokens, weight, repeats``: weights sum to one; repeats is how often a source is read.

    Without a ``budget`` of tokens the smallest one is taken that reads every source at least once.
    A source without tokens has weight 0 and is read once.
    """
    logs = sources.withColumn("_log", F.when(F.col("tokens") > 0, F.log("tokens")))
    largest = logs.agg(F.max("_log")).first()[0] or 0.0
    mass = F.when(F.col("tokens") > 0, F.exp(exponent * (F.col("_log") - largest))).otherwise(0.0)
    logs = logs.withColumn("_mass", mass)
    total = logs.agg(F.sum("_mass")).first()[0] or 1.0
    weighed = logs.withColumn("weight", F.col("_mass") / total)
    if budget is None:
        # the largest source once, the others relative to it
        repeats = F.exp((exponent - 1) * (F.col("_log") - largest))
    else:
        repeats = F.col("weight") * budget / F.col("tokens")
    return weighed.select(*sources.columns, "weight", F.when(F.col("tokens") > 0, repeats).otherwise(1.0).alias("repeats"))


def mix(
    docs: DataFrame,
    repetition_limit: float | None = 2.0,
    target_entropy: float | None = None,
    budget: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 42,
    **columns: str,
) -> DataFrame:
    """``doc_id, source, tokens, weight, copy, block, place``: one row for each reading of a unit.

    Within a source, units stand in an order by hash, on a circle of the source's tokens. Reading goes
    round until the source's budget is spent: whole rounds read every unit, the last one those whose first
    token is within the rest. The reading's place in the stream, as a share of the source's budget, gives
    its block; ``place`` orders a block by hash. Every block holds each source's weight of the
    block's tokens, up to one unit. A unit without tokens stands where its order puts it.
    """
    # a name that is never null, so that the null source joins like any other
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name")
    units = stored(token_counts(docs, **columns).select("doc_id", named, "tokens"), "units")
    sources = stored(units.groupBy(F.col("name").alias("source")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("units")), "sources")
    plan = stored(mixture(sources, exponent_for(sources, repetition_limit, target_entropy), budget), "plan")
    turned = F.xxhash64(F.lit(seed), "doc_id")
    placed = running_total(units.withColumn("turn", turned), ["name"], ["turn", "doc_id"], F.col("tokens"), "before")
    total = plan.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] or 0.0
    blocks = max(1, -(-int(total) // block_tokens))
    facts = placed.select("doc_id", "name", F.col("tokens").alias("own"), "before")
    dim = plan.select(F.col("source").alias("name"), F.struct("tokens", "weight", "repeats").alias("m"), "units")
    read = lookup_join(facts, dim, "name", "m", F.col("units"), F.col("doc_id"), "left")
    whole = F.floor("m.repeats")
    rest = F.col("m.repeats") - whole
    copies = whole + F.when(F.col("before") < rest * F.col("m.tokens"), 1).otherwise(0)
    stream = (F.col("copy") * F.col("m.tokens") + F.col("before")) / F.greatest(F.lit(1.0), F.col("m.tokens") * F.col("m.repeats"))
    return (
        read.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)))
        .select(
            "doc_id", F.expr("CASE WHEN name = '' THEN NULL ELSE substring(name, 2) END").alias("source"), F.col("own").alias("tokens"),
            F.col("m.weight").alias("weight"), "copy", F.least(F.floor(stream * blocks), F.lit(blocks - 1)).cast("long").alias("block"),
            F.xxhash64(F.lit(seed), "copy", "doc_id").alias("place"),
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mixture reads it; rows without id once."""
    unit, times, copy = (unused(docs, n) for n in ("unit", "times", "copy"))
    readings = mix(docs, id_col=id_col, **settings).groupBy(F.col("doc_id").alias(unit)).agg(F.count("*").cast("int").alias(times))
    joined = docs.join(readings, docs[id_col].cast("long") == readings[unit], "left")
    read = joined.where(F.col(times).isNotNull() | docs[id_col].isNull())
    return read.withColumn(copy, F.explode(F.sequence(F.lit(1), F.coalesce(times, F.lit(1))))).drop(unit, times, copy)


@answer()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
