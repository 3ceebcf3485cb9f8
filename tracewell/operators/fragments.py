"""Continuations between fragments: range joins of open states with later fragments, and alignment scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR, FAR, TOP = 32, 4096, 6


def _band(states: DataFrame, fragments: DataFrame, low: int, high: int, keys: list[str]) -> DataFrame:
    """Fragments with low < fragment - current <= high, by an equi-join on bins of the band's width."""
    width = max(1, high - low)
    s = states.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("current") + low + 1) / width), F.floor((F.col("current") + high) / width))))
    f = fragments.withColumn("__bin", F.floor(F.col("fragment") / width))
    gap = F.col("fragment") - F.col("current")
    return s.join(f, ["__bin", *keys]).where((gap > low) & (gap <= high)).drop("__bin")


def candidates(states: DataFrame, fragments: DataFrame, used: DataFrame | None = None, near: int = NEAR, far: int = FAR, top: int = TOP, keys: list[str] | None = None) -> DataFrame:
    """The `top` continuations of each state: those near, and only without any those up to far.

    states: current and keys; fragments: fragment, terminal and keys, on which both must agree; used: fragment.
    The score is the gap, less 0.25 for a fragment that ends the recording.
    """
    keys = keys or []
    free = fragments.join(used, "fragment", "left_anti") if used is not None else fragments
    close = _band(states, free, 0, near, keys)
    lone = states.join(close.select("current").distinct(), "current", "left_anti")
    both = close.withColumn("band", F.lit("near")).unionByName(_band(lone, free, near, far, keys).withColumn("band", F.lit("far")))
    scored = both.withColumn("score", F.col("fragment") - F.col("current") - F.when(F.col("terminal"), 0.25).otherwise(0.0))
    rank = F.row_number().over(Window.partitionBy("current").orderBy("score", "fragment"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def alignment(probes: DataFrame, fragment: int, top: int = 8) -> DataFrame:
    """Hypotheses of where fragments begin: per residue of offset, valid * 2 + timestamped * 8 + padding * 0.5.

    probes: offset, valid, timestamped, padding. Confidence: share of the two best scores, times evidence (six
    timestamps are enough), times the score over the best.
    """
    sums = probes.groupBy(F.pmod("offset", F.lit(fragment)).alias("residue")).agg(*(F.count_if(c).alias(c) for c in ("valid", "timestamped", "padding")))
    scored = sums.withColumn("score", F.col("valid") * 2 + F.col("timestamped") * 8 + F.col("padding") * 0.5).where("score > 0")
    best = scored.orderBy(F.desc("score"), F.desc("timestamped"), F.desc("valid"), "residue").limit(max(2, top))
    order = Window.orderBy(F.desc("score"), F.desc("timestamped"), F.desc("valid"), "residue")
    rows = best.withColumns({"rank": F.row_number().over(order), "__best": F.first("score").over(order), "__next": F.nth_value("score", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    dominance = F.col("__best") / (F.col("__best") + F.coalesce("__next", F.lit(0.0)))
    confidence = dominance * F.least(F.lit(1.0), F.col("timestamped") / 6.0) * (F.col("score") / F.col("__best"))
    return rows.where(F.col("rank") <= top).withColumn("confidence", F.bround(confidence, 6)).drop("__best", "__next")
