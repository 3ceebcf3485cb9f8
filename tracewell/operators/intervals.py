"""Algebra of (source, pos, size, status) intervals: overlaps, gaps, union length, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

#: Statuses of acquisition maps: fixed values.
STATUSES = {"?": "untried", "*": "untrimmed", "/": "unscraped", "-": "bad", "+": "finished"}


def with_reach(blocks: DataFrame, keys: list[str], block: int = ordered.BLOCK) -> DataFrame:
    """blocks (keys, pos, end, ...) with reach: the greatest end of the rows before, by pos, then end."""
    x = ordered.handed_on(ordered.blocked(blocks, "pos", block), keys, {"__reach": F.max("end")}, "max")
    inside = Window.partitionBy(*keys, "__block").orderBy("pos", "end").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("reach", F.greatest(F.max("end").over(inside), "__reach")).drop("__reach")


def merged(blocks: DataFrame, keys: list[str], block: int = ordered.BLOCK) -> DataFrame:
    """Maximal intervals of the union; intervals that touch become one. Blocks: keys, pos, end."""
    x = with_reach(blocks, keys, block).withColumn("__new", F.when(F.col("reach").isNull() | (F.col("pos") > F.col("reach")), F.col("pos")))
    x = ordered.handed_on(x, keys, {"__start": F.max("__new")}, "max")
    inside = Window.partitionBy(*keys, "__block").orderBy("pos", "end").rowsBetween(Window.unboundedPreceding, 0)
    island = F.coalesce(F.last("__new", True).over(inside), F.col("__start"))
    return x.withColumn("__island", island).groupBy(*keys, F.col("__island").alias("pos")).agg(F.max("end").alias("end"))


def overlaps_and_gaps(blocks: DataFrame, block: int = ordered.BLOCK) -> DataFrame:
    """Per source: bytes under more than one block against the running end, and bytes between blocks."""
    x = with_reach(blocks, ["source"], block)
    return x.groupBy("source").agg(
        F.coalesce(F.sum(F.when(F.col("reach") > F.col("pos"), F.least("reach", "end") - F.col("pos"))), F.lit(0)).alias("overlap_bytes"),
        F.coalesce(F.sum(F.when(F.col("pos") > F.col("reach"), F.col("pos") - F.col("reach"))), F.lit(0)).alias("gap_bytes"))


def coverage(blocks: DataFrame, expected: DataFrame, block: int = ordered.BLOCK) -> DataFrame:
    """Per source: covered and finished bytes within the expected range, bytes by status, overlap, and complete.

    blocks: source, pos, size, status; expected: source, expected_start, expected_size (null: unknown). Null complete
    means that there is no expectation.
    """
    b = blocks.withColumn("end", F.col("pos") + F.col("size"))
    limits = expected.withColumn("__stop", F.col("expected_start") + F.col("expected_size"))
    clipped = b.join(limits, "source").withColumns({"pos": F.greatest("pos", F.coalesce("expected_start", "pos")), "end": F.least("end", F.coalesce("__stop", "end"))}).where("end > pos")
    length = lambda df, name: merged(df.select("source", "pos", "end"), ["source"], block).groupBy("source").agg(F.sum(F.col("end") - F.col("pos")).alias(name))
    by_status = b.groupBy("source").agg(*(F.coalesce(F.sum(F.when(F.col("status") == s, F.col("size"))), F.lit(0)).alias(f"{n}_bytes") for s, n in STATUSES.items()))
    out = expected.join(by_status, "source", "left").join(length(clipped, "covered"), "source", "left").join(length(clipped.where("status = '+'"), "finished"), "source", "left").join(overlaps_and_gaps(b, block), "source", "left")
    out = out.fillna(0, ["covered", "finished", "overlap_bytes", "gap_bytes", *(f"{n}_bytes" for n in STATUSES.values())])
    whole = (F.col("covered") == F.col("expected_size")) & (F.col("finished") == F.col("expected_size")) & (F.col("overlap_bytes") == 0)
    return out.withColumn("complete", F.when(F.col("expected_size").isNotNull(), whole))
