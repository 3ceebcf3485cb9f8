"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root, the least node of its component, of every node in edges (a long, b long).

    Alternating large-star and small-star steps; the edge table is written after each pair of steps, which
    cuts the lineage. Stops when a pair of steps changes nothing.
    """

    def stars(e: DataFrame, small: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if small:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a")
        if small:
            # neighbours go to the least, and so does the node itself
            return out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most):
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state is not None and tuple(after) == state:
            break
        state = tuple(after)
        if not state[0]:
            break
        now = stored(stars(stars(now, False), True), "edges")
    else:
        raise RuntimeError("components didn't settle")
    roots = now.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
