"""A first look at a source: partitions, file systems, samples, signatures, ranked formats, and what to do next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, formats, scan, storage
from ..sources import evidence

#: Signatures looked for: fixed values of public formats.
SIGNATURES = [("dhav", b"DHAV"), ("annexb", b"\0\0\0\1"), ("pack", b"\0\0\1\xba"), ("jpeg", b"\xff\xd8\xff"), ("mp4", b"ftyp")]
HEAD = 1 << 20
MOST = 512 << 20


def triage(spark: SparkSession, path: str, registry: formats.Registry | None = None, limit: int = MOST) -> DataFrame:
    """One row. Only the first `limit` bytes are scanned for signatures and formats; that is the feature, and `scanned` states it."""
    registry = registry or formats.default()
    chunks = evidence.read(spark, [path], chunk=4 << 20, overlap=64, stop=limit)
    head = evidence.read(spark, [path], chunk=HEAD, stop=HEAD).select("source", "data")
    with evidence.Space([path]) as space:
        size = space.size
    gpt = storage.gpt(head)
    parts = storage.mbr(head.withColumn("data", F.substring("data", 1, 512))).where(~F.col("protective")).select(F.lit("MBR").alias("scheme"), "first_lba", "last_lba").unionByName(gpt.select(F.lit("GPT").alias("scheme"), "first_lba", "last_lba"))
    numbered = parts.withColumn("number", F.xxhash64("scheme", "first_lba", "last_lba"))
    systems = storage.filesystems_in(spark, ([path],), numbered).select("base", "filesystem", "confidence")
    hits = scan.hit_stats(scan.signature_hits(chunks, SIGNATURES), min(size, limit))
    listed = lambda df, *cs: df.agg(F.array_sort(F.collect_list(F.struct(*cs))).alias("x"))
    best = registry.report(chunks, space=([path],))
    out = listed(parts, "scheme", "first_lba", "last_lba").withColumnRenamed("x", "partitions")
    out = out.crossJoin(listed(systems, "base", "filesystem", "confidence").withColumnRenamed("x", "filesystems")).crossJoin(listed(hits, "id", "count", "first", "last").withColumnRenamed("x", "signatures"))
    out = out.crossJoin(best.agg(F.first("plugin").alias("plugin"), F.coalesce(F.first("confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(F.first("requires_review"), F.lit(True)).alias("review")))
    out = out.withColumns({"size": F.lit(size), "scanned": F.lit(min(size, limit)), "n_partitions": F.size("partitions")})
    return out.withColumn("recommendations", detect.recommendations("plugin", "confidence", "review", "n_partitions")).drop("n_partitions")
