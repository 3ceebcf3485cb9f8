"""Streaming counterparts of boundaries and hit statistics; they take streaming and static DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_buckets(frames: DataFrame, late: str | None = None) -> DataFrame:
    """Frames a channel and minute. late: the watermark on ingest time; recorder time may go backwards, which is evidence, not lateness."""
    f = frames.withWatermark("ingested", late) if late else frames
    keys = [F.window("ingested", "1 minute"), "channel"] if late else ["channel", F.date_trunc("minute", "ts").alias("minute")]
    return f.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.sum("size").alias("bytes"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def acquisition_progress(snapshots: DataFrame) -> DataFrame:
    """Bytes by status over all blocks of the newest snapshot of each source; stateless apart from the sums."""
    newest = F.max_by(F.struct("finished", "bad", "total"), "taken")
    return snapshots.groupBy("source").agg(newest.alias("s")).select("source", "s.*")
