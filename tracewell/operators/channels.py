"""Sequence analytics of frames by channel, and recording boundaries.

A channel may hold most frames, so nothing is windowed over a whole channel; see `ordered`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytesx import label
from . import frames as frames_
from . import ordered


def with_anomalies(frames: DataFrame, block: int = ordered.BLOCK) -> DataFrame:
    """frames (channel, offset, ts, frame_number, ...) with flags backwards, gap and reset.

    backwards: ts lies before the last non-null ts earlier in the channel. reset: the number is below the one
    before; gap: above it by more than 1. Null numbers and times are passed over.
    """
    f = ordered.blocked(frames, "offset", block)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("offset", c)))[c]
    joined = ordered.handed_on(f, ["channel"], {"__ts": last("ts"), "__n": last("frame_number")}, "last")
    inside = Window.partitionBy("channel", "__block").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    ts = F.coalesce(F.last("ts", True).over(inside), F.col("__ts"))
    number = F.coalesce(F.last("frame_number", True).over(inside), F.col("__n"))
    out = joined.withColumns({"__ts0": ts, "__n0": number})
    flag = lambda x: F.coalesce(x, F.lit(False))
    return out.withColumns({"backwards": flag(F.col("ts") < F.col("__ts0")), "reset": flag(F.col("frame_number") < F.col("__n0")), "gap": flag(F.col("frame_number") > F.col("__n0") + 1)}).drop("__block", "__ts", "__n", "__ts0", "__n0")


def channel_stats(frames: DataFrame, block: int = ordered.BLOCK) -> DataFrame:
    """A row per channel: counts, sums, first and last time in physical order, anomalies, status REVIEW or UNKNOWN."""
    f = with_anomalies(frames, block)
    at = lambda agg: agg(F.when(F.col("ts").isNotNull(), F.struct("offset", "ts")))["ts"]
    stats = f.groupBy("channel").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("size").alias("total_bytes"), at(F.min).alias("first_timestamp"), at(F.max).alias("last_timestamp"),
        F.countDistinct("frame_type").alias("frame_types"), F.count_if("backwards").alias("timestamp_backwards"), F.count_if("gap").alias("sequence_gaps"), F.count_if("reset").alias("sequence_resets"))
    return stats.withColumn("status", F.when((F.col("timestamp_backwards") + F.col("sequence_gaps") + F.col("sequence_resets")) > 0, "REVIEW").otherwise("UNKNOWN"))


def media_stats(frames: DataFrame) -> DataFrame:
    """A row per channel of carved frames: what is valid, what a demultiplexer writes, codecs, sizes and rates met, conflicts, extension faults and extent.

    A codec conflict is a frame whose extension and payload name different codecs. Sets are sorted; zeros aren't values.
    """
    size = (F.col("length") - frames_.HEADER - F.col("extension_length") - frames_.TAIL).cast("bigint")  # of the payload, which may be left out
    video = F.col("codec").isNotNull() & (size > 0)
    sorted_set = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    return frames.groupBy("channel").agg(
        F.count_if("valid").alias("valid_frames"), F.count_if(video).alias("video_frames"), F.sum("length").alias("native_bytes"), F.coalesce(F.sum(F.when(video, size)), F.lit(0)).alias("elementary_bytes"),
        F.count_if(F.col("declared_codec") != F.col("payload_codec")).alias("codec_conflicts"), F.count_if("truncated").alias("extension_truncated"), sorted_set("codec", "codecs"), sorted_set("declared_codec", "declared_codecs"),
        sorted_set(F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat_ws("x", "width", "height")), "resolutions"), sorted_set("fps", "frame_rates"), sorted_set("unknown_type", "unknown_extension_types"),
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


def type_histogram(frames: DataFrame) -> DataFrame:
    """channel and a map from frame type to count."""
    counts = frames.groupBy("channel", "frame_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("channel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame_type", "n")))).alias("frame_types"))


def boundaries(starts: DataFrame, date: str) -> DataFrame:
    """Recordings of one day by hour and minute: label, least time, sorted starts. starts: start, ts."""
    day = starts.where(F.to_date("ts") == F.lit(date).cast("date"))
    return day.groupBy(F.hour("ts").alias("hour"), F.minute("ts").alias("minute")).agg(F.min("ts").alias("ts"), F.array_sort(F.collect_set("start")).alias("starts")).select(label("ts").alias("label"), "ts", "starts")
