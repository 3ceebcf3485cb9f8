"""Elementary streams: NAL units of Annex B and what they tell, probes of media files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytesx import fraction, video_pes

NALS = "key long, h264 map<int,long>, hevc map<int,long>, nals long"


def nal_types(data: bytes, size: int | None = None) -> tuple[dict[int, int], dict[int, int], int]:
    """Counts of NAL types, read as either codec; a start code of four bytes counts once. size: start codes from there on aren't counted."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 4:
        return {}, {}, 0
    at = np.flatnonzero(raw[2:-1] == 1)
    at = at[(raw[at] == 0) & (raw[at + 1] == 0)]
    head = raw[(at if size is None else at[at < size]) + 3]
    head = head[head < 128]
    counts = lambda x: {int(k): int(n) for k, n in zip(*np.unique(x, return_counts=True), strict=True)}
    return counts(head & 31), counts(head >> 1 & 63), len(head)


def ladder(has: Callable[..., Column], nals: Column) -> Column:
    """codec and confidence: full parameter sets with a random access picture first. has: how many NAL units of a codec's types there are."""
    vps, sps, pps, irap, coded = has("hevc", 32), has("hevc", 33), has("hevc", 34), has("hevc", 16, 17, 18, 19, 20, 21), has("hevc", *range(10))
    asps, apps, idr, slices = has("h264", 7), has("h264", 8), has("h264", 5), has("h264", 1)
    as_ = lambda codec, confidence: F.struct(F.lit(codec).alias("codec"), F.lit(confidence).alias("confidence"))
    return (
        F.when((vps > 0) & (sps > 0) & (pps > 0) & (irap > 0), as_("hevc", 0.99))
        .when((asps > 0) & (apps > 0) & (idr > 0), as_("h264", 0.98))
        .when((vps > 0) & (sps > 0) & (pps > 0), as_("hevc", 0.94))
        .when((asps > 0) & (apps > 0), as_("h264", 0.93))
        .when((vps > 0) & (irap + coded > 0), as_("hevc", 0.88))
        .when((asps > 0) & (idr + slices > 0), as_("h264", 0.86))
        .when((idr + slices) > 0, as_("h264", 0.55))
        .when(nals > 0, as_("unknown", 0.30))
        .otherwise(as_("unknown", 0.0))
    )


def classify(rows: DataFrame) -> DataFrame:
    """key, codec and confidence of elementary streams (key, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *nal_types(bytes(d) if d is not None else b"")) for k, d in zip(b["key"], b["data"], strict=True)], columns=["key", "h264", "hevc", "nals"])

    n = rows.select(F.col("key").cast("long"), "data").mapInPandas(run, NALS)
    has = lambda m, *ts: sum((F.coalesce(F.element_at(m, F.lit(t)), F.lit(0)) for t in ts), F.lit(0))
    return n.withColumn("__c", ladder(has, F.col("nals"))).select("key", "nals", "__c.codec", "__c.confidence")


def suffix(codec: str, confidence: str) -> F.Column:
    """The output's suffix: the codec from a confidence of 0.80 on, else .es."""
    return F.when((F.col(confidence) >= 0.80) & F.col(codec).isin("h264", "hevc"), F.concat(F.lit("."), F.col(codec))).otherwise(".es")


def program_stream(rows: DataFrame) -> DataFrame:
    """Per key: pack headers and video PES of MPEG program streams."""
    packs = F.regexp_count(F.decode("data", "ISO-8859-1"), F.lit("\\x00\\x00\\x01\\xBA"))
    return rows.select("key", packs.alias("packs"), video_pes("data").alias("video_pes"))


PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,duration:string>>, format struct<duration:string>"


def probes(rows: DataFrame) -> DataFrame:
    """The first video stream of ffprobe's JSON (key, json); durations of N/A are null."""
    x = rows.withColumn("p", F.from_json("json", PROBE)).withColumn("v", F.try_element_at(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(1)))
    return x.select("key", F.col("v.codec_name").alias("codec"), F.col("v.width").alias("width"), F.col("v.height").alias("height"), fraction("v.avg_frame_rate").alias("fps"), F.coalesce(F.col("v.duration").try_cast("double"), F.col("p.format.duration").try_cast("double")).alias("duration"))
