"""Channels of a byte space as files: the frames as they are, and the elementary stream of each codec.

Frames are found once, without their bytes. Where each goes in its files is a sum over the frames before it, and then
fragments of the files are read and written by as many tasks as there are, whatever channel they are of.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from ..sources import evidence, sinks
from ..sources.evidence import Space
from ..sources.payloads import SCHEMA, PayloadFiles, batched
from . import channels, frames, integrity, ordered

#: Type of frames whose payload is video.
VIDEO = 0xFD


def plan(found: DataFrame) -> DataFrame:
    """name, at, place, size: which bytes of the space each frame (carve, of one source) gives to which files, and where there."""
    name = F.format_string("channel-%02d.", F.col("channel"))
    native = found.select("offset", F.concat(name, F.lit("native.dhav")).alias("name"), F.col("offset").alias("place"), F.col("length").alias("size"))
    payload = F.col("length") - frames.HEADER - F.col("extension_length") - frames.TAIL
    video = found.where((F.col("frame_type") == VIDEO) & F.col("codec").isNotNull() & (payload > 0))
    stream = video.select("offset", F.concat(name, "codec").alias("name"), (F.col("offset") + frames.HEADER + F.col("extension_length")).alias("place"), payload.alias("size"))
    return ordered.scanned(native.unionByName(stream), ["name"], ["offset"], ["size"]).select("name", F.col("before_size").alias("at"), "place", "size")


def pieces(planned: DataFrame, space: tuple, per_task: int = 256 << 20) -> DataFrame:
    """name, at, data of a plan, dealt frame by frame before any byte is read; frames that touch in a file are one row."""
    n, size = planned.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, 2 * planned.sparkSession.sparkContext.defaultParallelism), size // per_task)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Space(*space) as s:
            rows = ((name, at, s.read(place, n)) for b in batches for name, at, place, n in b.itertuples(index=False))
            for some in batched(rows):
                yield some.rename(columns={"key": "name"})

    # neighbours in a file stay together
    return planned.repartitionByRange(tasks, "name", "at").sortWithinPartitions("name", "at").mapInPandas(run, SCHEMA)


def to_files(spark: SparkSession, space: tuple, folder: str, strict: bool = True, start: int = 0, stop: int | None = None, chunk: int = 4 << 20) -> DataFrame:
    """name, bytes, sha256 and sha512 of the files made of a space's channels in a new folder; manifest.json, written last, has the channels' measures."""
    if os.path.exists(f"{folder}/manifest.json"):
        raise FileExistsError(f"{folder}/manifest.json")
    options = dict(zip(("layout", "stripe", "data_offset"), space[1:], strict=False))
    chunks = evidence.read(spark, space[0], chunk=chunk, overlap=64, start=start, **options, **({"stop": stop} if stop is not None else {}))
    found = settled(frames.carve(chunks, strict=strict, start=start, stop=stop, space=space, payloads=False), "frames")
    planned = settled(plan(found), "plan")
    spark.dataSource.register(PayloadFiles)
    pieces(planned, space).write.format("payload-files").option("folder", folder).mode("append").save()
    names = [r["name"] for r in planned.select("name").distinct().collect()]  # a few for each of at most 256 channels
    done = settled(integrity.file_digests(spark, [f"{folder}/{n}" for n in names]).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("size").alias("bytes"), "sha256", "sha512"), "files")
    stats = channels.media_stats(found).join(channels.channel_stats(found.withColumnRenamed("length", "size")), "channel")
    listed = lambda df, by: df.agg(F.array_sort(F.collect_list(F.struct(by, *(c for c in df.columns if c != by)))).alias("x"))
    about = {"schema_version": 2, "source": "|".join(space[0]), "ordering": "physical", "strict": strict}
    report = listed(stats, "channel").withColumnRenamed("x", "channels").crossJoin(listed(done, "name").withColumnRenamed("x", "files")).crossJoin(found.agg(F.count(F.lit(1)).alias("frames")))
    sinks.write_report(report.select(*(F.lit(v).alias(k) for k, v in about.items()), "*"), f"{folder}/manifest.json", replace=False)
    return done
