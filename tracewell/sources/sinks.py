"""Reports to files of the driver, payloads to files of a shared folder."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def write_report(report: DataFrame, path: str, replace: bool = True) -> None:
    """A one-row report as JSON with sorted keys, whole or not at all. Without `replace`, an existing file or a left-over part is an error."""
    row = report.limit(2).toJSON().collect()
    if len(row) != 1:
        raise ValueError("a report is one row")
    part = f"{path}.partial"
    if not replace and (os.path.exists(path) or os.path.exists(part)):
        raise FileExistsError(path)
    with open(part, "w" if replace else "x") as f:
        json.dump(json.loads(row[0]), f, sort_keys=True, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def write_streams(pieces: DataFrame, folder: str) -> dict[str, int]:
    """Elementary streams of demultiplexed pieces, a file a source, channel and codec, in order, and the bytes of each.

    A task writes the streams that it is dealt as they come, into a folder that executors share. Until a stream is
    whole its file has the suffix .partial; a repeated task writes it anew.
    """
    os.makedirs(folder, exist_ok=True)

    def name(source: str, channel: int, codec: str) -> str:
        short = re.sub(r"[^A-Za-z0-9._-]+", "_", os.path.basename(source.split("|")[0]))[:80]
        return f"{short}-{hashlib.sha256(source.encode()).hexdigest()[:12]}-channel-{channel}.{codec}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, done = None, None, []

        def close() -> None:
            done.append((now, file.tell()))
            file.close()
            os.replace(file.name, os.path.join(folder, now))

        for b in batches:
            for source, channel, codec, payload in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if (wanted := name(source, channel, codec)) != now:
                    if file:
                        close()
                    now, file = wanted, open(os.path.join(folder, f"{wanted}.{uuid.uuid4().hex}.partial"), "wb")  # noqa: SIM115
                file.write(payload.as_py())
        if file:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["name", "bytes"])

    dealt = pieces.repartition("source", "channel", "codec").sortWithinPartitions("source", "channel", "codec", "offset")
    return {r["name"]: r["bytes"] for r in dealt.select("source", "channel", "codec", "payload").mapInArrow(run, "name string, bytes long").collect()}
