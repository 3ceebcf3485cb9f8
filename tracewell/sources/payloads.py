"""A sink of files that many tasks write together.

`df.write.format("payload-files").option("folder", ...).mode("append").save()` with rows (name, at, data): a task writes
its rows at their places of `<name>.partial` and tells which ranges it wrote. Only when all tasks have does the commit
see that each file's ranges join without a gap or an overlap, and gives the files their names; after a failure what there
is keeps the suffix .partial. A repeated task writes the same bytes at the same places. The folder is one that all
executors mount. An existing file, or a left-over part, is never touched.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "name string, at long, data binary"
#: Files that a task holds open.
OPEN = 64


@dataclass
class Written(WriterCommitMessage):
    """The ranges of each file that a task wrote, those that touch as one."""

    ranges: dict[str, list[tuple[int, int]]]


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch as one. An overlap is an error."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a < out[-1][1]:
            raise ValueError(f"bytes {a} to {min(z, out[-1][1])} were written twice")
        if out and a == out[-1][1]:
            out[-1] = (out[-1][0], z)
        elif a < z:
            out.append((a, z))
    return out


def batched(rows: Iterator[tuple[Any, int, bytes]], most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """key, at and data of rows, those that touch as one, in frames of about `most` bytes and not of a row each."""
    keys: list = []
    places: list[int] = []
    parts: list[list[bytes]] = []
    end, held = -1, 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"key": keys, "at": places, "data": [b"".join(p) for p in parts]})

    for key, at, data in rows:
        if keys and at == end and key == keys[-1]:
            parts[-1].append(data)
        else:
            keys.append(key)
            places.append(at)
            parts.append([data])
        end, held = at + len(data), held + len(data) + 64
        if held >= most:
            yield frame()
            keys, places, parts, end, held = [], [], [], -1, 0
    if keys:
        yield frame()


class PayloadWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _path(self, name: str) -> str:
        if not name or name != os.path.basename(name) or name.startswith("."):
            raise ValueError(f"{name!r} is no file name")
        return os.path.join(self.folder, name)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: dict[str, int] = {}
        ranges: dict[str, list[tuple[int, int]]] = {}
        try:
            for b in iterator:
                for name, at, data in zip(b.column("name").to_pylist(), b.column("at").to_pylist(), b.column("data"), strict=True):
                    if name not in files:
                        if len(files) >= OPEN:
                            self._close(files)
                        files[name] = os.open(self._path(name) + ".partial", os.O_WRONLY | os.O_CREAT, 0o644)
                        ranges.setdefault(name, [])
                    raw = memoryview(data.as_buffer()) if data.is_valid else memoryview(b"")
                    begin, end = at, at + len(raw)
                    while begin < end:
                        begin += os.pwrite(files[name], raw[begin - at :], begin)
                    if end > at:
                        mine = ranges[name]
                        if mine and mine[-1][1] == at:
                            mine[-1] = (mine[-1][0], end)
                        else:
                            mine.append((at, end))
        finally:
            self._close(files)
        return Written({n: joined(r) for n, r in ranges.items()})

    @staticmethod
    def _close(files: dict[str, int]) -> None:
        for fd in files.values():
            os.fsync(fd)
            os.close(fd)
        files.clear()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        ranges: dict[str, list[tuple[int, int]]] = {}
        for m in messages:
            for name, r in (m.ranges if m else {}).items():
                ranges.setdefault(name, []).extend(r)
        for name, r in ranges.items():
            whole = joined(r)
            size = os.path.getsize(self._path(name) + ".partial")
            if whole != ([(0, size)] if size else []):
                raise ValueError(f"{name} has {size} bytes, of which {whole[:5]} were written")
        taken = [n for n in ranges if os.path.exists(self._path(n))]
        if taken:
            raise FileExistsError(f"{taken[0]} exists")
        for name in sorted(ranges):
            os.replace(self._path(name) + ".partial", self._path(name))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What was written stays under its .partial name."""


class PayloadFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payload-files"

    def writer(self, schema, overwrite: bool) -> PayloadWriter:
        folder = self.options.get("folder")
        if not folder:
            raise ValueError("option folder is missing")
        os.makedirs(folder, exist_ok=True)
        left = [n for n in os.listdir(folder) if n.endswith(".partial")]
        if overwrite or left:
            raise FileExistsError(f"{folder} has parts of an earlier run: {left[:3]}" if left else "files are never overwritten")
        return PayloadWriter(folder)
