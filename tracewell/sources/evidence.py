"""Byte spaces as DataFrames: one file, several joined end to end, or a RAID-0 set, read-only and by ranges.

`spark.dataSource.register(EvidenceSource)`, then `spark.read.format("evidence").option("paths", "a|b")`. A row has
`chunk` bytes and `overlap` bytes past them, so what starts in the chunk is whole. A partition streams a row of chunks
that lie together: enough partitions for the cluster (`tasks`), SPAN bytes each at most, and no more than MOST of them.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, chunk long, base long, size int, data binary"


#: Reads bytes of a member: its number, offset and length.
Segment = tuple[int, int, int]


def _joined(sizes: list[int], lo: int, hi: int) -> Iterator[Segment]:
    """Members end to end."""
    at = 0
    for member, size in enumerate(sizes):
        a, z = max(lo, at), min(hi, at + size)
        if a < z:
            yield member, a - at, z - a
        at += size


def _striped(members: int, stripe: int, skip: int, lo: int, hi: int) -> Iterator[Segment]:
    """Stripes of the members in turn, each member's from `skip` on."""
    for number in range(lo // stripe, -(-hi // stripe)):
        a, z = max(lo, number * stripe), min(hi, (number + 1) * stripe)
        yield number % members, skip + number // members * stripe + a - number * stripe, z - a


class Space:
    """A byte space over files: one, several joined, or a RAID-0 set without what the shortest member lacks.

    `plan` says where the bytes of a range lie, `read` fetches them. All files are opened, or none.
    """

    def __init__(self, paths: list[str], layout: str = "file", stripe: int = 65536, data_offset: int = 0) -> None:
        with ExitStack() as opened:
            self.files = [opened.enter_context(open(p, "rb", buffering=0)) for p in paths]
            sizes = [f.seek(0, os.SEEK_END) for f in self.files]
            if layout == "file" and len(paths) == 1:
                self.size = sizes[0]
                self._where = partial(_joined, sizes)
            elif layout == "concat" and paths and min(sizes) > 0:
                self.size = sum(sizes)
                self._where = partial(_joined, sizes)
            elif layout == "raid0" and len(paths) > 1 and data_offset >= 0 and stripe >= 512 and not stripe & (stripe - 1) and min(sizes) - data_offset >= stripe:
                self.size = (min(sizes) - data_offset) // stripe * stripe * len(paths)
                self._where = partial(_striped, len(paths), stripe, data_offset)
            else:
                raise ValueError(f"no {layout} of {len(paths)} paths: joined members must have bytes, and a RAID-0 set two members and a whole stripe of a power of two from 512 on")
            self._stack = opened.pop_all()

    def plan(self, offset: int, n: int) -> Iterator[Segment]:
        """The segments of a range, in order; what lies past the end is left out."""
        if offset < 0 or n < 0:
            raise ValueError("negative offset or size")
        return self._where(offset, min(offset + n, self.size)) if offset < self.size else iter(())

    def read(self, offset: int, n: int) -> bytes:
        """The bytes of a range, fewer at the end of the space or where a member has shrunk."""
        out = bytearray()
        for member, at, length in self.plan(offset, n):
            while length and (part := os.pread(self.files[member].fileno(), length, at)):
                out += part
                at, length = at + len(part), length - len(part)
            if length:
                break
        return bytes(out)

    def __enter__(self) -> Space:
        return self

    def __exit__(self, *_) -> None:
        self._stack.close()


def require_readable(path: str, mounted: set[str] | None = None, allow_write_enabled: bool = False) -> dict:
    """What is known of a source; mounted block devices, and writable ones unless allowed, are refused."""
    s = os.stat(path)
    block = stat.S_ISBLK(s.st_mode)
    if mounted is None:
        with open("/proc/self/mounts") as f:
            mounted = {line.split()[0] for line in f}
    is_mounted = os.path.realpath(path) in mounted
    if block and is_mounted:
        raise PermissionError(f"{path} is mounted")
    read_only = not os.access(path, os.W_OK)
    if block and not read_only and not allow_write_enabled:
        raise PermissionError(f"{path} can be written to")
    return {"path": path, "is_block": block, "size": s.st_size, "read_only": read_only, "mounted": is_mounted}


#: Bytes of a partition, and partitions of a space, if that takes larger ones.
SPAN, MOST = 128 << 20, 8192


@dataclass
class Range(InputPartition):
    """Chunks first, first + 1, ... of a space's range from base to stop."""

    first: int
    base: int
    stop: int


def ranges(start: int, stop: int, chunk: int, tasks: int) -> list[Range]:
    """The partitions of a range: whole chunks each."""
    total = max(0, stop - start)
    wanted = max(min(SPAN, -(-total // max(1, tasks))), -(-total // MOST), 1)
    step = -(-wanted // chunk)
    return [Range(i, start + i * chunk, min(stop, start + (i + step) * chunk)) for i in range(0, -(-total // chunk), step)]


class EvidenceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split("|") if p]
        if not self.paths:
            raise ValueError("option paths is missing")
        self.space = (self.paths, options.get("layout", "file"), int(options.get("stripe", 65536)), int(options.get("data_offset", 0)))
        self.chunk, self.overlap = int(options.get("chunk", 4 << 20)), int(options.get("overlap", 0))
        self.start, self.stop = int(options.get("start", 0)), options.get("stop")
        self.tasks = int(options.get("tasks", 64))
        if self.chunk <= 0 or self.overlap < 0 or self.start < 0 or self.chunk + self.overlap > 1 << 30:
            raise ValueError("chunk and overlap must be positive and below 1 GiB together")

    def partitions(self) -> list[InputPartition]:
        for p in self.paths:
            require_readable(p)
        with Space(*self.space) as r:
            stop = min(r.size, int(self.stop)) if self.stop is not None else r.size
        return ranges(self.start, stop, self.chunk, self.tasks)

    def read(self, partition: Range) -> Iterator[tuple]:
        source = "|".join(self.paths)
        with Space(*self.space) as r:
            for i, base in enumerate(range(partition.base, partition.stop, self.chunk), partition.first):
                size = min(self.chunk, partition.stop - base)
                yield source, i, base, size, r.read(base, size + self.overlap)


class EvidenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EvidenceReader:
        return EvidenceReader(dict(self.options))


def read(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Chunks of a byte space."""
    spark.dataSource.register(EvidenceSource)
    r = spark.read.format("evidence").option("paths", "|".join(paths)).option("tasks", str(2 * spark.sparkContext.defaultParallelism))
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()
