"""Format families: what they support, their detectors, and a registry that ranks them.

A detector is a state of counters that merge: `look` adds a chunk's evidence to it, states are merged within a task and then
by an aggregate, and `finish` says what the sums mean. So all families see a chunk in one scan, and what leaves a task is a few
numbers a source and family, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytesx as B
from ..session import settled
from ..sources.evidence import Space
from . import carry, channels, detect, frames, layout, master, media, scan

#: What a family can be asked for, in order of ambition: fixed values.
OPERATIONS = ("detect", "profile", "scan_date", "scan_frames", "recover", "demux", "quality", "validate")
#: How counters merge: by sums unless their names begin so.
MOST, BITS = "most ", "bits "


@dataclass(frozen=True)
class Chunk:
    """Bytes of a source: those that begin in the first `size` are this chunk's, the others help to read them. space: the whole, if it can be read."""

    source: str
    base: int
    size: int
    data: bytes
    space: Space | None = None


@dataclass(frozen=True)
class Detector:
    """look gives a chunk's counters. finish gives confidence and reason by a function of columns: of a counter's name.

    Counters whose names begin with MOST merge by the greatest value, with BITS by the union of bits, else by sums.
    """

    look: Callable[[Chunk], dict[str, int]]
    finish: Callable[[Callable[[str], Column]], tuple[Column, Column]]


@dataclass(frozen=True)
class Family:
    """scan_date takes chunks, a date and the arguments of evidence.Space or None, and gives the date's recordings by minute."""

    name: str
    display_name: str
    operations: frozenset[str]
    detector: Detector
    scan_date: Callable[[DataFrame, str, tuple | None], DataFrame] | None = field(default=None, compare=False)

    def supports(self, operation: str) -> bool:
        return operation in self.operations


def merged(name: str, a: int, b: int) -> int:
    return max(a, b) if name.startswith(MOST) else a | b if name.startswith(BITS) else a + b


STATE = "source string, plugin string, name string, value long"


def states(chunks: DataFrame, families: dict[str, Family], space: tuple | None = None) -> DataFrame:
    """source, plugin and the merged counters of each family, by one scan of the chunks (source, base, size, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], int] = {}
        with Space(*space) if space else nullcontext() as whole:
            for b in batches:
                for source, base, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                    chunk = Chunk(source, base, size, data.as_py() or b"", whole)
                    for plugin, f in families.items():
                        for name, value in f.detector.look(chunk).items():
                            key = (source, plugin, name)
                            held[key] = merged(name, held[key], value) if key in held else value
        keys = list(zip(*held, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(held.values(), pa.int64())], ["source", "plugin", "name", "value"])

    parts = chunks.select("source", "base", "size", "data").mapInArrow(run, STATE)
    value = F.when(F.col("name").startswith(MOST), F.max("value")).when(F.col("name").startswith(BITS), F.bit_or("value")).otherwise(F.sum("value"))
    sums = parts.groupBy("source", "plugin", "name").agg(value.alias("value"))
    return sums.groupBy("source", "plugin").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("counters"))


def _frame_counters(c: Chunk) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in frames.in_chunk(c.data, c.base, c.size, c.space):
        if f["valid"]:
            bits = f"{BITS}channels {f['channel'] // 32}"
            out["frames"] = out.get("frames", 0) + 1
            out[bits] = out.get(bits, 0) | 1 << f["channel"] % 32
    return out


def _frames(n: Callable[[str], Column]) -> tuple[Column, Column]:
    # fixed values, as are the ladders below
    ladder = F.when(n("frames") >= 16, 0.98).when(n("frames") >= 8, 0.92).when(n("frames") >= 3, 0.80).when(n("frames") == 2, 0.65).when(n("frames") == 1, 0.55).otherwise(0.0)
    of = sum((F.bit_count(n(f"{BITS}channels {i}")) for i in range(8)), F.lit(0))
    return ladder, F.format_string("%d frames of %d channels", n("frames"), of.cast("long"))


def _nal_counters(c: Chunk) -> dict[str, int]:
    avc, hevc, n = media.nal_types(c.data, c.size)
    return {"nals": n, **{f"h264 {k}": v for k, v in avc.items()}, **{f"hevc {k}": v for k, v in hevc.items()}} if n else {}


def _streams(n: Callable[[str], Column]) -> tuple[Column, Column]:
    """A little less sure than a whole stream would be."""
    codec = media.ladder(lambda kind, *types: sum((n(f"{kind} {t}") for t in types), F.lit(0)), n("nals"))
    return codec["confidence"] * 0.9, F.concat(F.lit("NAL units of "), codec["codec"])


_CODES = scan.Matcher([b"\0\0\1\xba", *(b"\0\0\1" + bytes([i]) for i in range(0xE0, 0xF0))])


def _program_counters(c: Chunk) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, at in _CODES.find(c.data):
        name = "video" if i else "packs"
        out[name] = out.get(name, 0) + int((at < c.size).sum())
    return out


def _program(n: Callable[[str], Column]) -> tuple[Column, Column]:
    ladder = F.when((n("packs") >= 2) & (n("video") >= 2), 0.90).when((n("packs") > 0) & (n("video") > 0), 0.70).when(n("video") > 0, 0.30).otherwise(0.0)
    return ladder, F.format_string("%d packs, %d video packets", n("packs"), n("video"))


_MASTER = scan.Matcher([master.SIGNATURE])


def _master_counters(c: Chunk) -> dict[str, int]:
    found = [master.plausibility(c.data[a - master.SIGNATURE_AT :][: master.SIZE]) for _, at in _MASTER.find(c.data) for a in at.tolist() if master.SIGNATURE_AT <= a < c.size + master.SIGNATURE_AT]
    return {MOST + "plausibility": max(found)} if found else {}


def _masters(n: Callable[[str], Column]) -> tuple[Column, Column]:
    p = n(MOST + "plausibility") / 100
    return F.when(p > 0, F.least(F.lit(0.99), 0.55 + 0.44 * p)).otherwise(0.0), F.format_string("master sector, plausibility %.2f", p)


def records(name: str, display_name: str, of: carry.Layout, times: dict[int, int], begins: int, fragment: int) -> Family:
    """A family of recorders whose fragments begin with records of a layout that the caller gives; times: by record type the place of its time; begins: the type that begins a recording."""

    def look(c: Chunk) -> dict[str, int]:
        _, valid, timed, _ = layout.sector_evidence(c.data, c.base, c.size, of, times)
        return {k: v for k, v in (("records", len(valid)), ("times", len(timed))) if v}

    def finish(n: Callable[[str], Column]) -> tuple[Column, Column]:
        ladder = F.when(n("times") >= 16, 0.96).when(n("times") >= 4, 0.86).when(n("records") >= 16, 0.70).when(n("records") >= 2, 0.40).when(n("records") > 0, 0.10).otherwise(0.0)
        return ladder, F.format_string("%d records at sectors, %d with a time", n("records"), n("times"))

    def scan_date(chunks: DataFrame, date: str, space: tuple | None) -> DataFrame:
        prefix = of.sync + bytes([begins])
        hits = scan.signature_hits(chunks, [("start", prefix)], around=(0, of.longest)).where(F.col("offset") % fragment == 0)
        return channels.boundaries(hits.select(F.floor(F.col("offset") / fragment).alias("start"), B.packed_time(B.le("data", times[begins], 4)).alias("ts")), date)

    return Family(name, display_name, frozenset({"detect", "profile", "scan_date", "recover"}), Detector(look, finish), scan_date)


def _frame_dates(chunks: DataFrame, date: str, space: tuple | None) -> DataFrame:
    return channels.boundaries(frames.carve(chunks, space=space).select(F.col("offset").alias("start"), "ts"), date)


class Registry:
    """Families by lower-case name."""

    def __init__(self) -> None:
        self.families: dict[str, Family] = {}

    def register(self, family: Family) -> None:
        name = family.name.lower()
        if name in self.families or not family.operations <= set(OPERATIONS) or family.supports("scan_date") != (family.scan_date is not None):
            raise ValueError(f"{name} is taken, asks for unknown operations, or has no scan for dates")
        self.families[name] = family

    def get(self, name: str) -> Family:
        return self.families[name.lower()]

    def names(self) -> list[str]:
        return sorted(self.families)

    def descriptors(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, f.display_name, sorted(f.operations)) for n, f in sorted(self.families.items())], "plugin string, display_name string, operations array<string>")

    def detect_all(self, chunks: DataFrame, space: tuple | None = None) -> DataFrame:
        """source, plugin, confidence and reasons of all families for which a source has evidence, by one scan of it."""
        found = settled(states(chunks, self.families, space), "states")
        n = lambda name: F.coalesce(F.try_element_at("counters", F.lit(name)), F.lit(0).cast("long"))
        each = []
        for plugin, f in sorted(self.families.items()):
            confidence, reason = f.detector.finish(n)
            each.append(found.where(F.col("plugin") == plugin).select("source", "plugin", confidence.alias("confidence"), F.array(reason).alias("reasons")))
        return reduce(DataFrame.unionByName, each)

    def best(self, chunks: DataFrame, space: tuple | None = None) -> DataFrame:
        """The best family of each source, with its reasons."""
        return self.detect_all(chunks, space).where("confidence > 0").groupBy("source").agg(F.min_by(F.struct("plugin", "confidence", "reasons"), F.struct(-F.col("confidence"), "plugin")).alias("b")).select("source", "b.*")

    def report(self, chunks: DataFrame, least: float = detect.LEAST_CONFIDENCE, margin: float = detect.LEAST_MARGIN, space: tuple | None = None) -> DataFrame:
        return detect.report(self.detect_all(chunks, space).where("confidence > 0"), least, margin)


def default() -> Registry:
    r = Registry()
    r.register(Family("dhav", "DHAV frames", frozenset({"detect", "profile", "scan_date", "scan_frames", "recover", "demux"}), Detector(_frame_counters, _frames), _frame_dates))
    r.register(Family("annexb", "H.264/H.265 Annex B", frozenset({"detect", "quality"}), Detector(_nal_counters, _streams)))
    r.register(Family("mpegps", "MPEG program stream", frozenset({"detect"}), Detector(_program_counters, _program)))
    r.register(Family("hikvision", "Recorder master sector", frozenset({"detect", "profile"}), Detector(_master_counters, _masters)))
    return r
