"""Signature scans and samples of byte spaces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HITS = "source string, id string, offset long"
#: How far a signature goes as evidence: fixed values. A hit never proves a format.
STRENGTHS = ("lead", "supporting", "structural")


@dataclass(frozen=True)
class Signature:
    """A pattern of 1 to 4096 bytes, its category, and its strength as evidence."""

    id: str
    pattern: bytes
    category: str = "custom"
    strength: str = "lead"

    def __post_init__(self) -> None:
        if not self.id.strip() or not 1 <= len(self.pattern) <= 4096 or self.strength not in STRENGTHS:
            raise ValueError(f"a signature has an id, 1 to 4096 bytes and a strength of {', '.join(STRENGTHS)}")


def as_signatures(signatures: Iterable[Signature | tuple[str, bytes]]) -> list[Signature]:
    found = [s if isinstance(s, Signature) else Signature(*s) for s in signatures]
    if len({s.id for s in found}) != len(found):
        raise ValueError("ids must be unique")
    return found


class Matcher:
    """All places of all patterns in one pass over the bytes.

    A pattern is found by an anchor of four of its bytes (two or one of a shorter pattern), those that are least like
    filling. Every place's four bytes are hashed into a table of the anchors' hashes; only places that fall on a set entry
    are compared with anchors, and only those of an anchor with its patterns.
    """

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        self.anchors: dict[int, dict[int, list[tuple[int, int]]]] = {}  # by width and value: pattern and the anchor's place in it
        for i, p in enumerate(patterns):
            width = 4 if len(p) >= 4 else 2 if len(p) >= 2 else 1
            at = max(range(len(p) - width + 1), key=lambda k: (len(set(p[k : k + width]) - {0, 255}), -k))
            self.anchors.setdefault(width, {}).setdefault(int.from_bytes(p[at : at + width], "little"), []).append((i, at))
        self.tables = {}
        for width, known in self.anchors.items():
            values = np.array(sorted(known), np.uint32)
            table = np.zeros(1 << 16, bool)
            table[self._hash(values, width)] = True
            self.tables[width] = values, table

    @staticmethod
    def _hash(values: np.ndarray, width: int) -> np.ndarray:
        return (values * np.uint32(2_654_435_761)) >> np.uint32(16) if width == 4 else values

    def find(self, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(pattern, its places in order) of the patterns that occur."""
        raw = np.frombuffer(data, np.uint8)
        for width, (values, table) in self.tables.items():
            known = self.anchors[width]
            places, seen = [], []
            for shift in range(width):
                n = (len(raw) - shift) // width
                if n <= 0:
                    continue
                words = np.frombuffer(data, f"<u{width}", n, shift)
                at = np.flatnonzero(table[self._hash(words, width)])
                words = words[at].astype(np.uint32)
                slot = np.searchsorted(values, words)
                hit = values[np.minimum(slot, len(values) - 1)] == words
                places.append(at[hit] * width + shift)
                seen.append(words[hit])
            if not places:
                continue
            at, words = np.concatenate(places), np.concatenate(seen)
            order = np.lexsort((at, words))
            at, words = at[order], words[order]
            for value in np.unique(words).tolist():
                mine = at[np.searchsorted(words, value, "left") : np.searchsorted(words, value, "right")]
                for i, place in known[value]:
                    p = self.patterns[i]
                    begin = mine - place
                    begin = begin[(begin >= 0) & (begin + len(p) <= len(raw))]
                    for k, byte in enumerate(p):
                        if not place <= k < place + width and len(begin):
                            begin = begin[raw[begin + k] == byte]
                    if len(begin):
                        yield i, begin


def signature_hits(chunks: DataFrame, signatures: Iterable[Signature | tuple[str, bytes]], start: int = 0, stop: int | None = None, around: tuple[int, int] | None = None) -> DataFrame:
    """All offsets, overlapping ones too, at which a pattern starts.

    chunks: source, base, size, data, where data goes on past size by the longest pattern less one byte; a hit
    belongs to the chunk that it starts in, so none is found twice. around: also `data`, so many bytes from so many
    before each hit on, as far as the chunk has them; hits that have none before them in their chunk are left out.
    """
    known = as_signatures(signatures)
    matcher = Matcher([s.pattern for s in known])
    names = ["source", "id", "offset", *(["data"] if around else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, base, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                raw = data.as_py()
                for i, at in matcher.find(raw):
                    at = at[at < size]
                    at = at[(base + at >= start) & (base + at < (stop if stop is not None else 1 << 62))]
                    columns = [pa.array([s] * len(at), pa.string()), pa.array([known[i].id] * len(at), pa.string()), pa.array(base + at)]
                    if around:
                        before, n = around
                        columns.append(pa.array([raw[a - before : a - before + n] if a >= before else None for a in at.tolist()], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return chunks.select("source", "base", "size", "data").mapInArrow(run, HITS + (", data binary" if around else ""))


def with_strength(stats: DataFrame, signatures: Iterable[Signature | tuple[str, bytes]]) -> DataFrame:
    """hit_stats with each signature's category and strength, and those without a hit, too."""
    known = as_signatures(signatures)
    table = stats.sparkSession.createDataFrame([(s.id, s.category, s.strength) for s in known], "id string, category string, strength string")
    return table.join(stats, "id", "left").fillna(0, ["count"]).fillna(False, ["truncated"]).fillna(0.0, ["per_gib"])


def hit_stats(hits: DataFrame, total_bytes: int, keep: int = 16) -> DataFrame:
    """Per id: count, first, last, the first `keep` offsets, whether there are more, and hits a GiB. The limit goes before the shuffle."""
    counts = hits.groupBy("id").agg(F.count(F.lit(1)).alias("count"), F.min("offset").alias("first"), F.max("offset").alias("last"))
    # a window-group limit keeps at most `keep` rows of an id per task
    kept = hits.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("offset"))).where(F.col("__n") <= keep)
    lists = kept.groupBy("id").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
    return counts.join(lists, "id").withColumns({"truncated": F.col("count") > keep, "per_gib": F.col("count") * float(1 << 30) / max(1, total_bytes)})


def sample_offsets(size: F.Column, sample: int, count: int) -> F.Column:
    """Offsets of at most `count` samples spread over a source: half-even rounding, then down to 512, in order, each once."""
    if not 1 <= count <= 33 or not 1 <= sample <= 64 << 20:
        raise ValueError("1 to 33 samples of up to 64 MiB")
    most = F.greatest(size - sample, F.lit(0)).cast("bigint")
    if count == 1:
        return F.array(F.lit(0).cast("bigint"))
    place = lambda i: F.bround(most * i / float(count - 1)).cast("bigint")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.least(most, F.floor(place(i) / 512) * 512).cast("bigint")))


PROFILE = "key long, size long, entropy double, zero_fraction double, ff_fraction double, sha256 string"


def byte_profile(rows: DataFrame) -> DataFrame:
    """Entropy, shares of 00 and FF, and SHA-256 of each row's bytes. rows: key, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = data.as_py() or b""
                n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                p = n[n > 0] / max(1, len(raw))
                out.append((key, len(raw), float(max(0.0, -(p * np.log2(p)).sum())), n[0] / max(1, len(raw)), n[255] / max(1, len(raw)), hashlib.sha256(raw).hexdigest()))
            names = [c.split()[0] for c in PROFILE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())], names)

    return rows.select(F.col("key").cast("bigint"), "data").mapInArrow(run, PROFILE)
