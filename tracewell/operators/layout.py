"""Where fragments begin and how long they are, from the bytes themselves.

A scan looks at every sector of a space for what fragments have: a record of the caller's layout at their first
byte, a time in it, and padding at their last bytes. Each task sums that by residue, for several fragment sizes at once, so
only size / sector sums of each size leave it, whatever it has read. Residues of one size are then ranked as
hypotheses, and sizes by how well their best residue agrees with the records that there are: a multiple of the true size misses
records, a divisor expects too many.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import carry

SECTOR = 512
#: Weights of a record, a time in it, and padding at a fragment's end.
VALID, TIMED, PADDED = 2.0, 8.0, 0.5
#: Records and times that make a hypothesis as sure as its lead over the next one.
ENOUGH = 6.0
SUMS = "source string, fragment_size long, residue long, tested long, valid long, timestamped long, padding long"


def real_time(v: int) -> bool:
    """Whether packed bits (functions.bytesx.packed_time) are a date and time."""
    try:
        datetime.datetime(2000 + (v >> 26 & 63), v >> 22 & 15, v >> 17 & 31, v >> 12 & 31, v >> 6 & 63, v & 63)
    except ValueError:
        return False
    return True


def sector_evidence(data: bytes, base: int, size: int, layout: carry.Layout, times: dict[int, int], sector: int = SECTOR) -> tuple[np.ndarray, ...]:
    """Of a chunk: the offsets of all its sectors, of those with a record, of those whose record has a time, and of the sector ends after padding.

    data goes on past size by the longest header and a run of padding, unless the space ends.
    """
    raw = np.frombuffer(data, np.uint8)
    at = np.arange(-base % sector, size, sector)
    n = len(layout.sync)
    found = at[at + n < len(raw)]
    for i, byte in enumerate(layout.sync):
        found = found[raw[found + i] == byte]
    valid, timed = [], []
    for i in found.tolist():
        if r := carry.record(data, i, layout):
            valid.append(base + i)
            place = times.get(r[0])
            if place is not None and real_time(int.from_bytes(data[i + place : i + place + 4], "little")):
                timed.append(base + i)
    blank = np.zeros(256, bool)
    blank[list(layout.blanks)] = True
    # a run is looked at by the chunk that it begins in; at the space's end by what is there of it
    begin = np.arange((-layout.run - base) % sector, size, sector)
    begin = begin[begin < len(raw)]
    bad = np.concatenate([[0], np.cumsum(~blank[raw])])
    padded = begin[bad[np.minimum(begin + layout.run, len(raw))] == bad[begin]]
    return base + at, np.array(valid, np.int64), np.array(timed, np.int64), base + padded + layout.run


def evidence(chunks: DataFrame, layout: carry.Layout, sizes: list[int], times: dict[int, int], sector: int = SECTOR, start: int = 0) -> DataFrame:
    """What speaks for each residue of each fragment size. times: by record type the place of its packed time; start: where the scanned range begins.

    chunks: source, base, size, data.
    """
    if not sizes or any(s <= 0 or s % sector for s in sizes):
        raise ValueError("fragment sizes are multiples of the sector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for source, base, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                tested, valid, timed, ends = sector_evidence(data.as_py(), base, size, layout, times, sector)
                for s in sizes:
                    held = sums.setdefault((source, s), np.zeros((4, s // sector), np.int64))
                    # padding speaks for the fragment that ends there, if that began in the range
                    for row, x in enumerate((tested, valid, timed, ends[ends - s >= start])):
                        held[row] += np.bincount(x % s // sector, minlength=s // sector)
        for (source, s), held in sums.items():
            some = np.flatnonzero(held.any(0))
            columns = [pa.array([source] * len(some), pa.string()), pa.array(np.full(len(some), s)), pa.array(some * sector), *(pa.array(r[some]) for r in held)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SUMS.split(", ")])

    parts = chunks.select("source", "base", "size", "data").mapInArrow(run, SUMS)
    return parts.groupBy("source", "fragment_size", "residue").agg(*(F.sum(c).alias(c) for c in ("tested", "valid", "timestamped", "padding")))


def hypotheses(sums: DataFrame, top: int = 8) -> DataFrame:
    """The `top` residues of each source and fragment size, best first, with score, confidence, and `fit`, by which sizes compare.

    Confidence is the score's share of itself and the second best, less with few records and times, and less than the best's by
    the scores' ratio. Fit is twice the records at the residue over the fragments expected and the records at any sector.
    """
    by = Window.partitionBy("source", "fragment_size")
    order = by.orderBy(F.desc("score"), F.desc("timestamped"), F.desc("valid"), "residue")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scored = sums.withColumn("score", F.col("valid") * VALID + F.col("timestamped") * TIMED + F.col("padding") * PADDED)
    ranked = scored.withColumns({
        "rank": F.row_number().over(order), "__best": F.first("score").over(order), "__next": F.coalesce(F.nth_value("score", 2).over(whole), F.lit(0.0)), "__records": F.sum("valid").over(by),
    }).where(F.col("rank") <= top)
    seen = F.col("valid") + F.col("timestamped")
    share = F.col("score") / F.greatest(F.col("score") + F.col("__next"), F.lit(1.0))
    confidence = F.when((F.col("score") <= 0) | (seen == 0), 0.0).otherwise(share * F.least(F.lit(1.0), seen / ENOUGH) * F.col("score") / F.col("__best"))
    fit = F.coalesce(F.try_divide(2.0 * F.col("valid"), F.col("tested") + F.col("__records")), F.lit(0.0))
    return ranked.withColumns({"confidence": F.bround(confidence, 6), "fit": fit}).drop("__best", "__next", "__records")


def best(found: DataFrame) -> DataFrame:
    """One hypothesis a source: the best residue of the size that fits best, the smaller one of equals."""
    order = Window.partitionBy("source").orderBy(F.desc("fit"), F.desc("score"), "fragment_size")
    return found.where("rank = 1").withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def notes() -> Column:
    """What to mind about a hypothesis: column of text, over those of `best`."""
    return F.array_compact(F.array(
        F.lit("fragments may begin at this residue; where the first one lies isn't known"), F.when(F.col("confidence") < 0.5, "weak lead: scan more"), F.when(F.col("fit") < 0.5, "no fragment size fits well"),
    ))
