"""Exact medians of pairwise slopes (Theil and Sen) without making the pairs.

Of points in order of x, those of a pair swap places in y - s * x exactly if their slope is below s. So the number of slopes
below s is a number of inversions, which blocks of points can count: inversions within a block, within a bucket of y - s * x,
and, for all other pairs, a table of how many points of each block fall in each bucket. A sample of slopes brackets the
median, both ends are counted, and the next sample is drawn from within; when few enough slopes are left in the bracket, just those
pairs are made. The sample only decides how soon that is: counts are exact.

A clock's points are rows of blocks (`blocked`), a few thousand at most, so that a step is a pass over them with one shuffle of the
points, whatever their number. Counts compare y - s * x in doubles: slopes nearer to an end than its rounding may fall on
either side of it, all of which are equal to the median within that rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from . import ordered

#: Points of a block at least, and blocks at most.
BLOCK, BLOCKS = 1 << 16, 2048
#: Slopes that a sample aims at, points that it draws them from, and slopes that are made in the end.
SAMPLE, ANCHORS, MADE = 20_000, 1024, 1 << 21
ROUNDS = 60


def swaps(values: np.ndarray) -> int:
    """Pairs of which the earlier value is greater."""
    n = len(values)
    if n < 2:
        return 0
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    size = 1 << (n - 1).bit_length()
    rank = np.concatenate([rank, np.arange(n, size) + n])  # later and greater than all
    found, width = 0, 1
    while width < size:
        rows = rank.reshape(-1, 2 * width)
        shift = np.arange(len(rows))[:, None] * (4 * np.int64(size))
        left, right = (np.sort(rows[:, :width], 1) + shift).ravel(), (rows[:, width:] + shift).ravel()
        found += int((np.repeat(np.arange(1, len(rows) + 1) * width, width) - np.searchsorted(left, right, "right")).sum())
        width *= 2
    return found


def swapped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (earlier, later) of which the earlier value is greater."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64) if n else np.zeros(0, np.int64)
    first, second = [], []
    width = 1
    while width < n:
        block = np.arange(n) // (2 * width)
        is_left = np.arange(n) // width % 2 == 0
        # each block's right half in order of value; a left one pairs with those before its own value
        right = np.flatnonzero(~is_left)
        right = right[np.lexsort((rank[right], block[right]))]
        keys = block[right] * np.int64(n + 1) + rank[right]
        left = np.flatnonzero(is_left)
        low = np.searchsorted(keys, block[left] * np.int64(n + 1), "left")
        many = np.searchsorted(keys, block[left] * np.int64(n + 1) + rank[left], "left") - low
        at = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
        first.append(np.repeat(left, many))
        second.append(right[at])
        width *= 2
    none = np.zeros(0, np.int64)
    return np.concatenate(first) if first else none, np.concatenate(second) if second else none


def median_slope(total: int, below: Callable[[list[float]], list[int]], sample: Callable[[float, float, float, int], np.ndarray], within: Callable[[float, float], np.ndarray], scale: float, made: int = MADE) -> float:
    """The median of `total` slopes, which are of the order of scale. below: how many are below each of some slopes; sample: about SAMPLE of those in [lo, hi), which are a share of all; within: all in [lo, hi)."""
    ranks = ((total - 1) // 2, total // 2)  # the median is their mean
    lo, hi, less, upto = -math.inf, math.inf, 0, total
    for turn in range(ROUNDS):
        if upto - less <= made and (turn or total <= made):
            found = np.sort(within(lo, hi))
            if not len(found):
                return (lo + hi) / 2
            return float(np.mean([found[min(max(r - less, 0), len(found) - 1)] for r in ranks]))
        seen = np.sort(sample(lo, hi, (upto - less) / total, turn))
        if not len(seen):
            continue
        middle = (ranks[0] - less) / max(1, upto - less) * len(seen)
        spread = 4 * math.sqrt(len(seen)) + 2
        a = float(seen[int(min(max(0, middle - spread), len(seen) - 1))])
        b = float(seen[int(min(max(0, middle + spread), len(seen) - 1))])
        if a == b:
            # one slope that many pairs have: it is the median if that is within rounding of it
            for power in range(6):
                near = max(abs(a), scale) * 1e-13 * 32**power
                under, over = below([a - near, a + near])
                if under <= ranks[0] and over > ranks[1]:
                    return a
            a, b = a - near, a + near
        ends = sorted(e for e in {a, b} if lo < e < hi)
        for e, n in zip(ends, below(ends), strict=True):
            if n <= ranks[0] and e > lo:
                lo, less = e, n
            elif n > ranks[1] and e < hi:
                hi, upto = e, n
        if math.isfinite(hi - lo) and hi - lo <= 4e-13 * max(abs(lo), abs(hi)):
            return (lo + hi) / 2
    raise RuntimeError("the median didn't settle")


def _slopes(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (y[j] - y[i]) / (x[j] - x[i])


def in_memory(x: np.ndarray, y: np.ndarray, made: int = MADE) -> float | None:
    """The median slope of points that one task holds; none without two x."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    same = np.unique(x, return_counts=True)[1].astype(object)
    n = len(x)
    total = n * (n - 1) // 2 - int(sum(c * (c - 1) // 2 for c in same))
    if not total:
        return None

    def sample(lo: float, hi: float, share: float, turn: int) -> np.ndarray:
        rng = np.random.default_rng(turn)
        m = min(int(SAMPLE / share) + 1, 1 << 24)
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        i, j = np.minimum(i, j), np.maximum(i, j)
        use = x[i] < x[j]
        s = _slopes(x, y, i[use], j[use])
        return s[(s >= lo) & (s < hi)]

    def within(lo: float, hi: float) -> np.ndarray:
        if lo == -math.inf:
            i, j = np.triu_indices(n, 1)
            use = x[i] < x[j]
            s = _slopes(x, y, i[use], j[use])
        else:
            order = np.argsort(y - lo * x, kind="stable")
            a, b = x[order], y[order]
            i, j = swapped(b - hi * a if hi < math.inf else -a)
            use = a[i] != a[j]
            s = _slopes(a, b, i[use], j[use])
        return s[(s >= lo) & (s < hi)]

    scale = float((y.max() - y.min()) / (x[-1] - x[0]))
    return median_slope(total, lambda ends: [swaps(y - e * x) for e in ends], sample, within, scale, made)


def blocked(points: DataFrame, block: int | None = None) -> tuple[DataFrame, int]:
    """Rows of blocks of points (x, y) in order of x and y: block, begin (its first point's place), x and y as bytes of doubles; and how many points."""
    placed = ordered.scanned(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(1).cast("long").alias("one")).where("x is not null and y is not null"), [], ["x", "y"], ["one"])
    placed = settled(placed.select(F.col("before_one").alias("place"), "x", "y"), "points")
    n = placed.count()
    size = max(block or BLOCK, -(-n // BLOCKS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            cut = np.append(np.append(0, np.flatnonzero(np.diff(ids)) + 1), len(ids))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != ids[i]:
                    yield whole(held)
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield whole(held)

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        x, y = (t.column(c).to_numpy().astype("<f8").tobytes() for c in ("x", "y"))
        return pa.RecordBatch.from_arrays([pa.array([t.column(0)[0].as_py()]), pa.array([t.column(1)[0].as_py()]), pa.array([x], pa.binary()), pa.array([y], pa.binary())], ["block", "begin", "x", "y"])

    dealt = placed.withColumn("block", F.floor(F.col("place") / size)).select("block", "place", "x", "y").repartition("block").sortWithinPartitions("block", "place")
    return settled(dealt.mapInArrow(pack, "block long, begin long, x binary, y binary"), "blocks"), n


def _points(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for k in range(b.num_rows):
        yield b.column("block")[k].as_py(), b.column("begin")[k].as_py(), *(np.frombuffer(b.column(c)[k].as_buffer(), "<f8") for c in ("x", "y"))


def _buckets(z: np.ndarray, place: np.ndarray, bound: np.ndarray, at: np.ndarray) -> np.ndarray:
    """In which bucket values fall; buckets begin at (bound, at), in order of both."""
    low, high = np.searchsorted(bound, z, "left"), np.searchsorted(bound, z, "right")
    for i in np.flatnonzero(low < high):  # on a bound: by place
        low[i] += np.searchsorted(at[low[i] : high[i]], place[i], "right")
    return low


def _crossed(key: tuple, table: pa.Table) -> pa.Table:
    """t, and the pairs of different rows of a table of numbers (row, column, n) of which the earlier is in a later column."""
    row, column = (np.unique(table.column(c).to_numpy(), return_inverse=True)[1] for c in ("row", "column"))
    counts = np.zeros((int(row.max()) + 1, int(column.max()) + 1), np.int64)
    counts[row, column] = table.column("n").to_numpy()
    earlier = np.cumsum(counts, 0) - counts
    later = np.cumsum(earlier[:, ::-1], 1)[:, ::-1] - earlier
    return pa.table({"t": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([int((counts * later).sum())], pa.int64())})


class Blocks:
    """The steps of `median_slope` over blocks of one clock's points."""

    def __init__(self, blocks: DataFrame, n: int) -> None:
        self.blocks, self.n = blocks, n
        self.many = blocks.count()

    def _bounds(self, s: float) -> tuple[np.ndarray, np.ndarray]:
        """Where buckets of y - s * x begin, by a sample of the points: as many buckets as blocks."""
        rate = min(1.0, 64 * self.many / self.n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, begin, x, y in _points(b):
                    i = np.flatnonzero(np.random.default_rng([3, block]).random(len(x)) < rate)
                    yield pa.RecordBatch.from_arrays([pa.array(y[i] - s * x[i]), pa.array(begin + i)], ["z", "place"])

        rows = self.blocks.mapInArrow(run, "z double, place long").toArrow()
        z, place = rows.column("z").to_numpy(), rows.column("place").to_numpy()
        order = np.lexsort((place, z))[:: max(1, len(z) // self.many)][1:]
        return z[order], place[order]

    def below(self, ends: list[float]) -> list[int]:
        bounds = [self._bounds(s) for s in ends]

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, begin, x, y in _points(b):
                    place = begin + np.arange(len(x))
                    for t, s in enumerate(ends):
                        z = y - s * x
                        bucket = _buckets(z, place, *bounds[t])
                        order = np.argsort(bucket, kind="stable")
                        cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(z))
                        inner = swaps(bucket)
                        rows = [(t, int(bucket[order[i]]), block, int(j - i), inner if not i else 0, z[order[i:j]].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["t", "bucket", "block", "n", "inner", "z"])

        parts = settled(self.blocks.mapInArrow(split, "t long, bucket long, block long, n long, inner long, z binary"), "buckets")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, out = None, [], []
            for b in batches:
                for t, bucket, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                    if (t, bucket) != now:
                        if held:
                            out.append((now[0], swaps(np.concatenate(held))))
                        now, held = (t, bucket), []
                    held.append(np.frombuffer(z.as_buffer(), "<f8"))
            if held:
                out.append((now[0], swaps(np.concatenate(held))))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], ["t", "n"])

        dealt = parts.select("t", "bucket", "block", "z").repartition("t", "bucket").sortWithinPartitions("t", "bucket", "block")
        inside = dict(dealt.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n")).collect())
        inner = dict(parts.groupBy("t").agg(F.sum("inner")).collect())
        across = self._across(parts.select("t", "block", "bucket", "n"))
        return [inside.get(k, 0) + inner.get(k, 0) + across.get(k, 0) for k in range(len(ends))]

    def _across(self, table: DataFrame) -> dict[int, int]:
        """By t, the pairs of points of different blocks of which the earlier is in a later bucket. table: t, block, bucket, n.

        Blocks and buckets are cut into groups of some that lie together. Pairs within a group of blocks are counted in a task a group, those of
        different groups of blocks within a group of buckets likewise; for all others, the sums of groups do.
        """
        some = max(1, math.isqrt(self.many))
        table = table.withColumns({"blocks": F.floor(F.col("block") / some), "buckets": F.floor(F.col("bucket") / some)})
        coarse = settled(table.groupBy("t", "blocks", "bucket", "buckets").agg(F.sum("n").alias("n")), "coarse")
        count = lambda df, by, row, column: df.select("t", F.col(by).alias("by"), F.col(row).alias("row"), F.col(column).alias("column"), "n").groupBy("t", "by").applyInArrow(_crossed, "t long, n long")
        whole = coarse.groupBy("t", "blocks", "buckets").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0).cast("bigint"))
        counted = count(table, "blocks", "block", "bucket").unionByName(count(coarse, "buckets", "blocks", "bucket")).unionByName(count(whole, "all", "blocks", "buckets"))
        return dict(counted.groupBy("t").agg(F.sum("n")).collect())

    def sample(self, lo: float, hi: float, share: float, turn: int) -> np.ndarray:
        """Slopes between some points and a share of all points."""
        rate = min(1.0, SAMPLE / max(1e-9, share * ANCHORS * self.n))
        some = min(1.0, 2 * ANCHORS / self.n)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, _, x, y in _points(b):
                    i = np.flatnonzero(np.random.default_rng([5, turn, block]).random(len(x)) < some)
                    yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(y[i])], ["x", "y"])

        drawn = self.blocks.mapInArrow(draw, "x double, y double").toArrow()
        keep = np.random.default_rng(turn).permutation(drawn.num_rows)[:ANCHORS]
        ax, ay = (drawn.column(c).to_numpy()[keep] for c in ("x", "y"))

        def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, _, x, y in _points(b):
                    i = np.flatnonzero(np.random.default_rng([7, turn, block]).random(len(x)) < rate)
                    for at in range(0, len(i), 4096):
                        p = i[at : at + 4096]
                        dx = x[p][:, None] - ax[None, :]
                        use = dx != 0
                        s = (y[p][:, None] - ay[None, :])[use] / dx[use]
                        yield pa.RecordBatch.from_arrays([pa.array(s[(s >= lo) & (s < hi)])], ["s"])

        return self.blocks.mapInArrow(slopes, "s double").toArrow().column("s").to_numpy()

    def within(self, lo: float, hi: float) -> np.ndarray:
        """Points in order of y - lo * x are dealt to buckets; one that in y - hi * x is above the least of a later bucket visits that, as it has swapped there."""
        low = lo if lo > -math.inf else 0.0
        bound, at = self._bounds(low) if lo > -math.inf else (None, None)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, begin, x, y in _points(b):
                    place = begin + np.arange(len(x))
                    bucket = _buckets(y - low * x, place, bound, at) if bound is not None else np.full(len(x), block)
                    order = np.argsort(bucket, kind="stable")
                    cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(x))
                    z = y - hi * x if hi < math.inf else -x
                    rows = [(int(bucket[o[0]]), float(z[o].min()), *(v[o].tobytes() for v in (x, y, place.astype("<i8")))) for o in (order[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "least", "x", "y", "place"])

        parts = settled(self.blocks.mapInArrow(split, "bucket long, least double, x binary, y binary, place binary"), "bracket")
        least = dict(parts.groupBy("bucket").agg(F.min("least")).collect())  # a number a bucket
        names = np.array(sorted(least))
        lows = np.array([least[k] for k in names])

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    own = b.column(0)[k].as_py()
                    x, y, place = (np.frombuffer(b.column(i)[k].as_buffer(), d) for i, d in ((2, "<f8"), (3, "<f8"), (4, "<i8")))
                    z = y - hi * x if hi < math.inf else -x
                    rows = [(own, 0, x.tobytes(), y.tobytes(), place.tobytes())]
                    for other in np.flatnonzero((names > own) & (lows < z.max())):
                        i = np.flatnonzero(z > lows[other])
                        rows.append((int(names[other]), 1, x[i].tobytes(), y[i].tobytes(), place[i].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "visits", "x", "y", "place"])

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, own, guests = None, [], []
            for b in batches:
                for k in range(b.num_rows):
                    bucket = b.column(0)[k].as_py()
                    if bucket != now:
                        if own:
                            yield made(own, guests)
                        now, own, guests = bucket, [], []
                    (guests if b.column(1)[k].as_py() else own).append([np.frombuffer(b.column(i)[k].as_buffer(), d) for i, d in ((2, "<f8"), (3, "<f8"), (4, "<i8"))])
            if own:
                yield made(own, guests)

        def made(own: list, guests: list) -> pa.RecordBatch:
            x, y, place = (np.concatenate(c) for c in zip(*own, strict=True))
            order = np.lexsort((place, y - low * x)) if lo > -math.inf else np.argsort(place)
            x, y = x[order], y[order]
            z = y - hi * x if hi < math.inf else -x
            i, j = swapped(z) if hi < math.inf else np.triu_indices(len(x), 1)
            s = [_slopes(x, y, i[x[i] != x[j]], j[x[i] != x[j]])]
            if guests:
                gx, gy, _ = (np.concatenate(c) for c in zip(*guests, strict=True))
                gz = gy - hi * gx if hi < math.inf else -gx
                by = np.argsort(z, kind="stable")
                many = np.searchsorted(z[by], gz, "left")
                i = np.repeat(np.arange(len(gx)), many)
                j = by[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                use = gx[i] != x[j]
                s.append((y[j[use]] - gy[i[use]]) / (x[j[use]] - gx[i[use]]))
            s = np.concatenate(s)
            return pa.RecordBatch.from_arrays([pa.array(s[(s >= lo) & (s < hi)])], ["s"])

        dealt = parts.mapInArrow(visit, "bucket long, visits long, x binary, y binary, place binary").repartition("bucket").sortWithinPartitions("bucket", "visits")
        return dealt.mapInArrow(pairs, "s double").toArrow().column("s").to_numpy()


def distributed(points: DataFrame, block: int | None = None, made: int = MADE) -> float | None:
    """The median slope of any number of points (x, y); none without two x."""
    blocks, n = blocked(points, block)
    same = points.where("x is not null and y is not null").groupBy("x").count().agg(F.coalesce(F.sum(F.expr("cast(count as decimal(38, 0)) * (count - 1) div 2")), F.lit(0))).first()[0]
    total = n * (n - 1) // 2 - int(same)
    if not total:
        return None
    steps = Blocks(blocks, n)
    scale = points.where("x is not null and y is not null").agg((F.max("y") - F.min("y")) / (F.max("x") - F.min("x"))).first()[0]
    return median_slope(total, steps.below, steps.sample, steps.within, float(scale), made)


def middle(values: DataFrame, column: str) -> float | None:
    """The exact median of a column, by its values' places in order."""
    placed = settled(ordered.scanned(values.select(F.col(column).cast("double").alias("v"), F.lit(1).cast("long").alias("one")).where("v is not null"), [], ["v"], ["one"]), "placed")
    n = placed.count()
    return placed.where(F.col("before_one").isin((n - 1) // 2, n // 2)).agg(F.avg("v")).first()[0] if n else None
