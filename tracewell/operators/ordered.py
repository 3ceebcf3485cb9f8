"""Sequence analytics that don't need a key's rows in one task.

A key's rows are cut into blocks of its order column; windows run within blocks, and what blocks hand on, a row
each, is windowed by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..session import settled

BLOCK = 1 << 20


def blocked(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(order) / block))


def handed_on(df: DataFrame, keys: list[str], sums: dict[str, Column], over: str) -> DataFrame:
    """df with columns of what all earlier blocks of the key hand on: `over` is the aggregate (max or last) of the blocks' `sums`."""
    each = df.groupBy(*keys, "__block").agg(*(x.alias(n) for n, x in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    take = (lambda n: F.max(n).over(before)) if over == "max" else (lambda n: F.last(n, True).over(before))
    handed = each.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__block").alias("__b"), *(take(n).alias(n) for n in sums))
    same = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(handed, same).drop("__b", *(f"__k{i}" for i in range(len(keys))))


def previous(df: DataFrame, keys: list[str], order: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """df with prev_<value> of the row before, by order and then by the values; null for a key's first."""
    row = F.struct(order, *(v for v in values if v != order))
    x = handed_on(blocked(df, order, block), keys, {"__last": F.max(row)}, "last")
    inside = F.lag(row).over(Window.partitionBy(*keys, "__block").orderBy(row))
    before = F.coalesce(inside, F.col("__last"))
    return x.withColumn("__before", before).withColumns({f"prev_{v}": F.col(f"__before.{v}") for v in values}).drop("__before", "__last", "__block")


def scanned(df: DataFrame, keys: list[str], order: list[str], sums: list[str] = (), lasts: list[str] = (), partitions: int | None = None) -> DataFrame:
    """df with before_<v>, the sum of v over the key's earlier rows, and last_<v>, the last v that isn't null in the key's rows so far.

    Rows are dealt in ranges of keys and order, so a key may be in many tasks; a task scans its range in a stream. What a
    range hands on is a row, and these rows are scanned on the driver: as many as there are partitions. Rows equal in keys and
    order come in any order, once and for all, as ranges are stored. Sums are longs or doubles; null counts as 0.
    """
    spark = df.sparkSession
    columns = list(df.columns)
    for v in sums:
        df = df.withColumn(f"before_{v}", F.coalesce(F.col(v), F.lit(0)))
    for v in lasts:
        df = df.withColumn(f"last_{v}", F.col(v))
    # two more rows a range: its first one, and what it hands on
    out = StructType([*df.schema.fields, StructField("__range", IntegerType()), StructField("__head", BooleanType()), StructField("__kind", IntegerType())])
    names = out.fieldNames()

    def row(columns: list[pa.Array], number: int, head: bool, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, pa.array([number], pa.int32()), pa.array([head]), pa.array([kind], pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        key: tuple | None = None
        head, total, last, tail = True, {v: 0 for v in sums}, {v: None for v in lasts}, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            own = [b.column(k) for k in keys]
            new = np.zeros(n, bool)
            for c in own:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= np.diff(codes) != 0
            first = tuple(c[0].as_py() for c in own)
            if key is None:
                yield row([c.slice(0, 1) for c in b.columns], number, True, 1)
            elif first != key:
                new[0], head = True, False
            group = np.cumsum(new)
            begin = np.append(0, np.flatnonzero(new[1:]) + 1)
            start = begin[np.searchsorted(begin, np.arange(n), "right") - 1]
            goes_on = group == 0  # the key of the batch before
            data = {c: b.column(c) for c in b.schema.names}
            for v in sums:
                x = data[f"before_{v}"].to_numpy(zero_copy_only=False)
                sum_ = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
                before = sum_[:-1] - sum_[start] + np.where(goes_on, total[v], 0)
                total[v] = (before[-1] + x[-1]).item()
                data[f"before_{v}"] = pa.array(before, data[f"before_{v}"].type)
            for v in lasts:
                c = data[f"last_{v}"]
                at = np.where(c.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1)
                at = np.maximum.accumulate(at)
                none = at < start
                filled = c.take(pa.array(np.where(none, 0, at), mask=none))
                if last[v] is not None and (none & goes_on).any():
                    filled = pc.if_else(pa.array(none & goes_on), last[v], filled)
                last[v] = filled[n - 1] if filled[n - 1].is_valid else None
                data[f"last_{v}"] = filled
            heads = pa.array(goes_on & head)
            key = tuple(c[n - 1].as_py() for c in own)
            head = bool(goes_on[-1] and head)
            tail = {c: a.slice(n - 1, 1) for c, a in data.items()}
            yield pa.RecordBatch.from_arrays([*data.values(), pa.array(np.full(n, number, np.int32)), heads, pa.array(np.zeros(n, np.int32))], names)
        if tail is not None:
            tail |= {f"before_{v}": pa.array([total[v]], tail[f"before_{v}"].type) for v in sums}
            yield row(list(tail.values()), number, head, 2)

    by = [*keys, *order]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    held = settled(dealt.sortWithinPartitions(*by).mapInArrow(run, out), "scan")
    made = [f"before_{v}" for v in sums] + [f"last_{v}" for v in lasts]
    ends: dict[int, dict[int, Row]] = {}
    for r in held.where("__kind > 0").select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), *made, "__range", "__head", "__kind").collect():
        ends.setdefault(r["__range"], {})[r["__kind"]] = r
    nothing = {c: (0.0 if out[c].dataType.typeName() == "double" else 0) if c.startswith("before_") else None for c in made}
    handed, key, now = [], None, {}
    for number in sorted(ends):
        first, tail = ends[number][1], ends[number][2]
        k = tuple(first[f"k{i}"] for i in range(len(keys)))
        came = dict(now) if key == k else {}
        handed.append((number, *(came.get(c, nothing[c]) for c in made)))
        key = tuple(tail[f"k{i}"] for i in range(len(keys)))
        kept = came if tail["__head"] else {}
        now = {c: tail[c] + kept.get(c, nothing[c]) if c.startswith("before_") else (tail[c] if tail[c] is not None else kept.get(c)) for c in made}
    schema = StructType([StructField("__range", IntegerType()), *(StructField(f"__{c}", out[c].dataType) for c in made)])
    rows = held.where("__kind = 0").join(F.broadcast(spark.createDataFrame(handed, schema)), "__range")
    add = {f"before_{v}": F.col(f"before_{v}") + F.when(F.col("__head"), F.col(f"__before_{v}")).otherwise(0) for v in sums}
    fill = {f"last_{v}": F.coalesce(f"last_{v}", F.when(F.col("__head"), F.col(f"__last_{v}"))) for v in lasts}
    return rows.withColumns(add | fill).select(*columns, *made)


def looked_up(points: DataFrame, at: str, intervals: DataFrame, begin: str, size: str, partitions: int | None = None) -> DataFrame:
    """points with the columns of the interval [begin, begin + size) that their `at` is in; those in none are left out.

    Intervals are disjoint; columns of the two have different names. Both are dealt by ranges of place, and a point takes the last interval that begins up to it.
    """
    mine = F.struct(*points.columns)
    theirs = F.struct(*intervals.columns)
    both = points.select(F.col(at).alias("__place"), F.lit(1).alias("__after"), mine.alias("__point"), F.lit(None).cast(intervals.select(theirs).schema[0].dataType).alias("interval"))
    both = both.unionByName(intervals.select(F.col(begin).alias("__place"), F.lit(0).alias("__after"), F.lit(None).cast(points.select(mine).schema[0].dataType).alias("__point"), theirs.alias("interval")))
    found = scanned(both, [], ["__place", "__after"], lasts=["interval"], partitions=partitions).where("__point is not null and last_interval is not null")
    return found.select("__point.*", "last_interval.*").where(F.col(at) < F.col(begin) + F.col(size))
