"""Many small groups, each a call of a function.

A group of `applyInPandas` costs some milliseconds by itself, whatever its size, and adaptive execution, which goes by bytes,
puts thousands of costly groups into one task. Here the rows of a key lie next to each other in their partition, in batches that
hold many groups, and partitions are as many as were asked for. What a task holds is one group and a batch.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Values, those in arrays counted one by one, that a batch of results holds before it is sent.
SENT = 1 << 18


def tasks(df: DataFrame) -> int:
    """Partitions for rows that cost more than their bytes say; a number that is given isn't coalesced for having few bytes."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def values(column: pa.Array) -> list:
    """The column's values in Python, arrays as lists."""
    if column.null_count:
        return column.to_pylist()
    if pa.types.is_list(column.type):
        flat, ends = values(column.flatten()), column.offsets.to_numpy()
        ends = (ends - ends[0]).tolist()
        return [flat[a:z] for a, z in itertools.pairwise(ends)]
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    return column.to_numpy().tolist() if number else column.to_pylist()


def column_of(some: tuple, kind: pa.DataType) -> pa.Array:
    """The other way: a column of values, arrays by one flat array."""
    if not pa.types.is_list(kind) or None in some:
        return pa.array(some, kind)
    ends = np.cumsum([0, *map(len, some)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(itertools.chain.from_iterable(some)), kind.value_type), kind)


def by_key(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each key, the first `keys` columns, and its rows without it; a key's rows follow each other, over batches too."""
    rows = itertools.chain.from_iterable(zip(*map(values, b.columns), strict=True) for b in batches)
    for key, some in itertools.groupby(rows, lambda r: r[:keys]):
        yield key, [r[keys:] for r in some]


def in_groups(df: DataFrame, keys: int, run: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """The rows that run makes of each key and its rows, in no order. Keys are the first `keys` columns of df."""
    made = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column_of(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], made.names)

        out: list[tuple] = []
        size = 0
        for key, rows in by_key(batches, keys):
            for r in run(key, rows):
                out.append(r)
                size += sum(len(v) if isinstance(v, list) else 1 for v in r)
                if size >= SENT:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    key_columns = df.columns[:keys]
    return df.repartition(tasks(df), *key_columns).sortWithinPartitions(*key_columns).mapInArrow(work, schema)
