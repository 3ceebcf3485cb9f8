"""Scans over ranges against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ordered


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("rows", [3, 10_000])
def test_scans_by_force(spark, seed, rows):
    """Keys over many ranges, keys within one, null keys, null values; batches smaller than ranges."""
    rng = random.Random(seed)
    data = [(rng.choice(["a", "a", "a", "b", None, f"k{rng.randrange(30)}"]), i, rng.choice([None, rng.randrange(-9, 9)]), rng.random(), rng.choice([None, None, f"v{i}"])) for i in range(300)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, at long, n long, x double, v string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        for keys in (["k"], []):
            got = {r["at"]: r for r in ordered.scanned(df, keys, ["at"], ["n", "x"], ["v"], partitions=9).collect()}
            state = {}
            for k, at, n, x, v in sorted(data, key=lambda r: r[1]):
                s = state.setdefault(k if keys else 0, [0, 0.0, None])
                s[2] = v or s[2]
                assert (got[at]["before_n"], got[at]["last_v"], got[at]["n"], got[at]["v"]) == (s[0], s[2], n, v) and got[at]["before_x"] == pytest.approx(s[1])
                s[0] += n or 0
                s[1] += x
            assert len(got) == 300
        assert ordered.scanned(df.limit(0), ["k"], ["at"], ["n"]).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_lookup_by_force(spark):
    rng = random.Random(9)
    sizes = [rng.randrange(1, 50) for _ in range(60)]
    begin, at = [], 0
    for s in sizes:
        begin.append(at)
        at += s + rng.choice([0, 0, 5])  # some holes
    points = [rng.randrange(-5, at + 20) for _ in range(500)] + begin
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "id long, place long")
    m = spark.createDataFrame(list(zip(range(60), begin, sizes, strict=True)), "member long, begin long, size long")
    got = {r["id"]: r["member"] for r in ordered.looked_up(p, "place", m, "begin", "size", partitions=7).collect()}
    want = {i: k for i, x in enumerate(points) for k in range(60) if begin[k] <= x < begin[k] + sizes[k]}
    assert got == want


def test_no_window_over_everything(spark):
    """The plan of a running sum has range partitions and no window."""
    df = ordered.scanned(spark.range(1000).withColumn("n", F.lit(1).cast("long")), [], ["id"], ["n"])
    assert "Window" not in df._jdf.queryExecution().toString() and df.where("before_n <> id").count() == 0
