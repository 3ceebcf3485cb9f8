"""Medians of slopes against all pairs."""

import numpy as np
import pytest

from tracewell.operators import slopes, timebase

RNG = np.random.default_rng(11)


def all_pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    use = x[i] != x[j]
    return float(np.median((y[j] - y[i])[use] / (x[j] - x[i])[use])) if use.any() else None


def made(kind, n):
    x = np.sort(RNG.uniform(0, 1e6, n))
    if kind == "noise":
        return x, 1.0001 * x + RNG.standard_cauchy(n)
    if kind == "ties":
        x = np.floor(x / 1e5)
        return x, np.floor(RNG.uniform(0, 5, n))
    if kind == "exact":
        return np.arange(n) * 4.0, np.arange(n) * 2.0 + 7
    if kind == "falling":
        return x, -3 * x + RNG.uniform(-1, 1, n)
    if kind == "steps":
        return x, x + np.where(np.arange(n) > n // 3, 5e5, 0)
    return np.full(n, 3.0), RNG.uniform(0, 1, n)


@pytest.mark.parametrize("n", [2, 3, 57, 600])
def test_swaps_by_force(n):
    for values in (RNG.integers(0, 9, n), RNG.uniform(0, 1, n), np.arange(n), -np.arange(n)):
        i, j = np.triu_indices(n, 1)
        want = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if values[a] > values[b]}
        a, b = slopes.swapped(values)
        assert slopes.swaps(values) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


@pytest.mark.parametrize("kind", ["noise", "ties", "exact", "falling", "steps", "upright"])
def test_held_clocks_by_force(kind):
    for n in (1, 2, 5, 400, 2000):
        x, y = made(kind, n)
        want = all_pairs(x, y)
        for most in (1 << 21, 3 * n):
            got = slopes.in_memory(x, y, most)
            assert got == want if want is None else got == pytest.approx(want, rel=1e-11, abs=1e-12)


@pytest.mark.parametrize("kind", ["noise", "ties", "exact", "falling", "steps", "upright"])
def test_blocked_clocks_by_force(spark, kind):
    """Nine blocks; few pairs are made at the end."""
    n = 2000
    x, y = made(kind, n)
    order = RNG.permutation(n)
    points = spark.createDataFrame(list(zip(x[order].tolist(), y[order].tolist(), strict=True)), "x double, y double")
    want = all_pairs(x, y)
    got = slopes.distributed(points, 230, 4 * n)
    assert got == want if want is None else got == pytest.approx(want, rel=1e-11, abs=1e-12)
    if kind == "noise":
        blocks, _ = slopes.blocked(points, 230)
        assert blocks.count() == 9
        steps = slopes.Blocks(blocks, n)
        i, j = np.triu_indices(n, 1)
        s = (y[j] - y[i]) / (x[j] - x[i])
        ends = sorted(np.quantile(s, [0.0, 0.3, 0.5, 0.999]) + 1e-9)
        assert steps.below(list(ends)) == [int((s < e).sum()) for e in ends]
        for lo, hi in ((ends[1], ends[2]), (-np.inf, ends[1]), (ends[3], np.inf)):
            assert np.allclose(np.sort(steps.within(lo, hi)), np.sort(s[(s >= lo) & (s < hi)]))
        assert slopes.middle(points, "y") == pytest.approx(np.median(y))


def test_clocks_of_all_sizes_agree(spark):
    rows = [(k, float(x), float(1.00002 * x + e)) for k, n in (("a", 900), ("b", 30), (None, 500), ("c", 1)) for x, e in zip(RNG.uniform(0, 1e5, n), RNG.normal(0, 0.3, n), strict=True)] + [("a", None, 1.0), ("d", 4.0, None)]
    a = spark.createDataFrame(rows, "k string, x double, y double")
    small = {r["k"]: r for r in timebase.fit(a, ["k"]).collect()}
    large = {r["k"]: r for r in timebase.fit(a, ["k"], held=100, block=64).collect()}
    assert set(small) == set(large) == {"a", "b", "c", None}
    for k, r in small.items():
        for c in ("slope", "intercept", "drift_ppm", "max_residual"):
            assert large[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-6)
        assert (large[k]["anchors"], large[k]["status"]) == (r["anchors"], r["status"])
    assert small["a"]["anchors"] == 900 and small["c"]["status"] == "REVIEW" and small["c"]["slope"] == 1.0


def test_the_driver_gets_no_table_of_blocks(spark, monkeypatch):
    """Swaps between blocks are counted by tasks; equal to all pairs."""
    from pyspark.sql.classic.dataframe import DataFrame

    n = 3000
    x, y = made("noise", n)
    blocks, _ = slopes.blocked(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), 100)
    sent, to_arrow = [], DataFrame.toArrow

    def watched(self):
        sent.append(self.columns)
        return to_arrow(self)

    monkeypatch.setattr(DataFrame, "toArrow", watched)
    ends = [0.5, 1.0001, 2.0]
    assert slopes.Blocks(blocks, n).below(ends) == [slopes.swaps(y - s * x) for s in ends]
    assert sent and all("bucket" not in columns for columns in sent)
