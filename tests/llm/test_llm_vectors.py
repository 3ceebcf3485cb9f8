"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import vectors

RNG = np.random.default_rng(7)


def around(centre, n, noise):
    x = centre + noise * RNG.standard_normal((n, len(centre)))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_force(rows):
    """vec_id, links, component and kept of rows (vec_id, list)."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for size in {len(rows[i][1]) for i in good}:
        at = [i for i in good if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in at])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        linked = x @ x.T >= 0.95
        for a in range(len(at)):
            links[at[a]] = int(linked[a].sum()) - 1
            for b in np.flatnonzero(linked[a]):
                p, q = top(at[a]), top(at[b])
                root[max(p, q)] = min(p, q)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[top(i)] = min(low.get(top(i), k), k)
    return sorted([(k, links[i], low[top(i)] if k is not None else None, k is None or k == low[top(i)]) for i, (k, _) in enumerate(rows)], key=str)


def made():
    c = around(np.zeros(32) + 1, 6, 2.0)
    groups = [around(c[0], 120, 0.02), around(c[1], 60, 0.045), around(c[2], 3, 0.03), RNG.standard_normal((150, 32)), c[3:4], c[3:4] * 5, np.repeat(c[4:5], 40, 0)]
    # a chain: neighbours are linked, those further off aren't
    angle = 0.25 * np.arange(12)
    chain = np.zeros((12, 32))
    chain[:, 0], chain[:, 1] = np.cos(angle), np.sin(angle)
    v = np.concatenate([*groups, chain]).tolist()
    ids = RNG.permutation(len(v)).tolist()
    rows = list(zip(ids, v, strict=True))
    odd = [None, [], [0.0] * 32, [None, *([1.0] * 31)], [float("nan"), *([1.0] * 31)], [float("inf"), *([1.0] * 31)], [1.0, 0.0], [0.99, 0.01], [1e300, 1e300], [1e-300, 1e-300]]
    return rows + [(1000 + i, x) for i, x in enumerate(odd)] + [(None, v[0]), (5, v[0]), (5, v[0]), (2000, v[3])]


@pytest.mark.parametrize("held", [vectors.HELD, 8])
def test_vectors_by_force(spark, held):
    rows = made()
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("node", "root", "label", "class", "h1")}).repartition(5)
    assert sorted((tuple(r) for r in vectors.near_vectors(d, held).collect()), key=str) == by_force(rows)


def test_gathering_before_the_shuffle_loses_nothing(spark):
    """One group of near copies with a third of all rows, in large batches: few of its rows reach a bucket."""
    c = around(np.ones(16), 1, 1.0)[0]
    rows = list(enumerate(np.concatenate([around(c, 600, 0.03), RNG.standard_normal((1200, 16))]).tolist()))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    made_, kind = vectors.prepared(d)
    b = vectors.buckets(made_.where("data is not null"), kind, 10, 0, 4)
    hot = b.where("other is null").groupBy("key").count().agg(F.max("count")).first()[0]
    assert hot < 150 and b.count() == 4 * 1800
    assert sorted((tuple(r) for r in vectors.near_vectors(d, 100).collect()), key=str) == by_force(rows)


def test_plan():
    assert vectors.plan(10) == vectors.plan(1_000_000) == (10, 16)
    depth, tables = vectors.plan(10**9)
    assert depth > 10 and (1 - vectors.ALIKE**depth) ** tables <= vectors.MISS


def test_recall_at_the_threshold():
    """Of pairs at cosine 0.95 at least 0.98 share a bucket and pass the sketch."""
    n = 1500
    a = around(np.zeros(64), n, 1.0)
    o = RNG.standard_normal((n, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    signs, lines, shift = vectors._directions(64, *vectors.plan(n))
    at = [np.floor((x @ lines + shift) / vectors.STEP).reshape(n, 16, 10) for x in (a, b)]
    bits = (np.packbits(a @ signs > 0, axis=1) ^ np.packbits(b @ signs > 0, axis=1)).view(np.uint64)
    assert ((at[0] == at[1]).all(2).any(1) & (np.bitwise_count(bits).sum(1) <= vectors.NEAR)).mean() >= 0.98


def test_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(none).count() == 0
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.near_vectors(one).collect()] == [(1, 0, 1, True)]
