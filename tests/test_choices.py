"""Disjoint choices against all choices."""

import itertools
import random
import time

from pyspark.sql import functions as F

from tracewell.operators import choices, groups, paths


def by_force(options):
    """All disjoint choices in order, as (key, chosen)."""
    starts = sorted(options)
    out = []
    for pick in itertools.product(*(options[s] for s in starts)):
        if len({f for p, *_ in pick for f in p}) == sum(len(p) for p, *_ in pick):
            sums = (-sum(len(p) for p, *_ in pick), *map(sum, zip(*(c for _, *c in pick), strict=True)))
            out.append((sums, [(s, list(p), *c) for s, (p, *c) in zip(starts, pick, strict=True)]))
    return sorted(out, key=lambda x: (x[0], [p for _, p, *_ in x[1]]))


def made(rng, starts, options, pool):
    return {s: [([s, *sorted(rng.sample(range(100, 100 + pool), rng.randrange(4)))], rng.randrange(2), rng.randrange(3), rng.randrange(9) / 4) for _ in range(options)] for s in range(starts)}


def test_search_by_force():
    rng = random.Random(5)
    for trial in range(300):
        options = made(rng, rng.randrange(1, 5), 4, rng.choice([4, 8]))
        want = by_force(options)
        got, cut = choices.search(options)
        assert not cut and len(got) == min(2, len(want))
        assert [k for k, _ in got] == [k for k, _ in want[:2]]
        if want:
            assert [(s, p) for s, p, *_ in got[0][1]] == [(s, p) for s, p, *_ in want[0][1]]
            assert tuple(map(sum, zip(*(c for _, _, *c in got[0][1]), strict=True))) == got[0][0][1:]
        if trial % 3 == 0:  # cut early: what there is is disjoint
            got, cut = choices.search(options, 2)
            for _, chosen in got:
                used = [f for _, p, *_ in chosen for f in p]
                assert len(used) == len(set(used))


def frame(spark, problems):
    rows = [(k, s, list(p), *c) for k, options in problems.items() for s, some in options.items() for p, *c in some]
    return spark.createDataFrame(rows, "problem long, start long, fragments array<long>, unresolved int, ambiguous int, cost double")


def test_problems_by_force(spark):
    """Components are searched by themselves, and the margin is that of the whole problem."""
    rng = random.Random(8)
    problems = {k: made(rng, 6, 3, rng.choice([9, 30])) for k in range(25)}
    got = {}
    for r in choices.select_disjoint(frame(spark, problems)).collect():
        got.setdefault(r["problem"], []).append(r)
    solved = 0
    for k, options in problems.items():
        rows = sorted(got[k], key=lambda r: r["start"])
        assert [r["start"] for r in rows] == list(range(6)) and not rows[0]["cut"]
        want = by_force(options)
        if not want:
            assert any(r["fault"] == choices.CLASH and r["fragments"] is None for r in rows)
            continue
        solved += 1
        assert [(r["start"], r["fragments"]) for r in rows] == [(s, p) for s, p, *_ in want[0][1]]
        margin = max(0.0, want[1][0][-1] - want[0][0][-1]) if len(want) > 1 and want[1][0][0] == want[0][0][0] else None
        assert {r["margin"] for r in rows} == {margin}
    assert solved > 10


def test_a_clash_ends_soon_and_alone(spark):
    """Eight free starts of eight options each, and two that always clash: the eight have their best paths, the two a fault."""
    options = {s: [([s, 1000 * s + i], 0, 0, float(i)) for i in range(1, 9)] for s in range(1, 9)}
    options |= {s: [([s, 50, 60 + i], 0, 0, float(i)) for i in range(8)] for s in (20, 21)}
    rows = {r["start"]: r for r in choices.select_disjoint(frame(spark, {0: options, 1: {1: [([1], 0, 0, 1.0)]}})).where("problem = 0").collect()}
    assert [rows[s]["fragments"] for s in range(1, 9)] == [[s, 1000 * s + 1] for s in range(1, 9)] and rows[1]["margin"] == 1.0
    assert all(rows[s]["fault"] == choices.CLASH and rows[s]["fragments"] is None for s in (20, 21))
    began = time.perf_counter()
    got, cut = choices.search(options)
    assert not got and not cut and time.perf_counter() - began < 1


def test_a_long_search_is_cut():
    """Thirty starts that compete for too few fragments: some choice within the budget, and it says that it was cut."""
    rng = random.Random(2)
    options = {s: [([s, *sorted(rng.sample(range(100, 140), 2))], 0, 0, float(rng.randrange(50))) for _ in range(6)] + [([s], 0, 0, 0.0)] for s in range(30)}
    began = time.perf_counter()
    got, cut = choices.search(options, 2000)
    used = [f for _, p, *_ in got[0][1] for f in p]
    assert cut and len(used) == len(set(used)) and time.perf_counter() - began < 20


def test_components_by_force(spark):
    rng = random.Random(4)
    rows = [(k, s, rng.randrange(40)) for k in range(3) for s in range(30) for _ in range(rng.choice([1, 2]))] + [(9, s, f) for s in range(60) for f in (s, s + 1)]
    label = {}
    for k in {r[0] for r in rows}:
        root = {s: s for p, s, _ in rows if p == k}
        changed = True
        while changed:
            changed = False
            for _, s, f in (r for r in rows if r[0] == k):
                for _, t, g in (r for r in rows if r[0] == k and r[2] == f):
                    if root[t] < root[s]:
                        root[s], changed = root[t], True
        label |= {(k, s): x for s, x in root.items()}
    got = choices.components(spark.createDataFrame(rows, "problem long, start long, fragment long"))
    assert {(r["problem"], r["start"]): r["label"] for r in got.collect()} == label
    assert got.where(F.col("problem") == 9).agg(F.max("label")).first()[0] == 0


def test_lone_starts_by_force(spark):
    """Starts that share nothing: best paths and the problem's margin, with ties, equal paths and single options."""
    rng = random.Random(11)
    problems = {}
    for k in range(60):
        some = {s: [([s, *sorted(rng.sample(range(100 * s, 100 * s + 5), rng.randrange(3)))], rng.randrange(2), rng.randrange(2), rng.randrange(4) / 4) for _ in range(rng.randrange(1, 5))] for s in range(1, rng.randrange(2, 5))}
        problems[k] = some | ({s: [([s, 7, s * 1000 + i], 0, 0, float(i)) for i in range(2)] for s in (50, 51, 52)} if k % 4 == 0 else {})
    got = {}
    for r in choices.select_disjoint(frame(spark, {k: o for k, o in problems.items() if 50 not in o})).collect():
        got.setdefault(r["problem"], []).append(r)
    for k, options in problems.items():
        if 50 in options:
            continue
        want, rows = by_force(options), sorted(got[k], key=lambda r: r["start"])
        assert [(r["start"], r["fragments"]) for r in rows] == [(s, p) for s, p, *_ in want[0][1]]
        assert tuple(sum(r[c] for r in rows) for c in ("unresolved", "ambiguous", "cost")) == want[0][0][1:]
        margin = max(0.0, want[1][0][-1] - want[0][0][-1]) if len(want) > 1 and want[1][0][0] == want[0][0][0] else None
        assert {(r["margin"], r["cut"], r["fault"]) for r in rows} == {(margin, False, None)}
    mixed = choices.select_disjoint(frame(spark, {k: o for k, o in problems.items() if 50 in o})).collect()
    assert {(r["start"], r["fault"]) for r in mixed if r["start"] >= 50} == {(s, choices.CLASH) for s in (50, 51, 52)}
    assert all(r["fragments"] and r["fault"] is None for r in mixed if r["start"] < 50)


def test_small_problems_dont_cost_a_group_each(spark):
    """Thousands of small problems are dealt to all tasks, many to a batch, and only starts that compete are searched."""
    rows = [(k, s, [s, *(10 * s + i for i in range(3)), 1000 + i][: 5 if k % 500 == 0 else 4], float(i)) for k in range(2000) for s in (1, 2) for i in range(2)]
    found = spark.createDataFrame(rows, "problem long, start long, fragments array<long>, cost double")
    chosen = choices.select_disjoint(found)
    assert "FlatMapGroups" not in chosen._jdf.queryExecution().toString()
    got = chosen.collect()
    assert len(got) == 4000 and all(r["fault"] is None for r in got)
    edges = spark.createDataFrame([(k, 1, 2, 1.0) for k in range(500)], "problem long, src long, dst long, score double")
    nodes = spark.createDataFrame([(k, n, n, n == 1) for k in range(500) for n in (1, 2)], "problem long, node long, index int, is_start boolean")
    starts = nodes.where("is_start").select("problem", F.col("node").alias("start"))
    for df, path in ((paths.hypotheses(starts, edges), "fragments"), (paths.local_chains(starts, edges), "fragments"), (paths.solve_flows(nodes, edges, 20.0), "nodes")):
        by_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("p"), F.max(path).alias("q")).collect()
        assert sum(r["n"] for r in by_task) == 500 and all(r["p"] == r["q"] == [1, 2] for r in by_task)
        assert len(by_task) > 8 and max(r["n"] for r in by_task) < 100


def test_groups_over_batches(spark):
    """Groups are whole wherever batches end; a null is a key of its own; lists and nulls come as they are."""
    rows = [(k if k < 6 else None, "ab"[j % 2], [j] * (j % 4) if j % 5 else None, j / 2) for k in range(7) for j in range(17)]
    df = spark.createDataFrame(rows, "k int, s string, l array<long>, x double")
    want = {}
    for k, s, l, x in rows:
        want.setdefault((k, s), []).append((l, x))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        run = lambda key, some: [(*key, len(some), [i for l, _ in some for i in l or ()], None if key[0] is None else max(x for _, x in some))]
        got = groups.in_groups(df, 2, run, "k int, s string, n long, l array<long>, x double").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(want)
    for r in got:
        some = want[r["k"], r["s"]]
        assert r["n"] == len(some) and sorted(r["l"]) == sorted(i for l, _ in some for i in l or ())
        assert r["x"] == (None if r["k"] is None else max(x for _, x in some))
