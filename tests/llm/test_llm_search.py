"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tracewell.llm import lexical

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def by_force(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = Counter(t for i, x in items if i == item for t in terms(x))
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * N // L
            s = sum(k * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    pool = ["Ärger", "zoo", "ZOO", "a1", "x_y", "é", "日本", "the", "of", "İ", "K"] + [f"w{i}" for i in range(40)]
    return [(rng.choice([i, None]) if i % 17 == 0 else i, " ".join(rng.choice(pool[: rng.choice([9, 51])]) for _ in range(rng.randrange(0, 30)))) for i in range(n)]


def test_search_by_force(spark):
    docs = made(1, 300) + [(3, "the zoo"), (3, "the zoo"), (900, None), (901, ""), (902, "\x00 -- \t"), (903, "zoo " * 30_000)]
    items = [(1, "zoo the É w3 w3"), (2, None), (3, ""), (4, "never seen"), (None, "w5 日本 a1"), (1, "of"), (5, "İ K x-y")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("row", "term", "bucket", "score", "n")}).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    blocks = lexical.index(d)
    for top, few in ((20, lexical.FEW), (7, 0)):  # by broadcast, by a shuffle
        got = [tuple(r) for r in lexical.search(blocks, q, top, few).collect()]
        assert sorted(got, key=str) == by_force(docs, items, top)


def test_blocks_of_a_frequent_term_are_split(spark):
    """No row of the index holds all postings of a term that is in every document."""
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the "), F.repeat(F.col("id").cast("string"), 500)).alias("text")).repartition(8)
    held = lexical.index(d).where("term = 'the'")
    assert held.count() >= 8 and held.agg(F.sum("n_docs")).first()[0] == 2000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(lexical.index(none), items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.search(lexical.index(some), items.limit(0)).count() == 0
