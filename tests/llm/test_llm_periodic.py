"""Runs of words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import periodic, tandem

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def by_force(x):
    """start, length, smallest period of all runs of two periods or more."""
    out, n = [], len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i >= q and not any(s <= i and s + m >= j + q for s, m, _ in out):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def listed(found):
    return list(zip(*(v.tolist() for v in found), strict=True))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50), st.integers(0, 50), st.integers(1, 12))
def test_runs_by_force(x, a, p):
    x = [v if i < a else x[a + (i - a) % p] if a + (i - a) % p < len(x) else v for i, v in enumerate(x)]
    assert listed(tandem.runs(np.array(x, np.int64))) == by_force(x)


def test_parts_of_the_method():
    text = np.array([int(c) for c in "0010010120101201012"])
    s = tandem.suffixes(text)
    as_text = lambda i: text[i:].tolist()
    assert [as_text(i) for i in s.order] == sorted(as_text(i) for i in range(len(text)))
    for i in range(len(text)):
        for j in range(i):
            a = s.right(np.array([i]), np.array([j]))[0]
            assert as_text(i)[:a] == as_text(j)[:a] and as_text(i)[a : a + 1] != as_text(j)[a : a + 1]
            b = s.left(np.array([i]), np.array([j]))[0]
            assert all(text[i - k] == text[j - k] for k in range(b)) and (j - b < 0 or text[i - b] != text[j - b])
    # each block is the longest piece that starts further left too, or one new number
    begin = tandem.blocks(s)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        piece, longer = as_text(a)[: b - a], as_text(a)[: b - a + 1]
        assert b - a == 1 or any(as_text(i)[: b - a] == piece for i in range(a))
        assert not any(as_text(i)[: len(longer)] == longer for i in range(a)) or b == len(text)


def test_vocabulary_is_complete():
    """Every kind of square of a primitive root is on the tree, once."""
    rng = random.Random(5)
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randrange(2, 40))]
        text = np.array([*x, 9])
        s = tandem.suffixes(text)
        start, period = tandem.covering(s, tandem.blocks(s))
        got = []
        if len(start):
            t = tandem.Tree(s)
            got = [tuple(x[t.least[v] : t.least[v] + 2 * k]) for v, k in tandem.vocabulary(s, t, start, period)]
        power = lambda w: any(len(w) % d == 0 and w == w[:d] * (len(w) // d) for d in range(1, len(w)))
        want = {tuple(x[i : i + 2 * k]) for k in range(1, len(x) // 2 + 1) for i in range(len(x) - 2 * k + 1) if x[i : i + k] == x[i + k : i + 2 * k] and not power(x[i : i + k])}
        assert sorted(got) == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5), st.booleans())
def test_stretches_lose_no_run(docs, small):
    code, first = np.array([v for d in docs for v in d], np.int64), np.cumsum([0, *map(len, docs)])
    words, periodic.WORDS = periodic.WORDS, 8 if small else periodic.WORDS
    try:
        got = listed(periodic.long_runs(code, first))
    finally:
        periodic.WORDS = words
    assert got == [(int(o) + s, m, q) for o, d in zip(first, docs, strict=False) for s, m, q in by_force(d) if m >= max(6, 4 * q)]


def expected(i, text, plant):
    w = _WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    if plant and h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = [r for r in by_force(w) if r[1] >= max(6, 4 * r[2])]
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(v for k, v in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("plant", [False, True])
def test_documents_by_force(spark, plant):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "Ç", "d e"][: rng.randrange(1, 5)]) for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    rows = [*enumerate(texts), (7, texts[7]), (7, texts[7]), (None, texts[9]), (200, None), (201, ""), (202, " \n"), (203, "x " * 7), (204, "one"), (205, "a\x00 a\x00 a\x00 a\x00 a\x00 a\x00")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("runs", "start", "period", "__short")}).repartition(4)
    got = [tuple(r)[:8] for r in periodic.find(d, plant).collect()]
    assert sorted(got, key=str) == sorted((expected(i, t, plant) for i, t in rows), key=str)


def test_collapse_and_odd_tables(spark):
    long = "le mot juste " * 40_000 + "fin"
    d = spark.createDataFrame([(1, long), (2, "as  it\nis"), (3, None)], "doc_id long, text string").withColumn("__short", F.lit("own"))
    out = periodic.collapse(d)
    assert out.columns == d.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "le mot juste fin", 2: "as  it\nis", 3: None}
    r = periodic.find(d).where("doc_id = 1").first()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 0, 120_000, 3, 40_000_000)
    assert periodic.find(d.limit(0)).count() == 0 and periodic.collapse(d.limit(0)).count() == 0
    assert periodic.find(spark.createDataFrame([(1, "")], "doc_id long, text string")).first()["collapsed_sha256"] == EMPTY
