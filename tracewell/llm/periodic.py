"""Runs of repeated words in documents (operator 13), by the method of `tandem`, and the texts without the repeats.

A run is a stretch of words with smallest period q and at least max(6, 4 * q) words that goes on to neither side. All of its
words but the last q recur q words on. So a document is first cut to the stretches in which each word recurs within a
third of the stretch's length; that loses no run, and most documents have no such stretch. What is left of a
piece of text, each stretch with numbers of its own, is one sequence for `tandem.runs`. Everything happens where the documents
are: no shuffle, and memory is bounded by pieces of HELD bytes of text or one document.

Defined results. Null and empty texts, and texts without words: no runs, and the empty text's hash. Null doc_id: kept
as it is; the query's planted repeats need an id, so there are none. Rows that repeat a doc_id have rows of their own.
Extra columns: `find` ignores them, `collapse` keeps them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import vectext as V
from .common import fresh, in_arrow, table
from .tandem import runs

LEAST, POWER = 6, 4
#: Bytes of text looked at together, and words of one suffix tree (a longer stretch is one by itself).
HELD, WORDS = 1 << 22, 1 << 15


def stretches(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of disjoint stretches, none over a document's end, that hold every run of the documents whole."""
    n = len(code)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    stop = np.repeat(first[1:], size)
    key = doc * np.int64(code.max(initial=0) + 1) + code
    order = np.argsort(key, kind="stable")
    next_ = np.full(n, n + 1)
    same = key[order[1:]] == key[order[:-1]]
    next_[order[:-1][same]] = np.diff(order)[same]
    good = next_ <= n
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        # stretches end with documents too: a document's last word never recurs
        a, b = edge[::2], edge[1::2]
        long = b - a >= LEAST - 1
        a, b = a[long], b[long]
        mark = np.zeros(n + 1, np.int64)
        mark[a], mark[b] = 1, -1
        held = np.cumsum(mark[:n]) > 0
        limit = _filled(a, (b - a) // (POWER - 1), n)
        after = held & (next_ <= limit)
        if (after == good).all():
            break
        good = after
    if not len(a):
        return a, b
    b = np.minimum(b + (b - a) // (POWER - 1), stop[a])
    new = np.append(True, a[1:] >= np.maximum.accumulate(b)[:-1])
    return a[new], np.maximum.reduceat(b, np.flatnonzero(new))


def _filled(a: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """values[i] from a[i] to a[i + 1], 0 before a[0]."""
    out = np.zeros(n, np.int64)
    out[a] = np.diff(np.append(0, values))
    return np.cumsum(out)


def long_runs(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of the documents, by start and period; starts count from the first document's first word."""
    begin, end = stretches(code, first)
    found: list[tuple[np.ndarray, ...]] = []
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(np.cumsum(end[i:] - begin[i:]), WORDS, "right")) + i)
        size = end[i:j] - begin[i:j]
        low = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(begin[i:j] - low, size)
        # equal words of different stretches get different numbers
        text = np.repeat(np.arange(j - i), size) * np.int64(code.max() + 1) + code[at]
        start, length, period = runs(text)
        good = length >= np.maximum(LEAST, POWER * period)
        found.append((at[start[good]], length[good], period[good]))
        i = j
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def planted(code: np.ndarray, first: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """The words of the documents after the query's repeats were put in."""
    out = code.copy()
    for d, i in enumerate(ids):
        n = int(first[d + 1] - first[d])
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            low = int(first[d]) + a
            out[low : first[d + 1]] = code[low + np.arange(n - a) % p]
    return out


def _dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words is in a run after that run's first period."""
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, start + period, 1)
    np.add.at(turn, start + length, -1)
    return np.cumsum(turn[:n]) > 0


FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def find(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, its runs, the longest of them, and digests of all and of the text without repeats. plant: into documents with repeats put in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text", HELD):
                ids = b.column(0).to_pylist()
                w = V.coded(b.column(1))
                code = planted(w.code, w.first, ids) if plant else w.code
                start, length, period = long_runs(code, w.first)
                stays = ~_dropped(len(code), start, length, period)
                kept, cuts = code[stays], np.concatenate([[0], np.cumsum(stays)])[w.first]
                words = w.vocabulary.to_pylist()
                at = np.searchsorted(start, w.first)
                rows = []
                for d, i in enumerate(ids):
                    lo, hi = at[d], at[d + 1]
                    s, n, q = start[lo:hi] - w.first[d], length[lo:hi], period[lo:hi]
                    text = b" ".join([words[c] for c in kept[cuts[d] : cuts[d + 1]].tolist()])
                    listed = list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True))
                    best = max(listed, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
                    rows.append((
                        i, len(listed), *best, 1000 * best[1] // best[2] if listed else None, hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in listed).encode()).hexdigest(),
                        hashlib.sha256(text).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in listed],
                    ))
                kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))]
                names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, FOUND)


def collapse(docs: DataFrame) -> DataFrame:
    """docs, same columns, texts with a run without its repeats (words joined by one space); other texts as they are."""
    out = fresh(docs, "__short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text", HELD):
                w = V.coded(b.column(b.schema.get_field_index("text")))
                start, length, period = long_runs(w.code, w.first)
                gone = _dropped(len(w.code), start, length, period)
                words = w.vocabulary.to_pylist()
                short = []
                for x, y in zip(w.first[:-1], w.first[1:], strict=True):
                    short.append(b" ".join([words[c] for c in w.code[x:y][~gone[x:y]].tolist()]).decode("utf-8", "surrogatepass") if gone[x:y].any() else None)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(short, pa.string())], [*b.schema.names, out])

    shortened = in_arrow(docs, run, StructType([*docs.schema.fields, StructField(out, StringType())]))
    return shortened.select(*(F.coalesce(out, "text").alias("text") if c == "text" else F.col(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), plant=True).drop("runs")


#: Equal words of a document q apart, q up to a quarter of its length; consecutive ones are runs. The CRC's table is made by its rule.
ORACLE = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
w0 AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM w0, crc),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM h),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM a),
x AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
s AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM g GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND o.q < s.q AND o.s <= s.s AND o.s + o.l >= s.s + s.l)),
b AS (SELECT r, count(*) AS n_runs, arg_max({'s': s, 'l': l, 'q': q}, {'l': l, 's': -s, 'q': -q}) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM u GROUP BY r),
c AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM u),
k AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN c ON c.r = x.r AND c.i = x.i GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.b.s AS start, b.b.l AS length, b.b.q AS period, 1000 * b.b.l // b.b.q AS exponent_milli, sha256(coalesce(b.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""
