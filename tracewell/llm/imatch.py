"""I-Match fingerprints (operator 8).

A pass over all documents counts in how many each term occurs. The lexicon has the terms within the band of
inverse document frequency LOW_IDF to HIGH_IDF: a document of d distinct terms adds at most d * exp(HIGH_IDF) / N
terms to it, so it is bounded by the mean number of distinct terms times exp(HIGH_IDF), at any corpus size,
and is broadcast. The distinct terms of a document that are in the lexicon, sorted, are hashed: all of them, and
those in each of SEEDS * len(RATES) randomised lexicon subsets. The subsets are fixed before any document is seen:
subset (seed, i) holds a share RATES[i] of all terms, those whose seeded hash is below it. Dense subsets differ on
nearly every edit, sparse ones outlast it if they miss the edited terms.

A part is the hash of one intersection; it is 0 if the intersection is empty, and such a part says nothing. Two
texts are alike by a part if it is equal and not empty. Their likeness is 1 if the first parts are equal, else the
share of seeds whose sparsest subset that isn't empty in both texts has equal parts.

Defined results. Null text: empty. Documents without a term in the lexicon are hashed as if all their terms were
in it; those without a word have only the first part, a hash of their whole text. Rows that repeat a doc_id go by
text. Null doc_id: before all others (doc_id -2**63 is taken for null). The next document of the last one is the
first, of an only one itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import in_arrow, table

#: Terms in more than one document in exp(LOW_IDF), or less than one in exp(HIGH_IDF), aren't in the lexicon.
LOW_IDF, HIGH_IDF = float(np.log(10)), float(np.log(1000))
#: Shares of the lexicon in the subsets of a seed.
RATES = tuple(2 / 3 / 4**i for i in range(6))
SEEDS = 10
PARTS = 1 + SEEDS * len(RATES)
#: Distinct terms that a task counts before it passes them on.
FLUSH = 1 << 20
_SEEDS = V.mix(np.arange(1, SEEDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: A seeded hash below a bound is in the subset; falling.
_BOUNDS = np.array([int(r * 2**64) for r in RATES], np.uint64)


def _distinct(w: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of each document, one after another, and where each begins."""
    parts = [np.unique(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    sums: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        terms, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        for t, c in sums:
            terms, n = np.concatenate([terms, t]), np.concatenate([n, c])
        terms, back = np.unique(terms, return_inverse=True)
        return terms, np.bincount(back, n, len(terms)).astype(np.int64)

    for whole in batches:
        for b in V.slices(whole, "text"):
            terms, _ = _distinct(V.words(b.column(0), lower=True))
            held.append(terms)
            size += len(terms)
        if size > FLUSH:
            sums = [merged()]
            held, size = [], 0
            if len(sums[0][0]) > 2 * FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(sums[0][0].view(np.int64)), pa.array(sums[0][1])], ["term", "n"])
                sums = []
    terms, n = merged()
    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (hash) and n, over all documents; tasks add up before the shuffle."""
    return in_arrow(docs.select(F.col("text").cast("string").alias("text")), _count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, low: float = LOW_IDF, high: float = HIGH_IDF) -> np.ndarray:
    """Sorted hashes of the terms within the band; a term of one document is never in."""
    n = docs.count()
    least, most = max(2.0, n / np.exp(high)), max(2.0, n / np.exp(low))
    found = document_frequencies(docs).where((F.col("n") >= least) & (F.col("n") <= most)).select("term").toArrow()
    return np.sort(found.column(0).combine_chunks().to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def fingerprints(texts: list[str], terms: np.ndarray) -> np.ndarray:
    """A row of PARTS hashes of 32 bits for each text; 0 for an empty intersection."""
    all_terms, first = _distinct(V.words(pa.array(texts, pa.large_string()), lower=True))
    kept = np.zeros(len(all_terms), bool)
    if len(terms) and len(all_terms):
        kept = terms[np.minimum(np.searchsorted(terms, all_terms), len(terms) - 1)] == all_terms
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    use = kept | (np.bincount(doc[kept], minlength=len(texts))[doc] == 0)
    t, doc = all_terms[use], doc[use]
    n = len(RATES)
    out = np.zeros((len(texts), PARTS), np.uint32)

    def hashed(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = np.maximum((V.mix(sums + sizes.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        return np.where(sizes > 0, h, np.uint32(0))

    def added(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(size, np.uint64)
        np.add.at(total, at, x)
        return total

    # the order of distinct terms doesn't matter to a sum of mixed hashes
    sizes = np.bincount(doc, minlength=len(texts))
    out[:, 0] = hashed(added(doc, V.mix(t), len(texts)), sizes)
    for s, seed in enumerate(_SEEDS):
        x = V.mix(t ^ seed)
        # how many of the seed's subsets, from the densest on, hold the term
        held = n - np.searchsorted(_BOUNDS[::-1], x, "right")
        some = held > 0
        at = doc[some] * n + held[some] - 1
        sums = added(at, V.mix(x[some] + seed), len(texts) * n).reshape(-1, n)
        counts = np.bincount(at, minlength=len(texts) * n).reshape(-1, n)
        # what the sparser subsets hold the denser ones hold too
        sums, counts = np.cumsum(sums[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        out[:, 1 + s * n : 1 + (s + 1) * n] = hashed(sums, counts)
    for i in np.flatnonzero(sizes == 0):
        out[i, 0] = np.frombuffer(hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).digest()[:4], np.uint32)[0] | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints row by row."""
    x, y = (v[:, 1:].reshape(len(v), SEEDS, len(RATES)) for v in (a, b))
    some = (x != 0) | (y != 0)
    last = np.where(some.any(2), len(RATES) - 1 - some[:, :, ::-1].argmax(2), 0)[:, :, None]
    same = (np.take_along_axis((x == y) & some, last, 2)[:, :, 0]).sum(1) / np.maximum(some.any(2).sum(1), 1)
    return np.where(a[:, 0] == b[:, 0], 1.0, same)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _firsts(docs: DataFrame, partitions: int) -> list[int]:
    """The first key in each of about so many ranges of keys that have about as many rows."""
    at = [i / partitions for i in range(1, partitions)]
    bounds = sorted({int(x) for x in docs.approxQuantile("key", at, 0.2 / partitions)}) if at else []

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for b in batches:
            keys = b.column(0).to_numpy()
            for r, k in zip(np.searchsorted(bounds, keys, "left").tolist(), keys.tolist(), strict=True):
                found[r] = min(k, found.get(r, k))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["b", "k"])

    firsts = in_arrow(docs.select("key"), least, "b int, k long").groupBy("b").agg(F.min("k").alias("k")).orderBy("b").collect()
    return [r["k"] for r in firsts]


def next_to(docs: DataFrame, partitions: int) -> DataFrame:
    """key, kind and packed text of each row, dealt by ranges of key and sorted: own rows (0) and, at the end of a range, the first of the next (1)."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("text").cast("string").alias("text"))
    firsts = _firsts(keyed.select("key"), partitions)
    order = {k: i for i, k in enumerate(firsts)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = z.compress((text.as_py() or "").encode("utf-8", "surrogatepass"))
                r = bisect_right(firsts, key) - 1
                out.append((r, 0, key, data))
                if key in order:
                    out.append(((order[key] - 1) % len(firsts), 1, key, data))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int8(), pa.int64(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.int8(), pa.int64(), pa.binary())], ["range", "kind", "key", "data"])

    sent = in_arrow(keyed, send, "range int, kind byte, key long, data binary")
    return sent.repartitionById(max(1, len(firsts)), "range").sortWithinPartitions("range", "kind", "key", "data")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses to it and to the next text's."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(lexicon(docs))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def unpacked(data: bytes) -> str:
        return zstandard.decompress(data).decode("utf-8", "surrogatepass")

    def results(rows: list[tuple[int, str]], after: str) -> pa.RecordBatch:
        """rows: key and text, in order; after: the text that follows the last."""
        texts = [t for _, t in rows] + [after]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
        own, other = fingerprints(texts, held.value), fingerprints(edited, held.value)
        show = lambda x: [r.astype(">u4").tobytes().hex() for r in x]
        columns = [
            pa.array([None if k == -(2**63) else k for k, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()), pa.array(show(own[:-1])), pa.array(show(other)),
            pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        after = None
        for b in batches:
            for kind, key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if kind == 0:
                    rows.append((key, unpacked(data.as_py())))
                elif after is None:
                    after = unpacked(data.as_py())
            if len(rows) > 1 and after is None:
                yield results(rows[:-1], rows[-1][1])
                rows = rows[-1:]
        if rows:
            yield results(rows, after if after is not None else rows[0][1])

    return in_arrow(next_to(docs, partitions).select("kind", "key", "data"), run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the query that SQL can say."""
    return query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITS_ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS u FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 2) || substring(u, 1, length(t) // 2)) AS edited_sha256 FROM n
"""
