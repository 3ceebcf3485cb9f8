"""Language identification by sparse multinomial logistic regression (operator 5).

Features are character n-grams of 1 to NGRAM letters or spaces, hashed into BUCKETS, weighted by
(1 + log tf) * idf and normalised. Document frequencies cover every document that may be learned from; the
weights are fitted on a sample of at most PER_LANG documents a language, and MOST_ROWS in all if no language gets
below LEAST_PER_LANG by it, chosen by a hash of doc_id, with follow-the-regularised-leader and elastic-net penalties; every fifth of them calibrates the temperature.
`keep_known` wants a calibrated score of LEAST_SCORE, or with more than four languages of LEAST_GAIN of the way
from chance to 1. On the test tables held-out documents, also those in two languages, score 0.50 at least, random
letters, encoded bytes and foreign scripts 0.46 at most. A mixture of two languages and no language look alike if
only two are learned, so then, and without calibration (below 50 documents), only `und` goes.

Defined results. Null text, or none with a letter: `und`, score 0. No labelled document: all `und`. Null
doc_id: predicted, not learned from, not held out. Rows that repeat a doc_id: each is predicted for itself,
and one of those with a language may be in the sample. All labels are learned; each takes about 1.3 MB of the
driver. Extra columns: `identify` ignores, `keep_known` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, in_arrow, table

NGRAM = 3
BUCKETS = 1 << 16
#: Bounds the sample of labelled documents that the weights are fitted on.
PER_LANG, MOST_ROWS, LEAST_PER_LANG = 1000, 64_000, 50
EPOCHS = 3
LEAST_SCORE, LEAST_GAIN = 0.475, 0.3
UNKNOWN = "und"
#: Characters featurised at once.
CHUNK = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _folded() -> np.ndarray:
    """By code point: the lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def counts(text: str) -> np.ndarray | None:
    """Occurrences by bucket; None if there is no letter. Long texts go in chunks, which carry the characters that n-grams over their borders need."""
    total, letters = np.zeros(BUCKETS, np.int64), False
    tail, solid_before = np.zeros(0, np.uint64), True

    def add(c: np.ndarray) -> None:
        nonlocal tail
        x = np.concatenate([tail, c])
        h = np.zeros(len(x), np.uint64)
        for n in range(1, NGRAM + 1):
            if len(x) >= n:
                h = h[: len(x) - n + 1] * np.uint64(0x110001) + x[n - 1 :]
                # those that end in c
                total[:] += np.bincount(((h[max(0, len(tail) - n + 1) :] + np.uint64(n)) * _SPREAD) >> np.uint64(48), minlength=BUCKETS)
        tail = x[len(x) - min(len(x), NGRAM - 1) :]

    space = np.array([32], np.uint64)
    for at in range(0, len(text), CHUNK):
        c = _folded()[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        solid = c != 32
        letters = letters or bool(solid.any())
        c = c[solid | np.append(solid_before, solid[:-1])]  # runs of spaces count as one
        solid_before = bool(solid[-1])
        add(c if at else np.concatenate([space, c]))
    if letters:
        add(space)
    return total if letters else None


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    total = counts(text)
    if total is None:
        return None
    at = np.flatnonzero(total)
    x = (1 + np.log(total[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0
    calibrated: bool = False

    def least(self) -> float:
        """The score from which a text counts as identified."""
        chance = 1 / max(1, len(self.langs))
        return min(LEAST_SCORE, chance + LEAST_GAIN * (1 - chance)) if self.calibrated else 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        v = vector(text, self.idf) if text and self.langs else None
        if v is None:
            return UNKNOWN, 0.0
        p = softmax(v[1] @ self.weights[v[0]] / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal: weights by bucket and class from (buckets, values, class) rows."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def solve(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return -np.sign(zs) * np.maximum(np.abs(zs) - l1, 0) / ((beta + np.sqrt(ns)) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            zs, ns = z[at], n[at]
            w = solve(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    return solve(z, n).astype(np.float32)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    low, high, r = -1.5, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def crc(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(BUCKETS + 1, np.int64), 0
    for b in batches:
        for text in b.column(0):
            if (c := counts(text.as_py() or "")) is not None:
                df[:BUCKETS] += c > 0
                docs += 1
    df[BUCKETS] = docs
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "n"])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """docs: doc_id, text and lang, all of which may be learned from."""
    docs = docs.where("lang is not null and doc_id is not null")
    langs = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(langs)
    per_lang = min(per_lang, max(LEAST_PER_LANG, MOST_ROWS // max(1, len(names))))
    sums = in_arrow(docs.select("text"), _frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[sums["bucket"].to_numpy(np.int64)] = sums["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 0.1
    # about 1.3 times the bound by a threshold on the hash, then the bound exactly
    unit = (F.xxhash64("doc_id").cast("double") / float(2**64) + 0.5).alias("u")
    rates = F.create_map(*(F.lit(x) for name, n in langs.items() for x in (name, min(1.0, 1.3 * per_lang / n)))) if langs else F.lit(None)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [vector(t.as_py() or "", idf) for t in b.column(2)]
            keep = pa.array([v is not None for v in found])
            parts = [pa.array([v[i].astype(kind).tobytes() for v in found if v is not None], pa.binary()) for i, kind in enumerate(("<u4", "<f4"))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), *parts], ["lang", "u", "at", "x"])

    chosen = docs.select("lang", unit, "text").where(F.col("u") < (F.element_at(rates, F.col("lang")) if langs else F.lit(0.0)))
    chosen = chosen.groupBy("lang", "u").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = in_arrow(chosen, featurise, "lang string, u double, at binary, x binary").toPandas().sort_values(["lang", "u"]).groupby("lang").head(per_lang)
    fitted = [(np.frombuffer(r.at, "<u4"), np.frombuffer(r.x, "<f4").astype(float), names.index(r.lang)) for r in rows.itertuples()]
    held = fitted[::5] if len(fitted) >= 50 else []
    weights = fit([r for i, r in enumerate(fitted) if not held or i % 5], len(names))
    logits = np.array([x @ weights[at] for at, x, _ in held])
    return Model(names, idf.astype(np.float32), weights, calibrate(logits, np.array([y for _, _, y in held], int)), bool(held))


def apply(docs: DataFrame, model: Model, columns: list[str], into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`columns` of docs, then the language and score of its text under the names `into`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add(into[0], "string").add(into[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.value.predict(t.as_py()) for t in b.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.names)

    return in_arrow(docs.select(*columns, F.col("text").alias(fresh(docs, "__text"))), run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(F.pmod(crc(F.col("doc_id")), F.lit(3)) != 1)


def identify(docs: DataFrame) -> DataFrame:
    model = train(learnable(docs))
    held = F.coalesce(F.pmod(crc(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    return apply(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


def keep_known(docs: DataFrame, least: float | None = None) -> DataFrame:
    """docs, same columns, without those whose language is unknown or less sure than `least` (None: the model's)."""
    columns = docs.columns
    lang, score = fresh(docs, "__lang"), fresh(docs, "__score")
    model = train(learnable(docs))
    least = model.least() if least is None else least
    rated = apply(docs, model, columns, (lang, score))
    return rated.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
