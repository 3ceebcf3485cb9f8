"""Benchmark decontamination by templates (operator 1).

Words are canonicalised: a number (in digits or words), a capitalised word or a unit after a number becomes its
type's placeholder, other words are stripped of outer punctuation and lower-cased. A run of numbers or of
capitalised words is one token, so that values may differ in length. Windows of WINDOW tokens are hash-joined
with the benchmark's, and so are windows of canonical words with runs as they are, and of plain lower-case words,
which find verbatim passages whatever their case. On neighbouring diagonals (document position less item
position, up to DRIFT apart, in words and in tokens) matches are added up, and the slots must map consistently:
one value of the item to one value of the document. A document is contaminated by an item if LEAST_WORDS of the
item's words (or all of a shorter item, all tokens of one with such runs) match and at most CONFLICTS of their
slots disagree. A word put into or left out of an item below LEAST_WORDS words is not bridged.

Before the join a bitmap of the benchmark's hashes, of at most 2**MOST_BITS bits, drops windows that can't
match; with more than MOST_WINDOWS windows there is none. The join itself is Spark's, by hash, so a benchmark
of any size will do.

Defined results. Null and empty texts match nothing. Items below LEAST_ITEM words are not searched for. Rows
that repeat a doc_id are judged each for itself and reported once for each item; likewise repeated items.
Null doc_id: reported as null; `keep_clean` drops exactly the rows found. Extra columns are kept by it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import fresh, in_arrow, stored, table

WINDOW = 8
#: Of a window's words so many in WINDOW must be neither placeholders nor missing.
LEAST_LITERAL = 4
LEAST_WORDS = 13
LEAST_ITEM = 4
CONFLICTS = 0.2
#: Words that a passage may have more or fewer than the item, and still be added up.
DRIFT = 3
MOST_BITS = 28
MOST_WINDOWS = 1 << 20
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent % degree degrees mph kmh kph watt watts kw volt volts hz byte bytes kb mb gb".split()
_TEENS = "one two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = [*_TEENS, *_TENS, *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion trillion dozen".split(), *(f"{a}-{b}" for a in _TENS for b in _TEENS)]
LITERAL, NUMBER, NAME, UNIT = range(4)
_MARKS = {NUMBER: np.uint64(0xA5A5_0001_0000_0001), NAME: np.uint64(0xA5A5_0002_0000_0003), UNIT: np.uint64(0xA5A5_0003_0000_0007)}
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("%")]] = True
_UNIT_HASHES, _NUMBER_HASHES = (np.sort(V.words(pa.array([" ".join(x)])).hash) for x in (UNITS, NUMBERS))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def canonical(texts: pa.Array) -> tuple[V.Words, V.Words, np.ndarray]:
    """Words by their plain hashes, the same by their canonical hashes, and their types."""
    w = V.words(texts)
    s, e = w.start.copy(), w.end.copy()
    if len(s):
        solid = _WORD[w.data]
        # outer punctuation: on to the next solid byte, back to the last one
        at, none = np.arange(len(solid)), len(solid)
        following = np.minimum.accumulate(np.where(solid, at, none)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(solid, at, -1))
        s = np.minimum(following[s], e)
        e = np.maximum(before[e - 1] + 1, s)
        whole = s >= e  # nothing but punctuation stays as it is
        s, e = np.where(whole, w.start, s), np.where(whole, w.end, e)
        first = w.data[s]
        second = w.data[np.minimum(s + 1, len(w.data) - 1)]
        low = w.data + np.uint8(32) * ((w.data >= 65) & (w.data <= 90))
        # Latin capitals of two bytes, U+00C0 to U+00DE
        wide = np.zeros(len(low), bool)
        wide[1:] = (w.data[:-1] == 0xC3) & (w.data[1:] >= 0x80) & (w.data[1:] <= 0x9E) & (w.data[1:] != 0x97)
        low = np.where(wide, low + np.uint8(32), low).astype(np.uint8)
        plain = V.word_hashes(low, s, e)
        number = (first >= 48) & (first <= 57) | _among(plain, _NUMBER_HASHES)
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        unit = _among(plain, _UNIT_HASHES)
        unit[1:] &= number[:-1]
        unit[:1] = False
    else:
        plain = w.hash
        number = capital = unit = np.zeros(0, bool)
    kind = np.select([number, unit, capital], [NUMBER, UNIT, NAME], LITERAL).astype(np.uint8)
    mask = plain.copy()
    for k, mark in _MARKS.items():
        mask[kind == k] = mark
    return V.Words(w.data, s, e, w.first, plain), V.Words(w.data, s, e, w.first, mask), kind


def collapsed(plain: V.Words, mask: V.Words, kind: np.ndarray) -> tuple[V.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by their canonical hashes, the first word of each, its words, the hash of its value, and the words that continue a run."""
    n = len(kind)
    on = np.zeros(n, bool)
    on[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME))
    on[plain.first[plain.first < n]] = False
    head = np.flatnonzero(~on)
    width = np.diff(np.append(head, n))
    up, down = V.powers(V._STEP, n + 1)
    total = V.sums(plain.hash * up[:n])
    value = np.where(width == 1, plain.hash[head], V.mix((total[head + width] - total[head]) * down[head] + width.astype(np.uint64)))
    return V.Words(plain.data, plain.start[head], plain.end[head + width - 1], np.searchsorted(head, plain.first), mask.hash[head]), head, width, value, on


#: Kinds of windows: of tokens, of canonical words with a run among them, of plain words.
TOKENS, RUNS, PLAIN = range(3)


@dataclass
class Windows:
    """Windows of k tokens or words: the hashes, documents and positions of those found; word, width, value and kind are by token or word."""

    what: int
    k: int
    hash: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    first: np.ndarray
    word: np.ndarray
    width: np.ndarray
    value: np.ndarray
    kind: np.ndarray

    def columns(self, keep: np.ndarray, kinds: bool) -> list[pa.Array]:
        at = self.at[keep]
        base = self.word[np.minimum(self.first[self.doc[keep]], max(0, len(self.word) - 1))]
        words = (self.word[at[:, None] + np.arange(self.k)[None, :]] - base[:, None]).astype(np.int32) if len(at) else np.zeros((0, self.k), np.int32)
        return [pa.array(self.hash[keep].view(np.int64)), pa.array(at - self.first[self.doc[keep]], pa.int32()), _matrix(self.value, at, self.k), _rows(words), _matrix(self.width.astype(np.int32), at, self.k), *([_matrix(self.kind, at, self.k)] if kinds else [])]


def windows(texts: pa.Array, k: int, which: tuple[int, ...] = (TOKENS, RUNS, PLAIN)) -> Iterator[Windows]:
    """Template windows of k tokens, those of words where they have a run, and plain ones."""
    plain, mask, kind = canonical(texts)
    tokens, head, width, value, on = collapsed(plain, mask, kind)
    each, ones = np.arange(len(kind)), np.ones(len(kind), np.int64)
    for what, words, salt, rest in ((TOKENS, tokens, 0x51, (head, width, value, kind[head])), (RUNS, mask, 0x51, (each, ones, plain.hash, kind)), (PLAIN, plain, 0x52, (each, ones, plain.hash, kind))):
        if what not in which:
            continue
        h, ok = words.windows(k)
        if len(h) < k:
            continue
        if what != PLAIN:
            literal = np.concatenate([[0], np.cumsum(rest[3] == LITERAL)])
            ok = ok & np.append(literal[k:] - literal[: len(literal) - k] >= LEAST_LITERAL * k / WINDOW, np.zeros(k - 1, bool))
        if what == RUNS:
            runs = np.concatenate([[0], np.cumsum(on)])
            ok = ok & np.append(runs[k:] - runs[1 : len(runs) - k + 1] > 0, np.zeros(k - 1, bool))
        at = np.flatnonzero(ok)
        yield Windows(what, k, V.mix(h[at] ^ np.uint64(salt + 256 * k)), np.searchsorted(words.first, at, "right") - 1, at, words.first, *rest)


def _rows(x: np.ndarray) -> pa.Array:
    return V.binary(np.frombuffer(x.tobytes(), np.uint8), np.arange(len(x) + 1) * x.shape[1] * x.itemsize)


def _matrix(x: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    return _rows(x[at[:, None] + np.arange(k)[None, :]] if len(at) else np.zeros((0, k), x.dtype))


_ITEMS = "hash long, q int, item_values binary, item_at binary, item_widths binary, kinds binary, item_id long, k int, item_words int, item_tokens int, what byte"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1).slice(i, 1)
                n, n_tokens = len(V.words(text).hash), len(collapsed(*canonical(text))[1])
                if n < LEAST_ITEM:
                    continue
                # an item of few tokens would match anywhere by its template
                lengths = {min(window, n): (RUNS, PLAIN)}
                if n_tokens >= LEAST_ITEM:
                    lengths[min(window, n_tokens)] = (*lengths.get(min(window, n_tokens), ()), TOKENS)
                for k, which in lengths.items():
                    for w in windows(text, k, which):
                        c = len(w.at)
                        rest = [(b.column(0)[i].as_py(), pa.int64()), (k, pa.int32()), (n, pa.int32()), (n_tokens, pa.int32()), (w.what, pa.int8())]
                        yield pa.RecordBatch.from_arrays([*w.columns(np.ones(c, bool), True), *(pa.array([x] * c, t) for x, t in rest)], [x.split()[0] for x in _ITEMS.split(", ")])

    return in_arrow(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")), run, _ITEMS)


def _bitmap(items: DataFrame, most: int = MOST_WINDOWS) -> tuple[np.ndarray | None, int, list[int]]:
    """Bits of the windows' hashes, their number as a power of two, and the lengths of windows. No bits for over `most` windows."""
    found = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set("k").alias("ks")).first()
    if found["n"] > most:
        return None, 0, sorted(found["ks"])
    bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(max(1, found["n"]) * 1024)))))
    at = items.select(F.col("hash").bitwiseAND((1 << bits) - 1).alias("at")).distinct().toArrow().column(0).to_numpy()
    out = np.zeros(1 << bits >> 3, np.uint8)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out, bits, sorted(found["ks"])


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


_HITS = "doc_id long, row long, hash long, p int, doc_values binary, doc_at binary, doc_widths binary"


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Windows of the documents that the benchmark may have."""
    packed, bits, ks = _bitmap(items)
    held = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = held.value
        low = np.uint64((1 << bits) - 1)
        for whole in batches:
            for b in V.slices(whole, "text"):
                for k in ks:
                    for w in windows(b.column(2), k):
                        keep = _has(bitmap, w.hash & low) if bitmap is not None else np.ones(len(w.hash), bool)
                        rows = pa.array(w.doc[keep])
                        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *w.columns(keep, False)], [x.split()[0] for x in _HITS.split(", ")])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("row"), F.col("text").cast("string").alias("text")), run, _HITS)


def _verdict(rows: list[tuple], item_words: int, item_tokens: int) -> tuple | None:
    """Best (words, slots, conflicts, verbatim) over the neighbouring diagonals of one document and item; rows: p, q, what, then values, word positions and widths of both, and kinds."""
    in_words: dict[int, dict[int, tuple]] = defaultdict(dict)
    in_tokens: dict[int, dict[int, tuple]] = defaultdict(dict)
    for p, q, what, dv, da, dw, iv, ia, iw, kinds in rows:
        d, i = np.frombuffer(dv, "<u8").tolist(), np.frombuffer(iv, "<u8").tolist()
        at_d, at_i, wide_d, wide_i = (np.frombuffer(x, "<i4").tolist() for x in (da, ia, dw, iw))
        for j, kind in enumerate(kinds):
            word = (i[j], d[j], kind, min(wide_i[j], wide_d[j]))
            # a run counts from its first word; what is found word by word has precedence over it
            x = in_words[at_d[j] - at_i[j]]
            if what != TOKENS or at_i[j] not in x:
                x[at_i[j]] = word
            if what == TOKENS:
                in_tokens[p - q][at_i[j]] = word
    best = None
    for diagonals, whole in ((in_words, item_words), (in_tokens, item_tokens)):
        for first in diagonals:
            words: dict[int, tuple] = {}
            for drift in range(DRIFT + 1):
                more = diagonals.get(first + drift)
                if more is None:
                    continue
                for at, x in more.items():
                    if at not in words or (x[0] == x[1] and words[at][0] != words[at][1]):
                        words[at] = x
                covered = {c for at, x in words.items() for c in range(at, at + x[3])}
                if len(covered) < LEAST_WORDS and len(words if diagonals is in_tokens else covered) < whole:
                    continue
                maps: dict[tuple, Counter] = defaultdict(Counter)
                for i, d, kind, _ in words.values():
                    if kind != LITERAL:
                        maps[kind, i][d] += 1
                slots = sum(c.total() for c in maps.values())
                conflicts = slots - sum(max(c.values()) for c in maps.values())
                if conflicts <= CONFLICTS * slots:
                    verbatim = not drift and all(i == d for i, d, _, _ in words.values())
                    best = max(best or (0,), (len(covered), -conflicts, verbatim, slots))
    return best and (best[0], best[3], -best[1], best[2])


FOUND = "doc_id long, row long, item_id long, matched_words long, item_words long, slots long, conflicts long, verbatim boolean"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document row and item that contaminates it."""
    items = stored(item_windows(benchmark), "items")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    pairs = candidates(keyed, items).join(items, "hash").select("doc_id", "row", "item_id", "item_words", "item_tokens", "p", "q", "what", "doc_values", "doc_at", "doc_widths", "item_values", "item_at", "item_widths", "kinds").distinct()
    ordered = pairs.repartition("row", "item_id").sortWithinPartitions("row", "doc_id", "item_id", "item_words", "item_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = FOUND.split(", ")
        now, rows = None, []

        def close() -> list[tuple]:
            if now is None or (v := _verdict(rows, now[3], now[4])) is None:
                return []
            return [(now[0], now[1], now[2], v[0], now[3], v[1], v[2], v[3])]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n.endswith("boolean") else pa.int64()) for c, n in zip(columns, names, strict=True)], [n.split()[0] for n in names])

        for b in batches:
            out: list[tuple] = []
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = x[:5]
                if key != now:
                    out += close()
                    now, rows = key, []
                rows.append(x[5:])
            yield batch(out)
        yield batch(close())

    return in_arrow(ordered, run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the best match of each contaminated document with each item."""
    best = F.max(F.struct("matched_words", "item_words", "slots", "conflicts", "verbatim")).alias("best")
    return matches(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, same columns, without contaminated rows."""
    columns = docs.columns
    row, doc = fresh(docs, "__row"), fresh(docs, "__doc")
    found = stored(matches(docs, benchmark).select(F.col("row").alias(row), F.col("doc_id").alias(doc)).distinct(), "contaminated")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    same = (F.col(row) == F.col(row + "r")) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc))
    return rows.join(found.withColumnRenamed(row, row + "r"), same, "left_anti").select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
