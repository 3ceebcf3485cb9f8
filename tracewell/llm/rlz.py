"""Substring deduplication by relative Lempel-Ziv parsing (operator 3).

The reference is every document: its blocks are the runs of consecutive windows of LENGTH words that share
an anchor, the least of the hashed GRAM-word sequences in the window (ties: the leftmost). Equal windows
have equal anchors, so blocks are indexed by anchor and a window need be looked up in its own block only.
Within an anchor, blocks go by doc_id and each is parsed greedily against all blocks of smaller doc_ids: from its
first window that any of them has, the factor is the longest stretch that one of them has (ties: the smallest
doc_id), and the parse goes on at the next window that any has. A factor holds LENGTH words or more, so each is
long enough; the windows over its end are looked up like all others, and so the words under the factors are
exactly those under windows that start in a document with a smaller doc_id. A longer repeat comes as a factor a
block, which overlap.

Blocks move as window hashes of 8 bytes, grouped by 8 more of the anchor: words count as equal by these 128 bits.
Before that, blocks that equal another of a smaller doc_id in the same slice of the input are settled, so a passage
in a third of all documents is moved once a slice, and a block that a document repeats is moved once. Windows of
hot anchors, of which a pass before counts all, are blocks of their own and dealt by their own hashes. A block's
task streams: it holds some Arrow batches and the distinct blocks of one anchor, below HOT.

Defined results. Null and empty texts: no words. Documents below LENGTH words: nothing removed. Null doc_id:
neither source nor cut. Rows that share a doc_id aren't sources of one another. Extra columns are ignored by
`cut`, and kept by none: the operator returns doc_id, kept text and counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import gathered, in_arrow, table

LENGTH = 50
GRAM = 8
#: An anchor of so many blocks is hot, up to MOST_HOT of them; so the list that is broadcast is bounded.
HOT, MOST_HOT = 4096, 100_000
#: Pairs of a seed and a reference block that are extended at once.
PAIRS = 1 << 18
#: Of a settled block, `anchor` is the source.
BLOCK = "anchor long, doc_id long, row long, places binary, words int, windows binary"


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, by doubling."""
    out, size = x, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(w: V.Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of GRAM-word sequences, the starts of windows within one document, and the positions of their anchors."""
    n = len(w.hash)
    stop = np.repeat(w.first[1:], np.diff(w.first))
    starts = np.flatnonzero(np.arange(n) + length <= stop)
    grams, _ = w.windows(gram)
    if not len(starts):
        return grams, starts, starts
    # the position in the lower half names the anchor and makes the leftmost the least
    low = np.uint64((1 << 32) - 1)
    packed = (V.mix(grams) & ~low) | np.arange(n, dtype=np.uint64)
    least = _least(packed[: n - gram + 1], length - gram + 1)
    return grams, starts, (least[starts] & low).astype(np.int64)


def _tally(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text", 1 << 21):
                grams, _, anchor = _anchors(V.words(b.column(0)), length, gram)
                found, n = np.unique(grams[anchor[np.append(True, np.diff(anchor) != 0)]] if len(anchor) else grams[:0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def hot_anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, least: int = HOT, most: int = MOST_HOT) -> np.ndarray:
    """The anchors of at least `least` blocks, the `most` most frequent of them; they only decide how windows are dealt."""
    counts = in_arrow(docs.select("text"), _tally(length, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "anchor").limit(most).select("anchor").toArrow()
    return np.sort(found.column(0).combine_chunks().to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def _in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x if len(among) else np.zeros(len(x), bool)


def _blocks(length: int, gram: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text", 1 << 21):
                w = V.words(b.column(2))
                grams, starts, anchor = _anchors(w, length, gram)
                if not len(starts):
                    continue
                windows = w.windows(length)[0][starts]
                doc = np.searchsorted(w.first, starts, "right") - 1
                alone = _in(grams[anchor], hot.value)
                begin = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(doc) != 0)) | alone)
                sizes = np.diff(np.append(begin, len(starts)))
                own = doc[begin]
                ids, rows, first = b.column(0).to_numpy()[own], b.column(1).to_numpy()[own], starts[begin] - w.first[own]
                key = grams[anchor[begin]]
                key = np.where(alone[begin], V.mix(key ^ V.mix(windows[begin])), key)
                # blocks that equal one of a smaller doc_id here are settled: they go on as factors, without windows
                up, _ = V.powers(0x9FB21C651E98DF25, int(sizes.max()))
                place = np.arange(len(starts)) - np.repeat(begin, sizes)
                same = V.mix(key ^ V.mix(np.add.reduceat(windows * up[place], begin) + sizes.astype(np.uint64)))
                order = np.lexsort((ids, same))
                head = np.append(True, np.diff(same[order]) != 0)
                source = np.empty(len(ids), np.int64)
                source[order] = ids[order][np.flatnonzero(head)][np.cumsum(head) - 1]
                settled = source < ids
                # a block that a document repeats is sent once, with all its places
                left = np.flatnonzero(~settled)
                left = left[np.lexsort((first[left], same[left], own[left]))]
                if len(left):
                    head = np.flatnonzero(np.append(True, (np.diff(same[left].view(np.int64)) != 0) | (np.diff(own[left]) != 0)))
                    one = left[head]
                    at = np.repeat(begin[one], sizes[one]) + np.arange(sizes[one].sum()) - np.repeat(np.cumsum(sizes[one]) - sizes[one], sizes[one])
                    data = np.ascontiguousarray(windows[at]).view(np.uint8)
                    places = V.binary(first[left].astype(np.int32).view(np.uint8), np.append(head, len(left)) * 4)
                    yield _batch(key[one].view(np.int64), ids[one], rows[one], places, np.zeros(len(one)), V.binary(data, np.append(0, np.cumsum(sizes[one])) * 8))
                rows, ids, first, sizes, source = rows[settled], ids[settled], first[settled], sizes[settled], source[settled]
                if len(rows):
                    run_at = np.flatnonzero(np.append(True, (np.diff(own[settled]) != 0) | (np.diff(source) != 0) | (first[1:] != first[:-1] + sizes[:-1])))
                    places = V.binary(first[run_at].astype(np.int32).view(np.uint8), np.arange(len(run_at) + 1) * 4)
                    yield _batch(source[run_at], ids[run_at], rows[run_at], places, np.add.reduceat(sizes, run_at) + length - 1, pa.array([b""] * len(run_at), pa.binary()))

    return run


def _batch(anchor, doc_id, row, places, words, windows) -> pa.RecordBatch:
    columns = [pa.array(anchor), pa.array(doc_id), pa.array(row), places, pa.array(words.astype(np.int32)), windows]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "row", "places", "words", "windows"])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's offsets from 0, and its bytes."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


FACTOR = "doc_id long, row long, start int, words int, source long"


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each value is of, and the values of range(b, b + c) one after another."""
    of = np.repeat(np.arange(len(begin)), count)
    return of, begin[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]


def _extensions(a: np.ndarray, a_stop: np.ndarray, b: np.ndarray, b_stop: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """How many windows from positions a on equal those from b on, below both stops."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    k = 0
    while len(live):
        live = live[(a[live] + k < a_stop[live]) & (b[live] + k < b_stop[live])]
        live = live[windows[a[live] + k] == windows[b[live] + k]]
        k += 1
        out[live] = k
    return out


def parse(group: np.ndarray, doc: np.ndarray, sizes: np.ndarray, windows: np.ndarray, old: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of the blocks from `old` on, and the blocks that are the first of their content.

    Blocks are sorted by group and doc; sizes: their windows, which lie in `windows` one after another. Returns
    block, position and number of windows of each factor, the doc of its source, and whether a block is a first.
    """
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(windows)) - begin[of]
    up, _ = V.powers(0x9FB21C651E98DF25, int(sizes.max()))
    whole = V.mix(V.mix(np.add.reduceat(windows * up[place], begin) + sizes.astype(np.uint64)) ^ V.mix(group.astype(np.uint64)))
    first = np.zeros(len(sizes), bool)
    first[np.unique(whole, return_index=True)[1]] = True
    # windows by content; in each, those of first blocks in the order of docs
    key = V.mix(windows ^ V.mix(group[of].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    start_of = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    name = np.empty(len(key), np.int64)
    name[order] = np.repeat(np.arange(len(start_of)), np.diff(np.append(start_of, len(order))))
    least = doc[of[order[start_of]]]
    refs = order[first[of[order]]]
    ref_begin = np.searchsorted(name[refs], np.arange(len(start_of) + 1))
    hit = np.flatnonzero((least[name] < doc[of]) & (of >= old))
    found: list[tuple[np.ndarray, ...]] = []
    # the first hit of each block, then the first after its factor, and so on
    at = hit[np.append(True, np.diff(of[hit]) != 0)] if len(hit) else hit
    while len(at):
        length, source = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count = ref_begin[name[at] + 1] - ref_begin[name[at]]
        cut = np.searchsorted(np.cumsum(count), np.arange(PAIRS, int(count.sum()) + PAIRS, PAIRS), "left") + 1
        for i, j in zip(np.append(0, cut[:-1]), np.minimum(cut, len(at)), strict=True):
            seed, where = _ranges(ref_begin[name[at[i:j]]], count[i:j])
            seed, ref = seed + i, refs[where]
            earlier = doc[of[ref]] < doc[of[at[seed]]]
            seed, ref = seed[earlier], ref[earlier]
            n = _extensions(at[seed], (begin + sizes)[of[at[seed]]], ref, (begin + sizes)[of[ref]], windows)
            best = np.lexsort((doc[of[ref]], -n, seed))
            best = best[np.append(True, np.diff(seed[best]) != 0)] if len(best) else best
            length[seed[best]], source[seed[best]] = n[best], doc[of[ref[best]]]
        found.append((of[at], place[at], length, source))
        after = np.searchsorted(hit, at + length)
        more = after < len(hit)
        after, last = hit[after[more]], of[at][more]
        at = after[of[after] == last]
    block, position, length, source = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    return block, position, length, source, first


def _factors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the last anchor: its distinct blocks, their docs and windows
        last, docs, counts, hashes = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in gathered(batches):
            settled = pc.greater(b.column(4), 0)
            done = b.filter(settled)
            yield pa.RecordBatch.from_arrays([done.column(1), done.column(2), pa.array(_bytes(done.column(3))[1].view(np.int32)), done.column(4), done.column(0)], ["doc_id", "row", "start", "words", "source"])
            b = b.filter(pc.invert(settled))
            if not b.num_rows:
                continue
            anchor, doc, row = (b.column(i).to_numpy() for i in range(3))
            places_at, places = _bytes(b.column(3))
            places_at, places = places_at // 4, np.ascontiguousarray(places).view(np.int32)
            at, data = _bytes(b.column(5))
            sizes, windows = np.diff(at) // 8, np.ascontiguousarray(data).view(np.uint64)
            group = np.cumsum(np.append(True, np.diff(anchor) != 0))  # from 1; rows of a group are by doc_id
            if last != anchor[0]:
                docs, counts, hashes = docs[:0], counts[:0], hashes[:0]
            # groups of one row have nothing to find, unless they go on from or into another batch
            several = np.bincount(group)[group] > 1
            several |= ((group == 1) & (len(docs) > 0)) | (group == group[-1])
            own = np.flatnonzero(several)
            _, at = _ranges((np.cumsum(sizes) - sizes)[own], sizes[own])
            old = len(docs)
            g, d = np.append(np.ones(old, np.int64), group[own]), np.append(docs, doc[own])
            n, w = np.append(counts, sizes[own]), np.append(hashes, windows[at])
            block, position, count, source, first = parse(g, d, n, w, old)
            # what the next batch may go on with
            keep = first & (g == group[-1])
            last, docs, counts, hashes = anchor[-1], d[keep], n[keep], w[np.repeat(keep, n)]
            if not len(block):
                continue
            # each factor at all places of its block
            r = own[block - old]
            again, place = _ranges(places_at[r], places_at[r + 1] - places_at[r])
            yield pa.RecordBatch.from_arrays([pa.array(doc[r][again]), pa.array(row[r][again]), pa.array((position[again] + places[place]).astype(np.int32)), pa.array((count[again] + length - 1).astype(np.int32)), pa.array(source[again])], ["doc_id", "row", "start", "words", "source"])

    return run


def factors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id and row, start and number of words, and source doc_id of the factors; docs: doc_id, row, text."""
    docs = docs.where("doc_id is not null")
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, length, gram))
    blocks = in_arrow(docs.select("doc_id", "row", "text"), _blocks(length, gram, hot), BLOCK)
    ordered = blocks.repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    return in_arrow(ordered, _factors(length), FACTOR)


CUT = "doc_id long, n_words long, n_removed long, kept string"


def cut(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, word counts and the kept words joined by one space (or their SHA-256) of each row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    spans = factors(keyed, length).distinct().groupBy("row", "doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("words").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, starts, counts in zip(b.column(1), b.column(2), b.column(3), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(words)
                if starts.is_valid:
                    turn = np.zeros(n + 1, np.int64)
                    s, c = starts.values.to_numpy(), counts.values.to_numpy()
                    np.add.at(turn, s, 1)
                    np.add.at(turn, s + c, -1)
                    keep = np.cumsum(turn[:n]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")))
            n_words, n_removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return in_arrow(keyed.join(spans, ["row", "doc_id"], "left").select("doc_id", "text", "starts", "counts"), run, CUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS source FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM s JOIN f USING (h) WHERE source < doc_id),
x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
