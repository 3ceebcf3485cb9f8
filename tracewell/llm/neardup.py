"""Near-duplicate documents by an LSH forest over MinHash signatures (operator 10).

Documents with equal shingle sets, by two 64-bit hashes, are one class; the rest works on classes. TREES sorted orders are kept of
the signatures: tree t orders by the values from TAKE * t on, in rotation. A region is the classes that agree
in a tree's first TAKE values. Its depth adapts: where more than LEAF classes agree, it goes down by the next
values, one by one, until at most LEAF do, or DEEP values are used up; so a region is a set of leaves, each as deep
as its surroundings are dense. All classes of a leaf are one another's candidates, and so are the WINDOW neighbours
in the order, which have the longest common prefixes. A pair at the threshold of 0.75 agrees in no tree's first
values with probability (1 - 0.75**3)**20, about 2e-5.

Candidates pass a sketch of SKETCH one-bit MinHash values, loose by 4.6 standard deviations. Round one
confirms for each class its nearest candidate in any tree and the nearest of the regions' hubs (the
class nearest to a region's bitwise majority). Round two, given the components so far, goes on between
different components: in regions of up to 2 * WINDOW + 1 classes every passing pair is confirmed. In larger
ones a deeper leaf may miss a pair that agrees in fewer values, so all classes outside the region's main component
are compared with all its classes, on full shingle sets: in blocks whose sets have about HELD shingles, by which the
others stream, and only links leave the task. Links are confirmed on full shingle sets from the texts.

Defined results. Null and empty texts: an empty set, linked with nothing. Fewer words than a shingle: all of
them as one. Rows that repeat a doc_id: each has a set of its own. Null doc_id: component null, kept. Extra
columns: `near_duplicates` ignores, `keep_first` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import fresh, gathered, in_arrow, stored, table
from .components import components

SHINGLE = 5
PERCENT = 75
TREES, TAKE, DEEP = 20, 3, 8
SKETCH = 128
#: Differing bits of two sketches up to which a pair passes: an estimate of at least 0.48.
NEAR = 33
WINDOW = 16
#: Classes that agree so far up to which a region goes no deeper.
LEAF = 64
#: Shingles of a larger region's classes that a task holds at once; the others stream by.
HELD = 1 << 20
#: Rows of a region that are surveyed together; more go in pieces, in order.
BLOCK = 1 << 16
_rng = np.random.default_rng(10)
_A = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2)


def shingle_sets(w: V.Words, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    h, inside = w.windows(k)
    for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        elif b > a:
            yield np.array([w.whole(d)], np.uint64)
        else:
            yield h[:0]


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(SKETCH, ~np.uint64(0))
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        for i in range(0, SKETCH, 32):
            np.minimum(out[i : i + 32], (part[None, :] * _A[i : i + 32, None] + _B[i : i + 32, None]).min(1), out=out[i : i + 32])
    return V.mix(out)


SETS = "doc_id long, row long, one long, two long, n_shingles long, signature binary"


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, row, two hashes of the shingle set (null for an empty one), its size, and 32 bits of each MinHash value."""

    def names(sets: list[np.ndarray], salt: int) -> pa.Array:
        return pa.array([int((V.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64)) if len(s) else None for s in sets], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text", 1 << 21):
                sets = list(shingle_sets(V.words(b.column(2), lower=True)))
                size = [len(s) for s in sets]
                signed = [(signature(s) >> np.uint64(32)).astype("<u4").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), names(sets, 0x5E7), names(sets, 0xC1A55), pa.array(size, pa.int64()), pa.array(signed, pa.binary())], ["doc_id", "row", "one", "two", "n_shingles", "signature"])

    return in_arrow(docs.select("doc_id", "row", "text"), run, SETS)


TREE_ROW = "key long, deep long, s0 long, s1 long, class long"


def forest(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: the hash of its first values, the next ones a byte each, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, SKETCH)
            bits = np.packbits((sig & 1).astype(bool), axis=1, bitorder="little").view("<u8")
            n = len(sig)
            names = ["key", "deep", "s0", "s1", "class"]
            for t in range(TREES):
                at = (TAKE * t + np.arange(TAKE + DEEP)) % (TREES * TAKE)
                key = np.full(n, np.uint64(t + 1))
                for i in at[:TAKE]:
                    key = V.mix(key ^ sig[:, i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                deep = np.ascontiguousarray((sig[:, at[TAKE:]] >> np.uint32(24)).astype(np.uint8)[:, ::-1]).view("<u8").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(deep.view(np.int64)), pa.array(bits[:, 0].view(np.int64)), pa.array(bits[:, 1].view(np.int64)), b.column(0)], names)

    return in_arrow(classes.select("class", "signature"), run, TREE_ROW)


def _regions(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[list[np.ndarray]]:
    """Columns of whole regions, sorted by key. Regions over `block` rows come in pieces that overlap by more than a small region has, so none of them looks small."""
    held: list[np.ndarray] | None = None
    for b in gathered(batches, 16384):
        now = [c.to_numpy() for c in b.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last region may go on
        if len(held[0]) - cut > block:
            yield held
            held = [c[-(2 * WINDOW + 2) :] for c in held]
        elif cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None:
        yield held


def _apart(s0: np.ndarray, s1: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j])


def leaves(key: np.ndarray, deep: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Where each row's leaf begins, rows being sorted by key and deep: the shallowest agreement of at most `leaf` rows; -1 where there is none."""
    out = np.full(len(key), -1)
    new = np.append(True, np.diff(key) != 0)
    for d in range(DEEP + 1):
        if d:
            new = new | np.append(True, np.diff(deep >> np.int64(8 * (DEEP - d))) != 0)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        here = np.repeat(np.where(size <= leaf, begin, -1), size)
        out = np.where(out < 0, here, out)
        if (out >= 0).all():
            break
    return out


#: kind 0: a class in a region, whose size is in `apart`; 1: its nearest neighbour there; 2: the hub, with the differing bits.
SEEN = "kind byte, key long, deep long, s0 long, s1 long, class long, other long, apart int"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, deep, s0, s1, c in _regions(batches):
        new = np.append(True, np.diff(key) != 0)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        several = np.repeat(size > 1, size)
        key, deep, s0, s1, c = (x[several] for x in (key, deep, s0, s1, c))
        size = size[size > 1]
        if not len(size):
            continue
        begin = np.cumsum(size) - size
        region = np.repeat(np.arange(len(size)), size)
        u0, u1 = s0.view(np.uint64), s1.view(np.uint64)
        n, most = len(key), int(size.max())
        leaf = leaves(key, deep)
        near, to = np.full(n, SKETCH + 1), np.zeros(n, np.int64)
        for s in range(1, min(most, max(LEAF, WINDOW + 1))):
            # neighbours have the longest common prefixes; those further off are in the same leaf
            i = np.flatnonzero((region[:-s] == region[s:]) if s <= WINDOW else (leaf[:-s] == leaf[s:]) & (leaf[s:] >= 0))
            d = _apart(u0, u1, i, i + s)
            for p, q in ((i, i + s), (i + s, i)):
                better = d < near[p]
                near[p[better]], to[p[better]] = d[better], c[q[better]]
        bits = np.unpackbits(np.column_stack([u0, u1]).view(np.uint8), axis=1)
        major = np.packbits(2 * np.add.reduceat(bits, begin, axis=0, dtype=np.int64) > size[:, None], axis=1).view(np.uint64)
        off = np.bitwise_count(u0 ^ major[region, 0]).astype(np.int64) + np.bitwise_count(u1 ^ major[region, 1])
        order = np.lexsort((c, off, region))
        hub = order[begin][region]
        to_hub = _apart(u0, u1, np.arange(n), hub)
        is_hub = hub == np.arange(n)
        stays = (near <= NEAR) | (to_hub <= NEAR) & ~is_hub | (size[region] > 2 * WINDOW + 1)
        m, a, b = np.flatnonzero(stays), np.flatnonzero(near <= NEAR), np.flatnonzero((to_hub <= NEAR) & ~is_hub)
        at = np.concatenate([m, a, b])
        kind = np.repeat(np.array([0, 1, 2], np.int8), [len(m), len(a), len(b)])
        other = np.concatenate([c[m], to[a], c[hub[b]]])
        apart = np.concatenate([size[region[m]], near[a], to_hub[b]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x[at]) for x in (key, deep, s0, s1, c)), pa.array(other), pa.array(apart)], [x.split()[0] for x in SEEN.split(", ")])


PAIR = "a long, b long"


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passing pairs of different components in small regions; rows: key, deep, s0, s1, class, root."""
    for key, _, s0, s1, c, root in _regions(batches):
        new = np.append(True, np.diff(key) != 0)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        region = np.repeat(np.arange(len(size)), size)
        u0, u1 = s0.view(np.uint64), s1.view(np.uint64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(1, min(int(size.max()), 2 * WINDOW + 1)):
            i = np.flatnonzero((region[:-s] == region[s:]) & (root[:-s] != root[s:]))
            i = i[_apart(u0, u1, i, i + s) <= NEAR]
            found.append((c[i], c[i + s]))
        p, q = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        both = np.unique(np.column_stack([np.minimum(p, q), np.maximum(p, q)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _sets(column: pa.Array) -> list[np.ndarray]:
    """Shingle sets of packed texts."""
    out: list[np.ndarray] = []
    texts = pa.RecordBatch.from_arrays([pa.array([zstandard.decompress(x.as_py()) for x in column], pa.binary())], ["text"])
    for part in V.slices(texts, "text", 1 << 21):
        out += shingle_sets(V.words(part.column(0), lower=True))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the rows with role 1 with those with role 0 before them, one for each other component; rows: key, block, role, class, root, data."""
    now, held, ready = None, [], None
    for b in batches:
        key, block, role, c, root = (b.column(i).to_numpy() for i in range(5))
        sets = _sets(b.column(5))
        found: list[tuple[int, int]] = []
        for i in range(b.num_rows):
            if (key[i], block[i]) != now:
                now, held, ready = (key[i], block[i]), [], None
            if not role[i]:
                held.append((c[i], root[i], sets[i]))
                continue
            if not held:
                continue
            if ready is None:
                sizes = np.array([len(x) for _, _, x in held])
                shingles = np.concatenate([x for _, _, x in held])
                order = np.argsort(shingles, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(shingles[order]) != 0))
                ready = (np.array([x for x, _, _ in held]), np.array([x for _, x, _ in held]), sizes, shingles[order][first], np.append(first, len(order)), np.repeat(np.arange(len(held), dtype=np.int32), sizes)[order])
                held = [()]
            classes, roots, sizes, known, first, members = ready
            at = np.searchsorted(known, sets[i])
            at = at[known[np.minimum(at, len(known) - 1)] == sets[i]]
            # the held classes that have each of the shingles
            n = first[at + 1] - first[at]
            where = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            same = np.bincount(members[where], minlength=len(sizes))
            good = (100 * same >= PERCENT * (sizes + len(sets[i]) - same)) & (roots != root[i])
            j = np.flatnonzero(good)
            for k in j[np.unique(roots[j], return_index=True)[1]]:
                found.append((int(c[i]), int(classes[k])))
        yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(2)], pa.binary())], ["doc_id", "row", "data"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(_sets(b.column(2)), _sets(b.column(3)), strict=True):
            same = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * same >= PERCENT * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(good, pa.bool_())], ["a", "b", "linked"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked of each pair of classes, by their full shingle sets; texts: class, data."""
    one = texts.select(F.col("class").alias("a"), F.col("data").alias("data_a"))
    two = texts.select(F.col("class").alias("b"), F.col("data").alias("data_b"))
    return in_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "data_a", "data_b"), _confirm, "a long, b long, linked boolean")


def _pairs(x: DataFrame) -> DataFrame:
    return x.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def links(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and root of the classes that have links, and all classes with the row of their least doc_id. docs: doc_id, row, text."""
    classes = sets.where("one is not null and doc_id is not null").groupBy("one", "two").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("signature").alias("signature"), F.max("n_shingles").alias("n"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "one", "two", "least.doc_id", "least.row", "signature", "n"), "classes")
    ordered = forest(classes).repartition("key").sortWithinPartitions("key", "deep", "class")
    seen = stored(in_arrow(ordered, _survey, SEEN), "regions")
    best = seen.where("kind > 0").groupBy("class", "kind").agg(F.min(F.struct("apart", "other")).alias("best"))
    first = stored(_pairs(best.select("class", F.col("best.other").alias("other"))), "pairs")
    large = 2 * WINDOW + 1
    wanted = first.select(F.col("a").alias("class")).unionByName(first.select(F.col("b").alias("class"))).unionByName(seen.where((F.col("kind") == 0) & (F.col("apart") > large)).select("class"))
    wanted = wanted.distinct().join(classes.select("class", "doc_id", "row"), "class")
    packed = in_arrow(docs.where("doc_id is not null").select("doc_id", "row", "text"), _packed, "doc_id long, row long, data binary")
    texts = stored(packed.join(wanted, ["row", "doc_id"]).groupBy("class").agg(F.first("data").alias("data")), "texts")
    done = stored(confirm(first, texts), "confirmed")
    good = done.where("linked").select("a", "b")
    roots = stored(components(good), "roots")
    members = seen.where("kind = 0").select("key", "deep", "s0", "s1", "class", "apart").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    members = stored(members, "members")
    # small regions by pairs
    few = members.where(F.col("apart") <= large)
    mixed = few.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    again = few.join(mixed, "key", "left_semi").select("key", "deep", "s0", "s1", "class", "root").repartition("key").sortWithinPartitions("key", "deep", "class")
    second = in_arrow(again, _between, PAIR).distinct().join(done, ["a", "b"], "left_anti")
    # large ones by blocks
    many = members.where(F.col("apart") > large)
    shares = many.join(classes.select("class", "n"), "class").groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    mains = shares.groupBy("key").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.sum("n").alias("n")).where("main.k < all").select("key", F.col("main.root").alias("main"), F.ceil(F.col("n") / HELD).cast("int").alias("blocks"))
    mains = stored(mains, "mains")  # so that AQE may split the rows of a hot region in the join
    rows = many.select("key", "class", "root").join(mains, "key")
    held = rows.select("key", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "class", "root")
    asked = rows.where("root <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "class", "root")
    with_texts = held.unionByName(asked).join(texts, "class").repartition("key", "block").sortWithinPartitions("key", "block", "role", "class")
    across = in_arrow(with_texts.select("key", "block", "role", "class", "root", "data"), _compare, PAIR).distinct()
    more = stored(confirm(second, texts).where("linked").select("a", "b").unionByName(across), "confirmed")
    if more.isEmpty():
        return roots, classes
    # only the roots that round two joins go through the components again
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    joins = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    tops = components(joins).select(F.col("node").alias("root"), F.col("root").alias("top"))
    alone = more.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("root"))
    nodes = roots.unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
    return stored(nodes.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots"), classes


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles and component_id of each row of docs, and the hashes of its set."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    sets = stored(document_sets(keyed), "sets")
    roots, classes = links(keyed, sets)
    placed = classes.select("class", "one", "two", "doc_id").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    placed = stored(placed, "placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.select("one", "two", "root").join(least, "root").select("one", "two", "component_id")
    out = sets.select("doc_id", "row", "one", "two", "n_shingles").join(named, ["one", "two"], "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs, same columns, with one row of each group; of rows that repeat the kept one's doc_id and text, one stays."""
    columns = docs.columns
    row, doc = fresh(docs, "__row"), fresh(docs, "__doc")
    kept = grouped(docs).where("doc_id is null or doc_id = component_id").select(F.col("row").alias(row), F.col("doc_id").alias(doc)).distinct()
    rows = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    first = rows.where("doc_id is not null").join(stored(kept.where(F.col(doc).isNotNull()), "kept").withColumnRenamed(row, row + "r"), (F.col(row) == F.col(row + "r")) & (F.col("doc_id").cast("long") == F.col(doc)), "left_semi")
    return first.dropDuplicates([row, "doc_id"]).unionByName(rows.where("doc_id is null")).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node AND r.root < l.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
