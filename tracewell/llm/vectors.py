"""Near-duplicate vectors by Euclidean p-stable hashing (operator 12).

Equal vectors are one class; the rest works on classes. A vector is normalised, projected on Gaussian directions, shifted,
and quantised in steps of STEP; `depth` such numbers are its bucket in one of several tables. Vectors of cosine 0.95 are 0.316
apart and agree in one number with probability 0.874, unrelated ones (1.414 apart) with 0.485. `plan` sets depth and
tables by the number of vectors, so that a bucket has about LOAD unrelated vectors at most and a pair at the threshold
shares none with probability MISS: 10 numbers and 16 tables up to a million vectors, and some n**0.19 beyond. Tables are
made ROUND at a time, so that what is shuffled at once doesn't grow with their number.

Buckets carry ids and a sketch of SKETCH sign bits, not vectors. Classes of a bucket whose sketches differ in at most NEAR bits
are joined (threshold plus 5 standard deviations); a region is a component of that. Groups of close copies are gathered
before the shuffle: of those in a batch that differ from one by at most CLOSE bits only this one is sent on, with a wider
reach. So every pair that shares a bucket is in one region, however large.

Then all cosines within a region are exact, in double precision: links that no table found are found here too. Regions up
to HELD classes are compared in one task. Of a larger one, a class nearer to the centre than half the threshold's angle is core;
any two of the core are linked, so that they are counted, not compared. The others are compared with all, in blocks. No pairs
leave a task: only counts, and the edges of a spanning forest.

Defined results. Null, empty and zero vectors, and those with a null, NaN or infinite component: no links, a component of
their own. Vectors of different lengths aren't linked. Rows that repeat a vec_id: each is a vector of its own, and they
share a component_id only if linked or equal. Null vec_id: no links, component null, kept. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import gathered, in_arrow, stored, table
from .components import components

LEAST = 0.95
STEP = 2.0
#: Probabilities that one quantised projection agrees, at distances 0.316 and 1.414.
ALIKE, APART = 0.874, 0.485
LOAD, MISS, DEPTH = 1000, 0.01, 10
ROUND = 16
SKETCH, NEAR, CLOSE = 128, 30, 8
#: Classes of a bucket in one batch from which copies are gathered.
MANY = 16
HELD = 2048


def plan(n: int) -> tuple[int, int]:
    """Numbers of a bucket and tables for n vectors."""
    depth = max(DEPTH, math.ceil(math.log(max(n / LOAD, 1)) / -math.log(APART)))
    return depth, math.ceil(math.log(MISS) / math.log(1 - ALIKE**depth))


def unit(data: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = np.frombuffer(b"".join(data.to_pylist()), kind).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def prepared(vectors: DataFrame) -> tuple[DataFrame, str]:
    """node (a number of the row), vec_id, data (the components' bytes; null if they can't be compared), and the components' type."""
    wide = vectors.schema["embedding"].dataType.elementType.simpleString() != "float"
    kind = "<f8" if wide else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2).cast(pa.list_(pa.float64() if wide else pa.float32()))
            values = column.flatten()
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            v = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(v))])
            some = np.concatenate([[0], np.cumsum(v != 0)])
            good = (wrong[at[1:]] == wrong[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            raw, width = v.tobytes(), v.itemsize
            data = [raw[width * at[i] : width * at[i + 1]] if g else None for i, g in enumerate(good.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["node", "vec_id", "data"])

    rows = vectors.select(F.monotonically_increasing_id().alias("node"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return stored(in_arrow(rows, run, "node long, vec_id long, data binary", 8192), "vectors"), kind


def _directions(size: int, depth: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([12, size])
    signs = rng.standard_normal((size, SKETCH))
    shift = rng.uniform(0, STEP, 4096)
    return signs, np.hstack([np.random.default_rng([13, size, t]).standard_normal((size, depth)) for t in range(tables)]), np.resize(shift, depth * tables)


def _bits(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(s[0][i] ^ s[0][j]).astype(np.int64) + np.bitwise_count(s[1][i] ^ s[1][j])


#: A class in a bucket (other null), or one that was gathered to another.
BUCKET = "key long, s0 long, s1 long, node long, wide byte, other long"


def buckets(classes: DataFrame, kind: str, depth: int, low: int, high: int) -> DataFrame:
    """The buckets of classes (node, data) in tables low to high - 1."""

    def gather(key: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The member that each was gathered to, and who gathered any."""
        to = np.arange(len(key))
        order = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        size = np.diff(np.append(begin, len(key)))
        for a, n in zip(begin[size > MANY], size[size > MANY], strict=True):
            left = order[a : a + n]
            while len(left) > 1:
                near = _bits(s, left, left[0]) <= CLOSE
                to[left[near]] = left[0]
                left = left[~near]
        wide = np.zeros(len(key), bool)
        wide[to[to != np.arange(len(key))]] = True
        return to, wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for b in gathered(batches, 8192):
            lengths = pc.binary_length(b.column(1)).to_numpy()
            for length in np.unique(lengths):
                part = b.filter(pa.array(lengths == length))
                x, node = unit(part.column(1), kind), part.column(0).to_numpy()
                size = x.shape[1]
                if size not in known:
                    known[size] = _directions(size, depth, high)
                signs, lines, shift = known[size]
                s = np.packbits(x @ signs > 0, axis=1).view(np.uint64).T
                at = np.floor((x @ lines[:, low * depth :] + shift[low * depth :]) / STEP).astype(np.int64).view(np.uint64)
                for t in range(low, high):
                    key = V.mix(np.full(len(x), (size << 20) + t, np.uint64))
                    for i in range(depth):
                        key = V.mix(key + at[:, (t - low) * depth + i] * np.uint64(0xD1342543DE82EF95))
                    to, wide = gather(key, s)
                    gone = to != np.arange(len(x))
                    columns = [*(pa.array(c.view(np.int64)) for c in (key, np.ascontiguousarray(s[0]), np.ascontiguousarray(s[1]))), pa.array(node), pa.array(wide.astype(np.int8)), pa.array(node[to], mask=~gone)]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BUCKET.split(", ")])

    return in_arrow(classes.select("node", "data"), run, BUCKET, 8192)


def _joined(s: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """For each member of a bucket the first one of its component. Those reached leave the rest, so close copies cost one look each."""
    n = len(wide)
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        ahead = [first]
        while ahead and len(left):
            i = ahead.pop()
            near = _bits(s, left, i) <= NEAR + CLOSE * (wide[left] + wide[i])
            if near.any():
                root[left[near]] = first
                ahead += left[near].tolist()
                left = left[~near]
    return root


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a spanning forest of each bucket; rows in order of key."""

    def whole() -> Iterator[list[np.ndarray]]:
        held: list[np.ndarray] | None = None
        for b in gathered(batches, 16384):
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] + [b.column(4).to_numpy().astype(np.int64)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last bucket may go on
            if cut:
                yield [c[:cut] for c in held]
                held = [c[cut:] for c in held]
        if held is not None:
            yield held

    for key, s0, s1, node, wide in whole():
        begin = np.flatnonzero(np.append(True, np.diff(key) != 0))
        size = np.diff(np.append(begin, len(key)))
        s = np.stack([s0.view(np.uint64), s1.view(np.uint64)])
        few = np.repeat(size <= MANY, size)
        a, b = [], []
        group = np.repeat(np.arange(len(size)), size)
        for shift in range(1, min(int(size.max()), MANY)):
            i = np.flatnonzero((group[:-shift] == group[shift:]) & few[shift:])
            i = i[_bits(s, i, i + shift) <= NEAR + CLOSE * (wide[i] + wide[i + shift])]
            a.append(node[i])
            b.append(node[i + shift])
        for x, n in zip(begin[size > MANY], size[size > MANY], strict=True):
            root = _joined(s[:, x : x + n], wide[x : x + n])
            far = np.flatnonzero(root != np.arange(n))
            a.append(node[x + root[far]])
            b.append(node[x + far])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])


def regions(classes: DataFrame, kind: str, n: int) -> DataFrame:
    """node and root of the classes that may have links."""
    depth, tables = plan(n)
    found = None
    for low in range(0, tables, ROUND):
        dealt = buckets(classes, kind, depth, low, min(low + ROUND, tables)).repartition("key").sortWithinPartitions("key")

        def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rest() -> Iterator[pa.RecordBatch]:
                for b in batches:
                    lone = b.column(5).is_null()
                    ready.append(b.filter(pc.invert(lone)))
                    yield b.filter(lone)

            ready: list[pa.RecordBatch] = []
            for out in _edges(rest()):
                yield out
                while ready:
                    b = ready.pop()
                    yield pa.RecordBatch.from_arrays([b.column(5), b.column(3)], ["a", "b"])
            while ready:
                b = ready.pop()
                yield pa.RecordBatch.from_arrays([b.column(5), b.column(3)], ["a", "b"])

        one = stored(in_arrow(dealt, edges, "a long, b long", 8192).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        found = one if found is None else found.unionByName(one)
    return stored(components(found), "regions")


def _forest(linked: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of a matrix of links; label: of the columns' components so far, updated."""
    out = []
    for i in range(len(linked)):
        at = np.flatnonzero(linked[i])
        labels, first = np.unique(label[at], return_index=True)
        out += [(i, int(at[f])) for f in first]
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]
    return out


def _group(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            new = np.zeros(n, bool)
            new[i] = True
            while new.any():
                root[new] = i
                new = linked[new].any(0) & (root < 0)
    return root


RESULT = "node long, links long, component_id long"


def _small(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links and components of whole regions; rows: root, node, copies, least, data, in order of root."""

        def one(rows: pa.RecordBatch) -> pa.RecordBatch:
            x = unit(rows.column(4), kind)
            copies, least = rows.column(2).to_numpy(), rows.column(3).to_numpy()
            linked = x @ x.T >= LEAST
            np.fill_diagonal(linked, True)
            root = _group(linked)
            low = np.full(len(x), np.iinfo(np.int64).max)
            np.minimum.at(low, root, least)
            return pa.RecordBatch.from_arrays([rows.column(1), pa.array(linked @ copies - copies), pa.array(low[root])], ["node", "links", "component_id"])

        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            root = b.column(0).to_numpy()
            for begin, end in zip(*(lambda c: (np.append(0, c), np.append(c, len(root))))(np.flatnonzero(np.diff(root)) + 1), strict=True):
                if begin == end:
                    continue
                if held and root[begin] != now:
                    yield one(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                now = root[begin]
                held.append(b.slice(begin, end - begin))
        if held:
            yield one(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _large(members: DataFrame, kind: str, held: int) -> DataFrame:
    """Links and components of large regions; members: root, node, copies, least, data."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            root = b.column(0).to_numpy()
            for r in np.unique(root):
                total[r] = total.get(r, 0) + unit(b.column(1).filter(pa.array(root == r)), kind).sum(0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["root", "total"])

    parts = in_arrow(members.select("root", "data"), sums, "root long, total array<double>", 8192)
    centre = parts.select("root", F.posexplode("total").alias("at", "x")).groupBy("root", "at").agg(F.sum("x").alias("x"))
    centre = stored(centre.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("centre")), "centres")

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # two vectors within half the threshold's angle of a third are within the threshold's angle
        least = math.cos(math.acos(LEAST) / 2) + 1e-9
        for b in batches:
            root = b.column(0).to_numpy()
            core = np.zeros(len(root), bool)
            for r in np.unique(root):
                mine = np.flatnonzero(root == r)
                c = np.array(b.column(5)[int(mine[0])].as_py())
                length = np.sqrt(c @ c)
                if length > 0:
                    core[mine] = unit(b.column(4).take(pa.array(mine)), kind) @ (c / length) >= least
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(core)], ["root", "node", "copies", "least", "data", "core"])

    joined = members.join(centre, "root").select("root", "node", "copies", "least", "data", "centre")
    flagged = stored(in_arrow(joined, cores, "root long, node long, copies long, least long, data binary, core boolean", 4096), "members")
    of = flagged.groupBy("root").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("cores"), F.min(F.when(F.col("core"), F.col("node"))).alias("hub"), F.count_if(~F.col("core")).alias("others"),
    )
    of = stored(of.withColumn("blocks", F.ceil(F.col("size") / held).cast("int")), "sizes")
    rows = flagged.join(of, "root")
    base = rows.where("core").select("node", (F.col("cores") - F.col("copies")).alias("n"))
    stars = rows.where("core and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    mixed = rows.where("others > 0")
    columns = ["root", "block", "role", "node", "copies", "core", "data"]
    all_ = mixed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("role", F.lit(0)).select(*columns)
    asked = mixed.where("not core").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1)).select(*columns)
    dealt = all_.unionByName(asked).repartition("root", "block").sortWithinPartitions("root", "block", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows a, b: an edge; a, n: links of a that were counted here."""
        now, mine, ready = None, [], None
        for b in batches:
            root, block, role = (b.column(i).to_numpy() for i in range(3))
            turn = np.flatnonzero((np.diff(root) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for i, j in zip(np.append(0, turn), np.append(turn, len(root)), strict=True):
                if i == j:
                    continue
                if (root[i], block[i]) != now:
                    now, mine, ready = (root[i], block[i]), [], None
                part = b.slice(i, j - i)
                if not role[i]:
                    mine.append(part)
                    continue
                if not mine:
                    continue
                if ready is None:
                    all_ = pa.Table.from_batches(mine).combine_chunks().to_batches()[0]
                    core = all_.column(5).to_numpy(zero_copy_only=False)
                    label = np.arange(len(core))
                    label[core] = np.flatnonzero(core)[0] if core.any() else 0
                    ready = all_.column(3).to_numpy(), all_.column(4).to_numpy(), core, unit(all_.column(6), kind), label
                node, copies, core, x, label = ready
                own, own_copies = part.column(3).to_numpy(), part.column(4).to_numpy()
                linked = (unit(part.column(6), kind) @ x.T >= LEAST) & (own[:, None] != node[None, :])
                counted = linked @ copies
                given = own_copies @ linked * core
                edges = _forest(linked, label)
                a = np.concatenate([own, node[given > 0], own[[e[0] for e in edges]] if edges else own[:0]])
                n = np.concatenate([counted, given[given > 0], np.zeros(len(edges), np.int64)])
                e = np.concatenate([own, node[given > 0], node[[e[1] for e in edges]] if edges else own[:0]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(e), pa.array(n)], ["a", "b", "n"])

    seen = stored(in_arrow(dealt, compare, "a long, b long, n long", 2048), "compared")
    links = base.unionByName(seen.where("n > 0").select(F.col("a").alias("node"), "n")).groupBy("node").agg(F.sum("n").alias("links"))
    edges = stars.unionByName(seen.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    tops = stored(components(edges).withColumnRenamed("root", "top"), "tops")
    placed = flagged.select("node", "least").join(links, "node", "left").join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    low = placed.groupBy("top").agg(F.min("least").alias("component_id"))
    return placed.join(low, "top").select("node", F.coalesce("links", F.lit(0)).alias("links"), "component_id")


def near_vectors(vectors: DataFrame, held: int = HELD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding array<float or double>)."""
    rows, kind = prepared(vectors)
    usable = rows.where("data is not null and vec_id is not null")
    hashed = [F.xxhash64("data").alias("h1"), F.xxhash64(F.lit(12), "data").alias("h2"), F.length("data").alias("h3")]
    names = ["h1", "h2", "h3"]
    groups = usable.select("node", "vec_id", *hashed).groupBy(*names).agg(F.min("node").alias("class"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    copied = stored(groups.where("copies > 1"), "copied")
    named = usable.select("*", *hashed).join(copied, names, "left").select("node", "vec_id", F.coalesce("class", "node").alias("class"), F.coalesce("least", "vec_id").alias("least"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "data")
    classes = named.where("node = class").select("node", "least", "copies", "data")
    region = regions(classes, kind, rows.count())
    members = stored(classes.join(region, "node").select("root", "node", "copies", "least", "data"), "members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    big = stored(sizes.where(F.col("size") > held).select("root"), "large")
    few = members.join(big, "root", "left_anti").repartition("root").sortWithinPartitions("root", "node")
    found = in_arrow(few, _small(kind), RESULT, 2048)
    if not big.isEmpty():
        found = found.unionByName(_large(members.join(big, "root", "left_semi"), kind, held))
    found = stored(found.where("links > 0").withColumnRenamed("node", "class"), "links")
    out = named.select("vec_id", "class", "least", "copies").join(found, "class", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    alone = rows.where("data is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node AND r.root < p.b),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept FROM embeddings JOIN r ON node = vec_id LEFT JOIN n ON a = vec_id GROUP BY vec_id, n
"""
