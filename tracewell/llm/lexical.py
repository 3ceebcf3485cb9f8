"""Ranked lexical search over postings (operator 11).

The index is a DataFrame of posting blocks: a row has a term and, for a run of documents, those that hold it with their
counts and lengths. It is bucketed by a hash of the term: each task writes the blocks of its own documents sorted by
(bucket, term), so a search reads only the row groups of the buckets it asks for, a frequent term is many blocks in
many files rather than one hot key, and all postings of a document lie together. A search joins the items' terms with
the blocks, scores each match in 64-bit integers, sums by (item, document), and numbers the sums of each item; the sums
of a task's documents are complete before they are shuffled, and only the best k of an item leave a task in the last step.

Terms are maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z lower-cased: on UTF-8, runs of ASCII
letters and digits and of bytes from 0x80 on.

Defined results. Null and empty texts, and texts without a term, are no documents: N doesn't count them. Rows that
repeat a doc_id are documents of their own, and take ranks of their own. Null doc_id: ranked, after all others of equal
score. Rows of one item_id are one item, whose terms add up; a null item_id is an item as well. Items without a term, or
whose terms are in no document, have no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext as V
from .common import in_arrow, stored, table

TOP = 20
BUCKETS = 256
#: Bytes of text whose postings a task makes together.
HELD = 1 << 23
#: Rows of item terms up to which they are broadcast; some 40 bytes each. More are joined by a shuffle.
FEW = 1 << 18
#: Items of one term in a row of that join.
ASKED = 4096
SCALE = 1_000_000_000

BLOCK = "term string, n_docs long, n_terms long, row array<long>, doc_id array<long>, tf array<int>, n array<int>"


def _term_bytes(data: np.ndarray) -> np.ndarray:
    return (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))


def _blocks(b: pa.Table) -> Iterator[pa.RecordBatch]:
    """The posting blocks of these documents, and a row without a term that has their number and length."""
    w = V.coded(b.column("text"), _term_bytes, lower=True)
    if not len(w.code):
        return
    size = np.diff(w.first)
    n = len(size)
    pairs, tf = np.unique(w.code * n + np.repeat(np.arange(n), size), return_counts=True)
    code, doc = pairs // n, pairs % n
    begin = np.flatnonzero(np.append(True, np.diff(code) != 0))
    ends = pa.array(np.append(begin, len(code)).astype(np.int32))
    lists = [
        b.column("row").combine_chunks().take(pa.array(doc)), b.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(size[doc].astype(np.int32)),
    ]
    terms = w.vocabulary.take(pa.array(code[begin])).cast(pa.large_string()).cast(pa.string())
    held = pa.array(np.diff(np.append(begin, len(code))))
    out = pa.RecordBatch.from_arrays([terms, held, pa.nulls(len(begin), pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in lists)], [c.split()[0] for c in BLOCK.split(", ")])
    yield from (out.slice(i, 8192) for i in range(0, out.num_rows, 8192))
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([int((size > 0).sum())]), pa.array([len(w.code)]), *(pa.nulls(1, c.type) for c in out.columns[3:])], out.schema.names)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for b in V.slices(whole, "text", HELD):
            held.append(b)
            size += pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
            if size >= HELD:
                yield from _blocks(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield from _blocks(pa.Table.from_batches(held))


def index(docs: DataFrame) -> DataFrame:
    """The posting blocks of docs (doc_id, text), bucketed by term, in the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = in_arrow(rows, _gather, BLOCK, 1024).withColumn("bucket", bucket("term"))
    return stored(blocks.sortWithinPartitions("bucket", "term"), "postings")


def bucket(term: str):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, repeats of items (item_id, text)."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def search(blocks: DataFrame, items: DataFrame, top: int = TOP, few: int = FEW) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` best documents of each item."""
    asked = stored(item_terms(items), "item-terms")
    small = asked.count() <= few
    sized = F.broadcast if small else (lambda x: x)
    terms = asked.select("term").distinct()
    wanted = [r[0] for r in terms.select(bucket("term")).distinct().collect()]  # at most BUCKETS numbers
    n_docs, n_terms = blocks.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    read = blocks.where(F.col("bucket").isin(wanted) & F.col("term").isNotNull())
    df = read.select("term", "n_docs").join(sized(terms), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = asked.join(df, "term").withColumn("weight", weight * F.col("repeats")).where("weight > 0")
    chunked = weighed.groupBy("term", (F.xxhash64("item_id") % 1024).alias("part")) if not small else weighed.groupBy("term")
    asks = stored(chunked.agg(F.collect_list(F.struct("item_id", "weight")).alias("asks")).select("term", "asks"), "asks")
    postings = read.join(sized(asks), "term").select("asks", F.inline(F.arrays_zip("row", "doc_id", "tf", "n")))
    m = f"(75L + (25L * n * {n_docs}L) div {max(n_terms, 1)}L)"
    scored = postings.select("asks", "row", "doc_id", F.expr(f"({SCALE}L * tf) div (1000L * tf + 12L * {m})").alias("part"))
    matches = scored.select("row", "doc_id", "part", F.inline("asks")).select("item_id", "row", "doc_id", (F.col("weight") * F.col("part")).alias("score"))
    sums = matches.groupBy("item_id", "row").agg(F.min("doc_id").alias("doc_id"), F.sum("score").alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
p AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM t),
c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS n_terms FROM p),
d AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM c, s GROUP BY term, n_docs),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN d USING (term) JOIN c USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY rank <= {TOP}
"""
