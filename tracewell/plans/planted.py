"""Queries over byte spaces, graphs and clocks made of the driver's tables so that SQL knows what must be found in them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytesx as B
from ..operators import choices, demux, formats, frames, layout, master, ordered, timebase
from ..session import shared_folder
from ..sources import evidence
from .recorded import LAYOUT, le, members
from .registry import query, t

#: Fragment sizes of the five sources, and all that are tried.
_SIZES = [4096, 6144, 8192, 12288, 7168]
_TRIED = [2048, 4096, 5120, 6144, 7168, 8192, 12288, 16384]

_LAYOUT = f"""WITH c AS (SELECT c_nationkey % 5 AS s, c_custkey, c_custkey % 10 AS k, ({_SIZES})[1 + c_nationkey % 5] AS size, 512 * (1 + 3 * (c_nationkey % 5)) AS o FROM customer),
a AS (SELECT s, any_value(size) AS size, any_value(o) AS o, count(*) AS n, count(*) FILTER (k <> 8) AS v, count(*) FILTER (k <= 5) AS t, count(*) FILTER (c_custkey % 3 = 0) AS p, count(*) FILTER (c_custkey % 4 = 0) AS d FROM c GROUP BY s),
x AS (SELECT *, 2.0::DOUBLE * v + 8 * t + 0.5 * p AS score FROM a)
SELECT s AS channel, CAST(size AS BIGINT) AS fragment_size, CAST(o % size AS BIGINT) AS residue, n AS tested, v AS valid, t AS timestamped, p AS padding, score, round(score / (score + 2.0 * d) * least(1.0, (v + t) / 6.0), 6) AS confidence, round(2.0 * v / (n + v + d), 6) AS fit FROM x"""


@query(_LAYOUT)
def layout_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the fragments of five sources begin and how long they are, from their bytes alone.

    A customer is a fragment: most begin with a record, most records have a time, some an impossible one; some
    fragments end in padding, and every fourth has a record that is no beginning.
    """
    c = t(spark, sf_dir, "customer").withColumn("channel", F.col("c_nationkey") % 5)
    size = F.element_at(F.array(*map(F.lit, _SIZES)), (F.col("channel") + 1).cast("int"))
    k = F.col("c_custkey") % 10
    time = F.when(k == 9, F.lit(13 << 22)).otherwise(B.pack_time(F.make_timestamp_ntz(F.lit(2024), F.lit(2), F.lit(29), F.lit(23), (F.col("c_custkey") % 60).cast("int"), F.lit(0))))
    record = lambda kind, t_: F.concat(F.when(k == 8, "5259").otherwise("5258") if kind is None else F.lit("5258"), F.when(k.isin(6, 7), "01").otherwise("02") if kind is None else F.lit(kind), F.lit("00" * 5), le(t_, 4), le(F.lit(100), 4), F.expr("repeat('61', 100)"))
    end = F.when(F.col("c_custkey") % 3 == 0, F.expr("repeat(if(c_custkey % 2 = 0, '00', 'FF'), 64)")).otherwise(F.expr("repeat('41', 64)"))
    decoy = F.when(F.col("c_custkey") % 4 == 0, record("01", F.lit(0))).otherwise(F.expr("repeat('55', 116)"))
    data = F.unhex(F.concat(record(None, time), F.expr(f"repeat('55', {1024 - 116})"), decoy, F.repeat(F.lit("55"), size - 1024 - 116 - 64), end))
    noise = c.groupBy("channel").agg(F.lit(-1).cast("long").alias("offset")).withColumn("payload", F.unhex(F.repeat(F.lit("55"), (512 * (1 + 3 * F.col("channel"))).cast("int"))))
    files = members(c.select("channel", F.col("c_custkey").alias("offset"), data.alias("payload")).unionByName(noise.select("channel", "offset", "payload")), shared_folder(spark, "layout"))
    chunks = None
    for path in files:
        one = evidence.read(spark, [path], chunk=10_000, overlap=64)
        chunks = one if chunks is None else chunks.unionByName(one)
    found = layout.best(layout.hypotheses(layout.evidence(chunks, LAYOUT, _TRIED, {2: 8})))
    return found.select(F.regexp_extract("source", r"-channel-(\d+)", 1).cast("long").alias("channel"), "fragment_size", "residue", "tested", "valid", "timestamped", "padding", "score", F.round("confidence", 6).alias("confidence"), F.round("fit", 6).alias("fit"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 512 AS BIGINT) AS size, CAST(coalesce(sum(CAST(l_quantity * 512 AS BIGINT)) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM lineitem),
n AS (SELECT max(begin + size) AS n FROM m), o AS (SELECT o_orderkey, CAST(o_orderkey * 7919 * 512 % (n * 2) AS BIGINT) + o_orderkey % 512 AS place FROM orders, n)
SELECT o_orderkey, l_orderkey, l_linenumber, place - begin AS member_offset FROM o ASOF JOIN m ON o.place >= m.begin WHERE place < begin + size""")
def member_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as members end to end, in ranges and without a window, and in which of them each order's place is; places past the end are in none."""
    members_ = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") * 512).cast("bigint").alias("size"))
    placed = ordered.scanned(members_, [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["size"]).withColumnRenamed("before_size", "begin")
    end = placed.agg(F.max(F.col("begin") + F.col("size"))).first()[0] or 1
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 * 512 % (2 * end) + F.col("o_orderkey") % 512).cast("bigint").alias("place"))
    return ordered.looked_up(o, "place", placed, "begin", "size").select("o_orderkey", "l_orderkey", "l_linenumber", (F.col("place") - F.col("begin")).alias("member_offset"))


@query("""WITH a AS (SELECT CAST(event_id // 2 AS DOUBLE) * 3600 AS x, CAST(event_id // 2 AS DOUBLE) * 3600 * 1.0001 + value / 100 AS y FROM events), p AS (SELECT median((b.y - a.y) / (b.x - a.x)) AS slope FROM a, a b WHERE a.x < b.x),
i AS (SELECT slope, median(y - slope * x) AS intercept FROM a, p GROUP BY slope)
SELECT round(slope, 10) AS slope, round(intercept, 5) AS intercept, round(max(abs(y - intercept - slope * x)), 5) AS max_residual, count(*) AS anchors FROM a, i GROUP BY slope, intercept""")
def clock_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as anchors of one clock, two for each time, whose pairs aren't made."""
    x = F.floor(F.col("event_id") / 2).cast("double") * 3600
    m = timebase.fit(t(spark, sf_dir, "events").select(x.alias("x"), (x * 1.0001 + F.col("value") / 100).alias("y")), held=512, block=2048)
    return m.select(F.round("slope", 10).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("max_residual", 5).alias("max_residual"), "anchors")


_OPTIONS = """o AS (SELECT p_partkey // 30 AS problem, p_partkey % 30 // 5 AS start, CASE WHEN p_partkey % 5 = 4 THEN [p_partkey % 30 // 5] WHEN p_size % 2 = 0 THEN [p_partkey % 30 // 5, 100 + p_size % 9] ELSE [p_partkey % 30 // 5, 100 + p_size % 9, 200 + p_partkey * 7 % 11] END AS f,
CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS u, p_size % 4 AS a, p_size % 13 / 2.0::DOUBLE AS c FROM part)"""


@query(f"""WITH RECURSIVE {_OPTIONS}, s AS (SELECT problem, start, row_number() OVER (PARTITION BY problem ORDER BY start) AS k, count(*) OVER (PARTITION BY problem) AS m FROM (SELECT DISTINCT problem, start FROM o)),
g AS (SELECT DISTINCT problem, 0 AS k, []::BIGINT[] AS used, 0 AS u, 0 AS a, 0.0::DOUBLE AS c, []::STRUCT(s BIGINT, f BIGINT[], c DOUBLE)[] AS picked FROM s
UNION ALL SELECT g.problem, g.k + 1, list_concat(g.used, o.f), g.u + o.u, g.a + o.a, g.c + o.c, list_append(g.picked, {{'s': o.start, 'f': o.f, 'c': o.c}}) FROM g JOIN s ON s.problem = g.problem AND s.k = g.k + 1 JOIN o ON o.problem = s.problem AND o.start = s.start WHERE NOT list_has_any(g.used, o.f)),
w AS (SELECT g.*, len(used) AS n, row_number() OVER x AS rank, lead(len(used)) OVER x AS n2, lead(c) OVER x AS c2 FROM g WHERE k = (SELECT max(m) FROM s WHERE s.problem = g.problem) WINDOW x AS (PARTITION BY g.problem ORDER BY len(used) DESC, u, a, c, picked)),
b AS (SELECT problem, unnest(picked) AS p, CASE WHEN n2 = n THEN greatest(0.0, c2 - c) END AS margin FROM w WHERE rank = 1)
SELECT problem, p.s AS start, array_to_string(p.f, ',') AS fragments, p.c AS cost, margin, false AS cut FROM b""")
def competing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six starts a problem whose paths compete for the same fragments, each with a short one that is always free."""
    p = t(spark, sf_dir, "part")
    start = F.floor(F.col("p_partkey") % 30 / 5)
    one, two = 100 + F.col("p_size") % 9, 200 + F.col("p_partkey") * 7 % 11
    path = F.when(F.col("p_partkey") % 5 == 4, F.array(start)).when(F.col("p_size") % 2 == 0, F.array(start, one.cast("long"))).otherwise(F.array(start, one.cast("long"), two.cast("long")))
    found = p.select(F.floor(F.col("p_partkey") / 30).alias("problem"), start.alias("start"), path.alias("fragments"), F.when(F.col("p_size") % 3 == 0, 1).otherwise(0).alias("unresolved"), (F.col("p_size") % 4).cast("int").alias("ambiguous"), (F.col("p_size") % 13 / 2.0).alias("cost"))
    chosen = choices.select_disjoint(found)
    return chosen.select("problem", "start", F.array_join(F.col("fragments").cast("array<string>"), ",").alias("fragments"), "cost", "margin", "cut")


@query("""WITH s AS (SELECT s_name AS source, s_suppkey AS k, s_suppkey % 5 AS kind, s_suppkey // 5 % 20 AS n, s_nationkey % 4 AS v FROM supplier),
c AS (SELECT source, CASE kind WHEN 0 THEN 'dhav' WHEN 1 THEN 'mpegps' WHEN 2 THEN 'annexb' WHEN 3 THEN 'hikvision' ELSE 'made' END AS plugin, CAST(CASE kind WHEN 0 THEN CASE WHEN n >= 16 THEN 0.98 WHEN n >= 8 THEN 0.92 WHEN n >= 3 THEN 0.8 WHEN n = 2 THEN 0.65 WHEN n = 1 THEN 0.55 ELSE 0 END
WHEN 1 THEN CASE WHEN n >= 2 AND v >= 2 THEN 0.9 WHEN n > 0 AND v > 0 THEN 0.7 WHEN v > 0 THEN 0.3 ELSE 0 END WHEN 2 THEN CASE v WHEN 0 THEN 0.882 WHEN 1 THEN 0.837 WHEN 2 THEN 0.495 ELSE 0.27 END
WHEN 3 THEN 0.55 + 0.44 * CASE WHEN v > 0 THEN 0.95 ELSE 0.87 END ELSE CASE WHEN n // 2 >= 16 THEN 0.96 WHEN n // 2 >= 4 THEN 0.86 WHEN n >= 16 THEN 0.7 WHEN n >= 2 THEN 0.4 WHEN n > 0 THEN 0.1 ELSE 0 END END AS DOUBLE) AS confidence FROM s)
SELECT source, plugin, round(confidence, 6) AS confidence, CASE plugin WHEN 'hikvision' THEN 'annexb' END AS runner_up, confidence < 0.6 AS requires_review FROM c WHERE confidence > 0""")
def family_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a source of one of five families, with more or less evidence; all are told apart in one scan of chunks that cut what they find.

    A master sector's numbers have a start code among their bytes (zeros before a one), so Annex B is its runner-up.
    """

    def made(k: int, nation: int) -> bytes:
        n, v = k // 5 % 20, nation % 4
        if k % 5 == 0:
            return b"noise" + b"".join(frames.build(0xFD, i % 3, i, 1 << 26, 0, b"payload" * 9) for i in range(n))
        if k % 5 == 1:
            return b"\0\0\1\xba pack" * n + b"\0\0\1\xe0 video" * v
        if k % 5 == 2:
            return b"".join(b"\0\0\1" + bytes([t]) + b" data" for t in ((0x67, 0x68, 0x65), (0x67, 0x68), (0x41,), (0x79,))[v])
        if k % 5 == 3:
            sector = bytearray(master.SIZE)
            sector[master.SIGNATURE_AT : master.SIGNATURE_AT + len(master.SIGNATURE)] = master.SIGNATURE
            values = {"capacity": v + 1 << 30, "logs_offset": 4096, "logs_size": 1 << 20, "video_offset": 1 << 29, "block_size": 1 << 30, "blocks": 1, "tree1_offset": 8192, "tree1_size": 4096, "tree2_offset": 16384, "tree2_size": 4096}
            for name, value in values.items():
                struct.pack_into("<Q", sector, master.FIELDS[name], value)
            return b"\x55" * 2000 + bytes(sector) + b"\x55" * 300
        record = lambda kind, time: b"RX" + bytes([kind]) + bytes(5) + struct.pack("<II", time, 30)
        return b"".join(record(2 if i % 2 else 1, 24 << 26 | 1 << 22 | 1 << 17).ljust(512, b"\x55") for i in range(n))

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, k, nation in b.itertuples(index=False):
                data = made(k, nation)
                # chunks of 512 bytes, and what goes on past them
                rows = [(name, i, min(512, len(data) - i), data[i : i + 512 + 256]) for i in range(0, len(data), 512)]
                yield pd.DataFrame(rows, columns=["source", "base", "size", "data"])

    chunks = t(spark, sf_dir, "supplier").select("s_name", "s_suppkey", "s_nationkey").mapInPandas(chunked, "source string, base long, size int, data binary")
    known = formats.default()
    known.register(formats.records("made", "A recorder made up", LAYOUT, {2: 8}, 2, 512))
    found = known.report(chunks.repartition("source", "base"))
    return found.select("source", "plugin", F.round("confidence", 6).alias("confidence"), "runner_up", "requires_review")


@query("""WITH c AS (SELECT c_custkey, c_nationkey % 5 AS channel, c_custkey % 10 AS k, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) - 1 AS i FROM customer),
r AS (SELECT channel, TIMESTAMP '2024-02-29 00:00:00' + to_hours(23) + to_minutes(c_custkey % 60) AS ts, i FROM c WHERE k < 6)
SELECT strftime(ts, '%H-%M') AS label, ts, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS starts FROM r WHERE channel = 0 GROUP BY ts""")
def family_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minutes of a date at which the recordings of a made up recorder begin, by its family's own scan."""
    c = t(spark, sf_dir, "customer").where("c_nationkey % 5 = 0")
    k = F.col("c_custkey") % 10
    day = F.when(k < 6, 29).otherwise(28)
    time = B.pack_time(F.make_timestamp_ntz(F.lit(2024), F.lit(2), day, F.lit(23), (F.col("c_custkey") % 60).cast("int"), F.lit(0)))
    data = F.unhex(F.concat(F.lit("525802" + "00" * 5), le(time, 4), le(F.lit(8), 4), F.repeat(F.lit("55"), F.lit(512 - 16))))
    folder = shared_folder(spark, "dated")
    files = members(c.select(F.lit(0).alias("channel"), F.col("c_custkey").alias("offset"), data.alias("payload")), folder)
    family = formats.records("made", "A recorder made up", LAYOUT, {2: 8}, 2, 512)
    found = family.scan_date(evidence.read(spark, files, chunk=10_000, overlap=64), "2024-02-29", None)
    return found.select("label", "ts", F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"))


@query("""WITH e AS (SELECT user_id % 16 AS c, event_id, chr(0) || chr(0) || chr(0) || chr(1) || 'g' || props AS x, event_id % 5 <> 0 AS video FROM events)
SELECT 'channel-' || lpad(CAST(c AS VARCHAR), 2, '0') || '.native.dhav' AS name, CAST(sum(32 + octet_length(encode(x))) AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS sha256, true AS stated FROM e GROUP BY c
UNION ALL SELECT 'channel-' || lpad(CAST(c AS VARCHAR), 2, '0') || '.h264', CAST(sum(octet_length(encode(x))) AS BIGINT), sha256(string_agg(x, '' ORDER BY event_id)), true FROM e WHERE video GROUP BY c""")
def demuxed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of sixteen channels of one byte space; their channels as files, each written by many tasks, and what the manifest states of them."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "props")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [frames.build(0xFD if n % 5 else 0xF1, u % 16, n % 2**32, 1 << 26, 0, b"\0\0\0\1g" + p.encode()) for n, u, p in b.itertuples(index=False)]
            yield pd.DataFrame({"channel": 0, "offset": b["event_id"], "payload": data})

    files = members(e.mapInPandas(made, "channel long, offset long, payload binary"), shared_folder(spark, "mixed"))
    folder = f"{shared_folder(spark, 'demuxed')}/out"
    demux.to_files(spark, (files,), folder, chunk=100_000)
    stated = spark.read.option("multiLine", True).json(f"{folder}/manifest.json").select(F.inline("files"))
    seen = spark.read.format("binaryFile").load(f"{folder}/channel-*").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    native = F.col("name").endswith(".native.dhav")
    return stated.join(seen, "name").select("name", F.col("length").alias("bytes"), F.when(~native, F.col("digest")).alias("sha256"), ((F.col("digest") == F.col("sha256")) & (F.col("length") == F.col("bytes"))).alias("stated"))
