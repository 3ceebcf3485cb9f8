"""Queries over files that are first made of the driver's tables: byte spaces, recordings in them, reports, logs and streams."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytesx as B
from ..operators import carry, detect, integrity, rebuild, storage
from ..session import shared_folder
from ..sources import evidence, reports, sinks
from ..streaming import carry as streamed
from ..streaming import reassembly, windows
from . import corpus
from .registry import query, t


def le(c: Column, n: int) -> Column:
    """c as hexadecimal of n little-endian bytes."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(c.cast("bigint"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)))


def members(pieces: DataFrame, folder: str) -> list[str]:
    """Files of pieces (channel, offset, payload), in the order of channels."""
    names = sinks.write_streams(pieces.select(F.lit("made").alias("source"), "channel", F.lit("raw").alias("codec"), "offset", "payload"), folder)
    return [os.path.join(folder, n) for n in sorted(names, key=lambda n: int(re.findall(r"-channel-(\d+)", n)[-1]))]


@query("""WITH a AS (SELECT string_agg(s_name || ',' || s_acctbal || chr(10), '' ORDER BY s_nationkey, s_suppkey) AS x FROM supplier), b AS (SELECT x, unnest(range(100, least(length(x), 2000000), 777)) AS base FROM a)
SELECT CAST((base - 100) // 777 AS BIGINT) AS chunk, base, CAST(least(777, least(length(x), 2000000) - base) AS INTEGER) AS size, sha256(substr(x, base + 1, CAST(least(777, least(length(x), 2000000) - base) + 32 AS BIGINT))) AS sha256 FROM b""")
def evidence_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of suppliers by nation, joined end to end and read in chunks with overlap from byte 100 on."""
    s = t(spark, sf_dir, "supplier")
    line = F.encode(F.concat("s_name", F.lit(","), F.col("s_acctbal").cast("string"), F.lit("\n")), "UTF-8")
    files = members(s.select(F.col("s_nationkey").alias("channel"), F.col("s_suppkey").alias("offset"), line.alias("payload")), shared_folder(spark, "evidence"))
    chunks = evidence.read(spark, files, layout="concat", chunk=777, overlap=32, start=100, stop=2000000)
    return chunks.select("chunk", "base", "size", F.sha2("data", 256).alias("sha256"))


#: Records of the recorder that the queries make up: a time at 8, the payload's size at 12; type 2 begins a recording.
LAYOUT = carry.Layout(b"RX", {1: (16, 12, "<I"), 2: (16, 12, "<I"), 3: (16, 12, "<I")}, most=1 << 16)
FRAGMENT = 4096
#: What a camera's customer says. All records are multiples of 8 bytes but a camera's first, so that no two cameras' records end alike, nor with a fragment.
_PAYLOAD = """c_name || repeat(chr(CAST(65 + c_custkey % 26 AS INTEGER)), CAST(406 + c_custkey * 37 % 60 * 8 + CASE WHEN c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey % 5) THEN c_nationkey % 5 + 1 ELSE 0 END AS INTEGER))"""


def _recorded(spark: SparkSession, sf_dir: str) -> rebuild.Fragments:
    """Customers as records of five cameras, by nation; the cameras' fragments take turns in the space, each camera's last ends in padding."""
    c = t(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("channel"), F.col("c_custkey").alias("offset"), F.expr(_PAYLOAD.replace("chr(", "char(")).alias("text"))
    first = F.min("offset").over(Window.partitionBy("channel"))
    kind = F.when(F.col("offset") == first, 2).when(F.col("offset") % 10 == 7, 3).otherwise(1)
    time = B.pack_time(F.make_timestamp_ntz(*(F.lit(x) for x in (2024, 1, 15, 10)), F.col("channel").cast("int"), F.lit(30)))
    head = F.unhex(F.concat(F.lit("5258"), le(kind, 1), F.lit("00" * 5), le(time, 4), le(F.octet_length("text"), 4)))
    pieces = c.select("channel", "offset", F.concat(head, F.encode("text", "UTF-8")).alias("payload"))
    # a last record up to 64 bytes of padding at a fragment's end, then what was never recorded, up to the longest camera's end
    sizes = pieces.groupBy("channel").agg(F.sum(F.octet_length("payload")).alias("n"))
    sizes = sizes.withColumn("filler", (F.pmod(F.lit(FRAGMENT - 64 - 17) - F.col("n"), F.lit(FRAGMENT)) + 1).cast("int")).withColumn("n", F.col("n") + 16 + F.col("filler") + 64)
    sizes = sizes.withColumn("rest", (F.max("n").over(Window.partitionBy()) - F.col("n")).cast("int"))
    last = F.concat(F.lit("525803" + "00" * 9), le(F.col("filler"), 4), F.expr("repeat('66', filler)"), F.lit("00" * 64), F.expr("repeat('55', rest)"))
    ends = sizes.select("channel", F.lit(1 << 60).alias("offset"), F.unhex(last).alias("payload"))
    files = members(pieces.unionByName(ends), shared_folder(spark, "recorded"))
    return rebuild.Fragments((files, "raid0", FRAGMENT, 0), FRAGMENT)


def _starts(spark: SparkSession, of: rebuild.Fragments) -> DataFrame:
    return rebuild.recording_starts(rebuild.heads(spark, of), b"RX\x02", 8, "2024-01-15", of.size)


@query("""SELECT strftime(TIMESTAMP '2024-01-15 10:00:30' + to_minutes(c_nationkey % 5), '%H-%M') AS label, TIMESTAMP '2024-01-15 10:00:30' + to_minutes(c_nationkey % 5) AS ts, CAST(c_nationkey % 5 AS VARCHAR) AS starts, CAST(1 AS INTEGER) AS candidates FROM customer GROUP BY c_nationkey % 5""")
def recording_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts by the headers of all fragments: camera n's recording starts in fragment n."""
    return _starts(spark, _recorded(spark, sf_dir)).select("label", "ts", F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"), "candidates")


@query(f"""WITH c AS (SELECT c_nationkey % 5 AS start, c_custkey, c_custkey % 10 <> 7 OR c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey % 5) AS media, {_PAYLOAD} AS x FROM customer), s AS (SELECT start, sum(length(x) + 16) AS n FROM c GROUP BY 1)
SELECT CAST(start AS BIGINT) AS start, CAST(ceil((any_value(n) + 17 + 64) / {FRAGMENT}) AS INTEGER) AS fragments, count(*) FILTER (media) AS records, CAST(sum(length(x)) FILTER (media) AS BIGINT) AS bytes,
sha256(string_agg(x, '' ORDER BY c_custkey) FILTER (media)) AS sha256, CAST(0 AS BIGINT) AS left_over, CAST(NULL AS VARCHAR) AS error, true AS in_order FROM c JOIN s USING (start) GROUP BY 1""")
def rebuild_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From headers to payloads: starts, beams of carried records, disjoint paths, and the records of media types along them."""
    of = _recorded(spark, sf_dir)
    starts = _starts(spark, of).select(F.lit(0).alias("problem"), F.explode("starts").alias("start"))
    r = rebuild.recover(spark, starts, of, LAYOUT, frozenset({1, 2}))
    # the space deals fragments to cameras in turn
    own = F.col("fragments") == F.transform(F.sequence(F.lit(0), F.size("fragments") - 1), lambda i: F.col("start") + i * 5)
    return r.select("start", F.size("fragments").alias("fragments"), "records", "bytes", "sha256", "left_over", "error", own.alias("in_order"))


@query(f"""WITH c AS (SELECT c_nationkey % 5 AS start, c_custkey, c_custkey % 10 <> 7 OR c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey % 5) AS media, {_PAYLOAD} AS x FROM customer)
SELECT 'made-0-' || start || '.es' AS name, count(*) FILTER (media) AS records, CAST(sum(length(x)) FILTER (media) AS BIGINT) AS bytes, sha256(string_agg(x, '' ORDER BY c_custkey) FILTER (media)) AS sha256, true AS as_stated, 'REVIEW' AS status, true AS codec_not_sure FROM c GROUP BY start""")
def recovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings as files, written by many tasks each, and what their bytes and the manifest say."""
    of = _recorded(spark, sf_dir)
    starts = _starts(spark, of).select(F.lit(0).alias("problem"), F.explode("starts").alias("start"))
    folder = f"{shared_folder(spark, 'recovered')}/out"
    rebuild.recover_files(spark, starts, of, LAYOUT, frozenset({1, 2}), folder, "made")
    about = spark.read.option("multiLine", True).json(f"{folder}/manifest.json")
    stated = spark.read.schema("name string, records long, bytes long, sha256 string, status string, reasons array<string>").json(f"{folder}/candidates")
    seen = spark.read.format("binaryFile").load(f"{folder}/made-*").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length"), F.sha2("content", 256).alias("digest"))
    good = (F.col("digest") == F.col("sha256")) & (F.col("length") == F.col("bytes")) & (F.col("unwritten") == 0) & (F.col("recordings") == 5)
    return stated.join(seen, "name").crossJoin(about.select("unwritten", "recordings")).select("name", "records", "bytes", F.col("digest").alias("sha256"), good.alias("as_stated"), "status", F.array_contains("reasons", "codec not sure").alias("codec_not_sure"))


@query("""SELECT o_custkey % 64 AS source, CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '*' END AS status, count(*) AS blocks, CAST(sum(o_orderkey * 4096) AS BIGINT) AS at, CAST(sum(o_custkey % 900) AS BIGINT) AS size FROM orders WHERE o_custkey % 900 > 0 GROUP BY ALL""")
def ddrescue_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of each of 64 sources, with comments and status lines, positions in hexadecimal or decimal, and empty blocks."""
    o = t(spark, sf_dir, "orders")
    number = lambda c: F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("0x"), F.hex(c))).otherwise(c.cast("string"))
    line = F.concat_ws("  ", number(F.col("o_orderkey") * 4096), number(F.col("o_custkey") % 900), F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise("*"))
    head = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("# Mapfile. Created by GNU ddrescue"), F.lit("0x0  ?  1"), line)).otherwise(F.array(line))
    path = f"{shared_folder(spark, 'maps')}/maps"
    o.select((F.col("o_custkey") % 64).alias("source"), F.explode(head).alias("value")).write.partitionBy("source").text(path)
    m = reports.mapfile(spark, f"{path}/source=*")
    return m.groupBy(F.regexp_extract("source", r"source=(\d+)", 1).cast("bigint").alias("source"), "status").agg(F.count(F.lit(1)).alias("blocks"), F.sum("pos").alias("at"), F.sum("size").alias("size"))


@query("""WITH n AS (SELECT *, md5(n_name) AS h FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 7 <> 3),
p AS (SELECT *, 1 AS number, 2048 + n_nationkey * 8 AS a, n_name AS name FROM n UNION ALL SELECT *, 3, 4048 + n_nationkey * 8, 'Ünï ' || n_name FROM n)
SELECT n_name AS source, CAST(512 AS INTEGER) AS sector_size, CAST(number AS INTEGER) AS number, '0fc63daf-8483-4772-8e79-3d69d8477de4' AS type_guid,
lower(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS unique_guid,
CAST(a AS BIGINT) AS first_lba, CAST(a + 999 AS BIGINT) AS last_lba, name FROM p""")
def gpt_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of two partitions for each nation. In some the partitions overlap, in others a checksum is wrong; those aren't valid."""
    linux = "AF3DC60F838472478E793D69D8477DE4"
    n = t(spark, sf_dir, "nation").withColumn("a", F.lit(2048) + F.col("n_nationkey") * 8)

    def entry(a: Column, name: Column) -> Column:
        return F.concat(F.lit(linux), F.md5("n_name"), le(a, 8), le(a + 999, 8), F.lit("00" * 8), F.rpad(F.hex(F.encode(name, "UTF-16LE")), 144, "0"))

    second = F.col("a") + F.when(F.col("n_nationkey") % 5 == 4, 999).otherwise(2000)
    table = F.unhex(F.concat(entry(F.col("a"), F.col("n_name")), F.lit("00" * 128), entry(second, F.concat(F.lit("Ünï "), "n_name")), F.lit("00" * 128 * 125)))
    n = n.withColumn("table", table)
    front, back = F.lit("4546492050415254" + "00000100" + "5C000000"), [F.lit("00000000"), *(le(F.lit(x), 8) for x in (1, 99999, 34, 90000)), F.lit("11" * 16), le(F.lit(2), 8), le(F.lit(128), 4), le(F.lit(128), 4), le(F.crc32("table"), 4)]
    crc = F.crc32(F.unhex(F.concat(front, F.lit("00000000"), *back))) + F.when(F.col("n_nationkey") % 7 == 3, 1).otherwise(0)
    data = F.concat(F.unhex(F.lit("00" * 512)), F.unhex(F.rpad(F.concat(front, le(crc, 4), *back), 1024, "0")), "table")
    return storage.gpt(n.select(F.col("n_name").alias("source"), data.alias("data")))


@query("""SELECT s_suppkey AS key, s_name AS model, CASE WHEN s_suppkey % 4 > 0 THEN 'S' || s_suppkey END AS serial, s_suppkey * 512 AS capacity, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 50 END AS reallocated, s_suppkey + 7 AS power_on_hours,
CAST(NULL AS BIGINT) AS uncorrectable, CAST(s_nationkey AS BIGINT) AS pending, CAST(NULL AS BIGINT) AS offline_uncorrectable FROM supplier UNION ALL SELECT -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def smart_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each supplier as a disk, some without a serial number or an attribute, and a line that isn't JSON."""
    s = t(spark, sf_dir, "supplier")
    raw = lambda i, v: F.struct(F.lit(i).alias("id"), F.struct(v.cast("bigint").alias("value"), v.cast("string").alias("string")).alias("raw"))
    attributes = F.array_compact(F.array(F.when(F.col("s_suppkey") % 3 == 0, raw(5, F.col("s_suppkey") % 50)), raw(9, F.col("s_suppkey") + 7), raw(197, F.col("s_nationkey")), raw(240, F.lit(1))))
    body = F.struct(F.col("s_name").alias("model_name"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("S"), "s_suppkey")).alias("serial_number"), F.struct((F.col("s_suppkey") * 512).alias("bytes")).alias("user_capacity"), F.struct(attributes.alias("table")).alias("ata_smart_attributes"))
    return reports.smart(s.select(F.col("s_suppkey").alias("key"), F.to_json(body).alias("json")).unionByName(spark.range(1).select(F.lit(-1).alias("key"), F.lit("no JSON").alias("json"))))


@query("SELECT 'audit' AS chain, count(*) AS entries, count(*) FILTER (s_suppkey % 17 = 3) AS bad, min(s_suppkey + 1) FILTER (s_suppkey % 17 = 3) AS first_bad FROM supplier")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash-chained log of suppliers, written as JSON lines; every seventeenth line was changed afterwards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], integrity.GENESIS
        for seq, (key, name) in enumerate(pdf.sort_values("s_suppkey")[["s_suppkey", "s_name"]].itertuples(index=False), 1):
            e = {"seq": seq, "prev_hash": last, "name": name + " é", "nested": {"b": [1, None], "a": True}}
            last = hashlib.sha256(json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            out.append(json.dumps({**e, "entry_hash": last, **({"name": "changed"} if key % 17 == 3 else {})}, indent=None))
        return pd.DataFrame({"value": out})

    path = f"{shared_folder(spark, 'audit')}/log"
    t(spark, sf_dir, "supplier").withColumn("chain", F.lit("audit")).groupBy("chain").applyInPandas(run, "value string").write.text(path)
    return integrity.verify_chain(reports.audit_log(spark, path))


@query("SELECT o_orderkey AS job_id, o_orderdate AS created, o_orderstatus AS status, o_orderpriority AS kind FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job list's report of the newest 100 with a status and kind."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"))
    return reports.jobs(o, status="F", kind="5-LOW")


@query("SELECT o_orderstatus AS status, count(*) AS orders, max(o_orderkey) AS last FROM orders GROUP BY 1")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of one row a status, written once each as JSON and read again."""
    sums = t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last"))
    folder = shared_folder(spark, "reports")
    for status in "FOP":
        sinks.write_report(sums.where(F.col("status") == status), f"{folder}/{status}.json", replace=False)
    return spark.read.schema("status string, orders long, last long").option("multiLine", True).json(folder)


@query("""SELECT 'case-' || r_regionkey AS "case", k AS key, CASE k WHEN 'size' THEN CASE WHEN r_regionkey % 2 = 0 AND r_regionkey <> 2 THEN 'PASS' ELSE 'FAIL' END WHEN 'frame_count' THEN 'PASS' ELSE CASE WHEN r_regionkey = 2 THEN 'FAIL' ELSE 'PASS' END END AS status
FROM region, (VALUES ('source_sha256'), ('size'), ('frame_count')) v(k) WHERE k = 'source_sha256' OR r_regionkey <> 2""")
def corpus_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ground-truth corpus of a file a region. One has another hash than stated, so nothing else of it is asked; odd ones another size."""
    r = t(spark, sf_dir, "region")
    folder = shared_folder(spark, "corpus")
    files = members(r.select(F.col("r_regionkey").alias("channel"), F.lit(0).alias("offset"), F.encode("r_name", "UTF-8").alias("payload")), folder)
    cases = []
    for path in files:
        key = int(re.findall(r"-channel-(\d+)", path)[-1])
        with open(path, "rb") as f:
            raw = f.read()
        cases.append({"case_id": f"case-{key}", "source": os.path.basename(path), "source_sha256": hashlib.sha256(raw + b"x" * (key == 2)).hexdigest(), "expectations": [{"kind": "size", "expected": len(raw) + key % 2}, {"kind": "frame_count", "expected": 0}]})
    return corpus.run(spark, {"schema_version": 1, "cases": cases}, folder).select("case", "key", "status")


@query("""WITH c AS (SELECT doc_id AS "case", toxic, quality FROM labels)
SELECT "case", CASE WHEN "case" % 11 = 0 THEN 0 ELSE CASE WHEN toxic <> 0 THEN 1 ELSE 0 END + CASE WHEN quality <> 1 THEN 1 ELSE 0 END END AS failed, CASE WHEN "case" % 11 = 0 OR toxic <> 0 OR quality <> 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM c""")
def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as cases that should be of quality and not toxic; every eleventh has another hash."""
    lab = t(spark, sf_dir, "labels")
    rows = lambda values: lab.select(F.col("doc_id").alias("case"), F.explode(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))).alias("key", "value"))
    checked = detect.expectations(rows({"toxic": F.lit("0"), "quality": F.lit("1")}), rows({k: F.col(k).cast("string") for k in ("toxic", "quality")}))
    return detect.case_results(checked, lab.select(F.col("doc_id").alias("case"), (F.col("doc_id") % 11 != 0).alias("hash_ok"))).withColumn("failed", F.col("failed").cast("int"))


@query("""SELECT o_orderkey, o_custkey % 3 <= 1 AND o_custkey % 3 > 0 OR o_custkey % 3 = 0 AND o_orderkey % 2 = 0 AS close, concat_ws(' | ', CASE WHEN o_orderkey % 3 = 0 THEN 'compare the ranked formats before recovery' END, CASE WHEN o_orderkey % 4 = 0 THEN 'no known format: profile samples at other offsets' ELSE 'scan as ' || o_orderpriority END,
CASE WHEN o_orderkey % 5 > 0 THEN 'examine file systems too' END) AS advice FROM orders""")
def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do next, and whether another solution costs at most one more, for every order as a detection."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("best"), (F.col("o_orderkey") % 4 / 4).alias("confidence"), (F.col("o_orderkey") % 3 == 0).alias("review"), (F.col("o_orderkey") % 5).alias("partitions"),
        F.when(F.col("o_custkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, 0.0)).otherwise(F.col("o_custkey") % 3 * 1.0).alias("margin"))
    return o.select("o_orderkey", detect.close_alternative("margin").alias("close"), F.array_join(detect.recommendations("best", "confidence", "review", "partitions"), " | ").alias("advice"))


def _settled(stream: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """What a stream has given once all that is there now is read, as a table in the shared folder."""
    folder = shared_folder(spark, "stream")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", f"{folder}/rows").start()
    else:
        q = w.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, as it may be larger than the executors' heap."""
    rocks = "spark.sql.streaming.stateStore.rocksdb."
    on_disk = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", rocks + "boundedMemoryUsage": "true", rocks + "changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in on_disk}
    try:
        for k, v in on_disk.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(t(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


@query("SELECT CAST(doc_id AS VARCHAR) AS source, CAST((length(text) - length(replace(text, 'tion', ''))) // 4 AS BIGINT) AS hits FROM documents WHERE contains(text, 'tion')")
def stream_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in documents that arrive in chunks of 61 bytes, over whose borders a pattern may go on."""
    d = _arriving(spark, sf_dir, "documents").where("text <> ''").withColumn("b", F.encode("text", "UTF-8"))
    chunks = d.select(F.col("doc_id").cast("string").alias("source"), "b", F.explode(F.sequence(F.lit(0), F.octet_length("b") - 1, F.lit(61))).alias("base"))
    chunks = chunks.select("source", F.col("base").cast("bigint").alias("base"), F.expr("substring(b, base + 1, 61)").alias("data"))
    return _settled(streamed.hits(chunks, b"tion"), "append", spark).groupBy("source").agg(F.count(F.lit(1)).alias("hits"))


@query("""WITH p AS (SELECT unnest(['tion', 'ing ', 'e']) AS id), d AS (SELECT doc_id, id, len(string_split(text, id)) - 1 AS hits FROM documents, p WHERE text <> '') SELECT CAST(doc_id AS VARCHAR) AS source, id, CAST(hits AS BIGINT) AS hits FROM d WHERE hits > 0""")
def stream_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three patterns in documents whose chunks arrive in any order: by a hash of the chunk, a file a micro-batch."""
    d = t(spark, sf_dir, "documents").where("text <> ''").withColumn("b", F.encode("text", "UTF-8"))
    chunks = d.select(F.col("doc_id").cast("string").alias("source"), "b", F.explode(F.sequence(F.lit(0), F.octet_length("b") - 1, F.lit(499))).alias("base"))
    path = f"{shared_folder(spark, 'chunks')}/chunks"
    chunks.select("source", F.col("base").cast("bigint").alias("base"), F.expr("substring(b, base + 1, 499)").alias("data")).repartition(4, F.xxhash64("source", "base")).write.parquet(path)
    arriving = spark.readStream.schema("source string, base long, data binary").option("maxFilesPerTrigger", 1).parquet(path)
    with _state_on_disk(spark):  # up to most of the bytes wait
        found = _settled(reassembly.hits(arriving, [("tion", b"tion"), ("ing ", b"ing "), ("e", b"e")]), "append", spark)
    return found.groupBy("source", "id").agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT o_custkey % 64 AS source, arg_max(o_custkey, o_orderkey) AS finished, arg_max(o_orderkey % 7, o_orderkey) AS bad, arg_max(o_orderkey * 10, o_orderkey) AS total FROM orders GROUP BY 1")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of growing acquisitions as they arrive: the newest of each source."""
    o = _arriving(spark, sf_dir, "orders")
    s = o.select((F.col("o_custkey") % 64).alias("source"), F.col("o_orderkey").alias("taken"), F.col("o_custkey").alias("finished"), (F.col("o_orderkey") % 7).alias("bad"), (F.col("o_orderkey") * 10).alias("total"))
    return _settled(windows.acquisition_progress(s), "complete", spark)
