"""The engine's operators over the driver's tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytesx as B
from ..operators import channels, choices, detect, fragments, frames, integrity, intervals, media, ordered, paths, profiles, scan, storage, timebase
from ..streaming.windows import minute_buckets
from . import planted, recorded  # noqa: F401 - register their queries
from .registry import ORACLES, QUERIES, query, t  # noqa: F401


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of 16 channels; every seventh lacks a time, numbers start anew every 500 events."""
    e = t(spark, sf_dir, "events")
    ts = F.when(F.col("event_id") % 7 != 0, F.timestamp_add("SECOND", -(F.col("event_id") % 11) * 3600, F.col("ts")))
    return e.select((F.col("user_id") % 16).alias("channel"), F.col("event_id").alias("offset"), ts.alias("ts"), (F.col("event_id") % 500).alias("frame_number"), F.floor(F.col("value") * 100).cast("bigint").alias("size"), F.col("event_type").alias("frame_type"))


_FRAMES = """f AS (SELECT user_id % 16 AS channel, event_id AS "offset",
  CASE WHEN event_id % 7 <> 0 THEN ts - to_seconds(CAST((event_id % 11) * 3600 AS DOUBLE)) END AS ts,
  event_id % 500 AS frame_number, CAST(floor(value * 100) AS BIGINT) AS size, event_type AS frame_type FROM events)"""


@query(f"""WITH {_FRAMES}, w AS (SELECT *, last_value(ts IGNORE NULLS) OVER p AS ts0, lag(frame_number) OVER (PARTITION BY channel ORDER BY "offset") AS n0
  FROM f WINDOW p AS (PARTITION BY channel ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT channel, count(*) AS frames, CAST(sum(size) AS BIGINT) AS total_bytes, arg_min(ts, "offset") FILTER (ts IS NOT NULL) AS first_timestamp,
  arg_max(ts, "offset") FILTER (ts IS NOT NULL) AS last_timestamp, count(DISTINCT frame_type) AS frame_types,
  count(*) FILTER (ts < ts0) AS timestamp_backwards, count(*) FILTER (frame_number > n0 + 1) AS sequence_gaps, count(*) FILTER (frame_number < n0) AS sequence_resets FROM w GROUP BY channel)
SELECT *, CASE WHEN timestamp_backwards + sequence_gaps + sequence_resets > 0 THEN 'REVIEW' ELSE 'UNKNOWN' END AS status FROM a""")
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.channel_stats(_frames(spark, sf_dir), block=1000)


@query(f"WITH {_FRAMES} SELECT channel, frame_type, count(*) AS n FROM f GROUP BY ALL")
def channel_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = channels.type_histogram(_frames(spark, sf_dir))
    return h.select("channel", F.explode("frame_types").alias("frame_type", "n"))


@query("""SELECT strftime(min(ts), '%H-%M') AS label, min(ts) AS ts, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS starts
FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY hour(ts), minute(ts)""")
def recording_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = channels.boundaries(t(spark, sf_dir, "events").select(F.col("event_id").alias("start"), "ts"), "2024-01-15")
    return b.withColumn("starts", F.array_join(F.transform("starts", lambda x: x.cast("string")), ","))


@query(f"WITH {_FRAMES} SELECT channel, date_trunc('minute', ts) AS minute, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes, min(ts) AS first, max(ts) AS last FROM f WHERE ts IS NOT NULL GROUP BY ALL")
def minute_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minute_buckets(_frames(spark, sf_dir).where("ts is not null")).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("""SELECT event_id, CAST((year(ts) - 2000) * 67108864 + month(ts) * 4194304 + day(ts) * 131072 + hour(ts) * 4096 + minute(ts) * 64 + second(ts) AS BIGINT) AS packed,
date_trunc('second', ts) AS unpacked, CAST(NULL AS TIMESTAMP) AS impossible FROM events""")
def packed_time_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = t(spark, sf_dir, "events").select("event_id", B.pack_time("ts").alias("packed"))
    # month 13 can't be
    return x.withColumns({"unpacked": B.packed_time("packed"), "impossible": B.packed_time(F.col("packed").bitwiseOR(15 << 22))})


PATTERNS = ["the ", "ing", "tion", "qu", "@", "\n"]


@query("WITH p(id) AS (VALUES ('the '), ('ing'), ('tion'), ('qu'), ('@'), (chr(10))), h AS (SELECT id, doc_id, CAST((length(text) - length(replace(text, id, ''))) / length(id) AS BIGINT) AS n FROM documents, p)"
       " SELECT id, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS sources, max(n) AS most FROM h GROUP BY id")  # fmt: skip
def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select(F.posexplode(F.array(*(B.disjoint("text", p) for p in PATTERNS))).alias("i", "n"))
    ids = F.array(*(F.lit(p) for p in PATTERNS))
    return d.withColumn("n", F.col("n").cast("bigint")).groupBy("i").agg(F.sum("n").alias("hits"), F.count_if(F.col("n") > 0).alias("sources"), F.max("n").alias("most")).select(F.get(ids, F.col("i")).alias("id"), "hits", "sources", "most")


@query("""WITH p(id) AS (VALUES ('tion'), ('ing ')), x AS (SELECT doc_id, id, string_split(text, id) AS parts FROM documents, p WHERE text IS NOT NULL),
u AS (SELECT doc_id, id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM x),
o AS (SELECT id, i, n, doc_id * 1048576 + CAST(sum(octet_length(encode(part)) + length(id)) OVER (PARTITION BY doc_id, id ORDER BY i) AS BIGINT) - length(id) AS o FROM u),
h AS (SELECT id, o, row_number() OVER (PARTITION BY id ORDER BY o) AS k FROM o WHERE i < n)
SELECT id, count(*) AS count, min(o) AS first, max(o) AS last, count(*) > 5 AS truncated, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) FILTER (k <= 5) AS offsets FROM h GROUP BY id""")
def signature_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out in a byte space, 1 MiB apart."""
    chunks = t(spark, sf_dir, "documents").where("text is not null").select(F.lit("documents").alias("source"), (F.col("doc_id") * (1 << 20)).alias("base"), F.octet_length("text").alias("size"), F.encode("text", "UTF-8").alias("data"))
    stats = scan.hit_stats(scan.signature_hits(chunks, [("tion", b"tion"), ("ing ", b"ing ")]), 1 << 30, keep=5)
    return stats.select("id", "count", "first", "last", "truncated", F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("offsets"))


@query("""WITH b AS (SELECT doc_id, text, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents),
c AS (SELECT doc_id, any_value(text) AS text, x, count(*) AS n FROM b GROUP BY doc_id, x), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c)
SELECT doc_id AS key, CAST(any_value(total) AS BIGINT) AS size, round(-sum(n / total * log2(n / total)), 6) + 0.0 AS entropy, round(coalesce(sum(n) FILTER (x = '00'), 0) / any_value(total), 6) AS zero_fraction,
round(coalesce(sum(n) FILTER (x = 'FF'), 0) / any_value(total), 6) AS ff_fraction, sha256(any_value(text)) AS sha256 FROM s GROUP BY doc_id""")
def byte_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scan.byte_profile(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.encode("text", "UTF-8").alias("data")))
    return p.withColumns({c: F.round(c, 6) + 0.0 for c in ("entropy", "zero_fraction", "ff_fraction")})


@query("""WITH d AS (SELECT doc_id, greatest(n_chars * 4096 - 65536, 0) AS most FROM documents), p AS (SELECT doc_id, most, unnest(range(0, 5)) AS i FROM d),
o AS (SELECT doc_id, i, least(most, CAST(floor(round_even(most * i / 4.0, 0) / 512) AS BIGINT) * 512) AS o FROM p), f AS (SELECT doc_id, o, min(i) AS i FROM o GROUP BY doc_id, o)
SELECT doc_id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY i) AS offsets FROM f GROUP BY doc_id""")
def sample_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.transform(scan.sample_offsets(F.col("n_chars") * 4096, 65536, 5), lambda x: x.cast("string")), ",").alias("offsets"))


@query("SELECT doc_id AS key, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.encode("text", "UTF-8").alias("data"), "text")
    return integrity.digests(d, F.md5("data").alias("md5")).drop("sha512")


@query("""SELECT doc_id, sha256(encode('tracewell-edge-1:' || octet_length(b) || ':') || b[1:64] || b[greatest(octet_length(b) - 63, 1):octet_length(b)]) AS edge FROM (SELECT doc_id, encode(text) AS b FROM documents)""")
def edge_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", integrity.edge_digest(F.encode("text", "UTF-8"), 64).alias("edge"))


@query("""WITH e AS (SELECT conv_id AS chain, turn + CASE WHEN conv_id % 13 = 5 AND turn > 1 THEN 2 ELSE 1 END AS seq, sha256(concat_ws('|', conv_id, turn, role, text)) AS entry_hash FROM conversations),
l AS (SELECT *, CASE WHEN chain % 7 = 3 AND seq = 2 THEN 'x' ELSE lag(entry_hash, 1, repeat('0', 64)) OVER (PARTITION BY chain ORDER BY seq) END AS prev_hash FROM e),
v AS (SELECT *, NOT (seq = lag(seq, 1, 0) OVER o + 1 AND prev_hash = lag(entry_hash, 1, repeat('0', 64)) OVER o) AS bad FROM l WINDOW o AS (PARTITION BY chain ORDER BY seq))
SELECT chain, count(*) AS entries, count(*) FILTER (bad) AS bad, min(seq) FILTER (bad) AS first_bad FROM v GROUP BY chain""")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash chain of each conversation, some tampered with."""
    c = t(spark, sf_dir, "conversations")
    h = integrity.entry_hash(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role"), F.col("text"))
    seq = F.col("turn") + F.when((F.col("conv_id") % 13 == 5) & (F.col("turn") > 1), 2).otherwise(1)
    log = c.select(F.col("conv_id").alias("chain"), seq.alias("seq"), h.alias("entry_hash"), h.alias("recomputed"))
    before = F.lag("entry_hash", 1, integrity.GENESIS).over(Window.partitionBy("chain").orderBy("seq"))
    return integrity.verify_chain(log.withColumn("prev_hash", F.when((F.col("chain") % 7 == 3) & (F.col("seq") == 2), "x").otherwise(before)))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise("?")
    return o.select((F.col("o_custkey") % 64).alias("source"), (F.col("o_orderkey") * 10).alias("pos"), (F.col("o_custkey") % 900 + 1).alias("size"), status.alias("status"))


_BLOCKS = "b AS (SELECT o_custkey % 64 AS source, o_orderkey * 10 AS pos, o_custkey % 900 + 1 AS size, CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '?' END AS status FROM orders)"


@query(f"""WITH {_BLOCKS}, e AS (SELECT *, pos + size AS "end" FROM b), r AS (SELECT *, max("end") OVER (PARTITION BY source ORDER BY pos, "end", status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
SELECT source, CAST(coalesce(sum(least(reach, "end") - pos) FILTER (reach > pos), 0) AS BIGINT) AS overlap_bytes, CAST(coalesce(sum(pos - reach) FILTER (pos > reach), 0) AS BIGINT) AS gap_bytes FROM r GROUP BY source""")
def overlap_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps_and_gaps(_blocks(spark, sf_dir).withColumn("end", F.col("pos") + F.col("size")), block=5000)


@query(f"""WITH {_BLOCKS}, x AS (SELECT source, 1000 AS a, 50000 AS z FROM b GROUP BY source),
c AS (SELECT b.source, status, greatest(pos, a) AS pos, least(pos + size, z) AS "end" FROM b JOIN x USING (source) WHERE least(pos + size, z) > greatest(pos, a)),
k AS (SELECT 'covered' AS k, source, pos, "end" FROM c UNION ALL SELECT 'finished', source, pos, "end" FROM c WHERE status = '+'),
m AS (SELECT *, CASE WHEN pos <= max("end") OVER (PARTITION BY k, source ORDER BY pos, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM k),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY k, source ORDER BY pos, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT k, source, max("end") - min(pos) AS n FROM i GROUP BY k, source, island)
SELECT x.source, CAST(coalesce((SELECT sum(n) FROM u WHERE k = 'covered' AND u.source = x.source), 0) AS BIGINT) AS covered,
CAST(coalesce((SELECT sum(n) FROM u WHERE k = 'finished' AND u.source = x.source), 0) AS BIGINT) AS finished,
CAST((SELECT coalesce(sum(size) FILTER (status = '+'), 0) FROM b WHERE b.source = x.source) AS BIGINT) AS finished_bytes,
CAST((SELECT coalesce(sum(size) FILTER (status = '-'), 0) FROM b WHERE b.source = x.source) AS BIGINT) AS bad_bytes FROM x""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    expected = b.select("source").distinct().withColumns({"expected_start": F.lit(1000).cast("bigint"), "expected_size": F.lit(49000).cast("bigint")})
    return intervals.coverage(b, expected, block=5000).select("source", "covered", "finished", "finished_bytes", "bad_bytes")


_DETECTIONS = "d AS (SELECT l_orderkey AS source, 'plugin' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS plugin, max(l_discount * 10) AS confidence FROM lineitem GROUP BY ALL)"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("source"), F.concat(F.lit("plugin"), F.lpad(F.col("l_suppkey").cast("string"), 4, "0")).alias("plugin")).agg(F.max(F.col("l_discount") * 10).alias("confidence"))


@query(f"WITH {_DETECTIONS} SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY confidence DESC, plugin) AS INTEGER) AS rank FROM d")
def rank_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.ranked(_detections(spark, sf_dir))


@query(f"""WITH {_DETECTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, plugin) AS k FROM d),
x AS (SELECT a.source, a.plugin, a.confidence, b.plugin AS runner_up, coalesce(b.confidence, 0) AS second FROM r a LEFT JOIN r b ON a.source = b.source AND b.k = 2 WHERE a.k = 1)
SELECT source, plugin, confidence, runner_up, round(confidence - second, 6) AS margin, confidence < 0.6 OR (second > 0 AND round(confidence - second, 6) < 0.15) AS requires_review FROM x""")
def requires_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.report(_detections(spark, sf_dir)).withColumn("margin", F.round("margin", 6))


@query("""WITH s AS (SELECT o_orderkey AS current, o_custkey % 40 AS k FROM orders), f AS (SELECT o_orderkey AS fragment, o_custkey % 40 AS k, o_orderstatus = 'F' AS terminal FROM orders WHERE o_orderkey % 9 <> 0),
c AS (SELECT current, fragment, terminal, fragment - current AS gap FROM s JOIN f USING (k) WHERE fragment > current AND fragment <= current + 400),
n AS (SELECT * FROM c WHERE gap <= 32), a AS (SELECT *, 'near' AS band FROM n UNION ALL SELECT *, 'far' FROM c WHERE gap > 32 AND current NOT IN (SELECT current FROM n)),
r AS (SELECT current, fragment, band, gap - CASE WHEN terminal THEN 0.25 ELSE 0.0 END AS score FROM a)
SELECT current, fragment, band, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY current ORDER BY score, fragment) AS INTEGER) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY current ORDER BY score, fragment) <= 6""")
def continuation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 40)
    states = o.select(F.col("o_orderkey").alias("current"), "k")
    free = o.select(F.col("o_orderkey").alias("fragment"), "k", (F.col("o_orderstatus") == "F").alias("terminal"))
    used = o.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("fragment"))
    return fragments.candidates(states, free, used, 32, 400, 6, ["k"]).select("current", "fragment", "band", "score", "rank")


@query("""WITH p AS (SELECT (l_orderkey * 1536 + l_linenumber * 512) % 4096 AS residue, l_quantity > 10 AS valid, l_discount > 0.05 AS timestamped, l_tax = 0 AS padding FROM lineitem),
s AS (SELECT residue, count(*) FILTER (valid) AS valid, count(*) FILTER (timestamped) AS timestamped, count(*) FILTER (padding) AS padding FROM p GROUP BY residue),
q AS (SELECT *, valid * 2 + timestamped * 8 + padding * 0.5 AS score FROM s), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, timestamped DESC, valid DESC, residue) AS rank FROM q),
b AS (SELECT max(score) FILTER (rank = 1) AS one, max(score) FILTER (rank = 2) AS two FROM r)
SELECT residue, valid, timestamped, padding, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank, round(one / (one + two) * least(1.0, timestamped / 6.0) * score / one, 5) AS confidence FROM r, b WHERE rank <= 8""")
def alignment_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 1536 + F.col("l_linenumber") * 512).alias("offset"), (F.col("l_quantity") > 10).alias("valid"), (F.col("l_discount") > 0.05).alias("timestamped"), (F.col("l_tax") == 0).alias("padding"))
    return fragments.alignment(p, 4096).withColumn("confidence", F.round("confidence", 5))


@query("""WITH a AS (SELECT user_id, CAST(event_id AS DOUBLE) * 3600 AS x, CAST(event_id AS DOUBLE) * 3600 * 1.0001 + value / 100 AS y FROM events),
p AS (SELECT a.user_id, median((b.y - a.y) / (b.x - a.x)) AS slope FROM a, a b WHERE a.user_id = b.user_id AND a.x < b.x GROUP BY 1), s AS (SELECT a.*, coalesce(slope, 1) AS slope FROM a LEFT JOIN p USING (user_id)),
i AS (SELECT user_id, median(y - slope * x) AS intercept FROM s GROUP BY 1),
m AS (SELECT user_id, any_value(slope) AS slope, any_value(intercept) AS intercept, max(abs(y - intercept - slope * x)) AS r, count(*) AS anchors FROM s JOIN i USING (user_id) GROUP BY 1)
SELECT user_id, round(slope, 8) AS slope, round(intercept, 3) AS intercept, round((slope - 1) * 1e6, 2) AS drift_ppm, round(r, 3) AS max_residual, anchors, CASE WHEN r > 2 OR abs((slope - 1) * 1e6) > 50000 OR anchors < 2 THEN 'REVIEW' ELSE 'PASS' END AS status FROM m""")
def clock_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock of each user, by all events."""
    x = F.col("event_id").cast("double") * 3600
    m = timebase.fit(t(spark, sf_dir, "events").select("user_id", x.alias("x"), (x * 1.0001 + F.col("value") / 100).alias("y")), ["user_id"])
    return m.select("user_id", F.round("slope", 8).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("drift_ppm", 2).alias("drift_ppm"), F.round("max_residual", 3).alias("max_residual"), "anchors", "status")


PACK = {"schema_version": 1, "profiles": [
    {"profile_id": "any-brand1", "family_id": "a", "vendor_patterns": ["brand#1?"]},
    {"profile_id": "red-economy", "family_id": "a", "vendor_patterns": ["BRAND#*"], "model_patterns": ["red *", "* ring"], "firmware_patterns": ["eco*"]},
    {"profile_id": "fallback", "family_id": "b"},
]}


@query("""WITH p AS (SELECT p_partkey AS device, lower(p_brand) AS v, lower(p_name) AS m, lower(p_type) AS f FROM part)
SELECT device, 'any-brand1' AS profile_id, CAST(1.0 AS DOUBLE) AS score FROM p WHERE v LIKE 'brand#1_' UNION ALL SELECT device, 'fallback', 1.0 FROM p
UNION ALL SELECT device, 'red-economy', 1.0 FROM p WHERE v LIKE 'brand#%' AND (m LIKE 'red %' OR m LIKE '% ring') AND f LIKE 'eco%'""")
def profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("device"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("model"), F.col("p_type").alias("firmware"))
    return profiles.match(d, profiles.load(PACK))


@query("SELECT o_orderkey, (o_orderkey * 777) // 4096 % 3 AS member, CAST((o_orderkey * 777) // 12288 * 4096 + (o_orderkey * 777) % 4096 + 1024 AS BIGINT) AS member_offset FROM orders")
def raid0_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    member, at = B.stripe(F.col("o_orderkey") * 777, 3, 4096, 1024)
    return t(spark, sf_dir, "orders").select("o_orderkey", member.alias("member"), at.cast("bigint").alias("member_offset"))


@query("""WITH m AS (SELECT s_suppkey AS member, sum(s_suppkey % 9 + 1) OVER (ORDER BY s_suppkey) - (s_suppkey % 9 + 1) AS a, sum(s_suppkey % 9 + 1) OVER (ORDER BY s_suppkey) AS z FROM supplier)
SELECT p_partkey, member, CAST(p_partkey % 50 - a AS BIGINT) AS member_offset FROM part JOIN m ON p_partkey % 50 >= a AND p_partkey % 50 < z""")
def concat_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members end to end, by a sum over ranges, and the member that each place is in."""
    m = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), (F.col("s_suppkey") % 9 + 1).cast("bigint").alias("size"))
    m = ordered.scanned(m, [], ["member"], ["size"]).withColumnRenamed("before_size", "a")
    p = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("o"))
    return ordered.looked_up(p, "o", m, "a", "size").select("p_partkey", "member", (F.col("o") - F.col("a")).alias("member_offset"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 5 AS packets, o_custkey % 7 * 100 AS size, o_orderkey % 3 = 0 AS r, CASE WHEN o_orderkey % 11 <> 0 THEN 100.0 END AS expected, 98.5 + (o_custkey % 40) / 10.0 AS actual FROM orders),
d AS (SELECT *, CASE WHEN expected IS NULL THEN 'REVIEW' WHEN abs(actual - expected) / expected > 0.02 THEN 'FAIL' WHEN abs(actual - expected) / expected > 0.005 THEN 'REVIEW' ELSE 'PASS' END AS duration FROM o)
SELECT k AS o_orderkey, CASE WHEN packets = 0 OR size = 0 THEN 'FAIL' WHEN r THEN 'REVIEW' ELSE 'UNKNOWN' END AS candidate, duration, CASE WHEN packets = 1 OR duration = 'FAIL' THEN 'FAIL' WHEN duration = 'REVIEW' OR r THEN 'REVIEW' ELSE 'PASS' END AS full_qc,
CASE WHEN packets = 2 OR duration = 'FAIL' THEN 'FAIL' ELSE 'REVIEW' END AS fast_qc, CASE WHEN packets <> 3 AND size >= 300 AND NOT r THEN 'COMPLETE' ELSE 'REVIEW' END AS receipt FROM d""")
def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("packets"), (F.col("o_custkey") % 7 * 100).alias("size"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(F.col("o_orderkey") % 11 != 0, 100.0).alias("expected"), (98.5 + (F.col("o_custkey") % 40) / 10.0).alias("actual"))
    o = o.withColumns({"clean": F.col("packets") != 1, "ambiguous": F.size("reasons") > 0, "windows": F.array(F.lit(True), F.col("packets") != 2), "codes": F.array(F.lit(0), F.when(F.col("packets") == 3, 1).otherwise(0)), "whole": F.lit(True), "wanted": F.lit(300), "hashed": F.size("reasons") == 0})
    return o.select("o_orderkey", detect.candidate_status("packets", "size", "reasons").alias("candidate"), detect.duration_status("actual", "expected").alias("duration"), detect.full_qc_status("clean", "actual", "expected", "ambiguous").alias("full_qc"), detect.fast_qc_status("windows", "actual", "expected").alias("fast_qc"), detect.receipt_status("codes", "whole", "size", "wanted", "hashed").alias("receipt"))


@query("""WITH e AS (SELECT doc_id AS "case", 'toxic' AS key, '0' AS value FROM labels UNION ALL SELECT doc_id, 'lang', 'en' FROM labels UNION ALL SELECT doc_id, 'rare', '1' FROM labels WHERE doc_id % 10 = 0),
a AS (SELECT doc_id AS "case", 'toxic' AS key, CAST(toxic AS VARCHAR) AS actual FROM labels UNION ALL SELECT doc_id, 'lang', lang FROM documents)
SELECT e."case", e.key, e.value, a.actual, CASE WHEN a."case" IS NULL THEN 'missing ' || e.key WHEN e.value IS DISTINCT FROM a.actual THEN 'differs ' || e.key END AS reason,
CASE WHEN a."case" IS NULL OR e.value IS DISTINCT FROM a.actual THEN 'FAIL' ELSE 'PASS' END AS status FROM e LEFT JOIN a USING ("case", key)""")
def expectation_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, docs = t(spark, sf_dir, "labels"), t(spark, sf_dir, "documents")
    row = lambda df, key, value: df.select(F.col("doc_id").alias("case"), F.lit(key).alias("key"), value.alias("value"))
    expected = row(lab, "toxic", F.lit("0")).unionByName(row(lab, "lang", F.lit("en"))).unionByName(row(lab.where("doc_id % 10 = 0"), "rare", F.lit("1")))
    actual = row(lab, "toxic", F.col("toxic").cast("string")).unionByName(row(docs, "lang", F.col("lang")))
    return detect.expectations(expected, actual)


SIZES = ["4096", "0x1000", "1.5 KiB", "2GB", "1.0001 kb", "12 parsecs", "7 MiB", "0.3"]


@query("""WITH s(s, n) AS (VALUES ('4096', 4096), ('0x1000', 4096), ('1.5 KiB', 1536), ('2GB', 2000000000), ('1.0001 kb', NULL), ('12 parsecs', NULL), ('7 MiB', 7340032), ('0.3', NULL))
SELECT r_regionkey, s AS size, CAST(n AS BIGINT) AS bytes, regexp_full_match(lower(r_name), 'a[^f].*') AS globbed, regexp_full_match(r_name, '[A-Za-z0-9][A-Za-z0-9._-]{0,79}') AS is_case_id FROM region, s""")
def small_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t(spark, sf_dir, "region").withColumn("size", F.explode(F.array(*(F.lit(s) for s in SIZES))))
    return r.select("r_regionkey", "size", B.byte_size("size").alias("bytes"), F.lower("r_name").rlike(B.glob_regex("A[!f]*")).alias("globbed"), B.case_id("r_name").alias("is_case_id"))


@query("""SELECT event_id, (length(h) - length(replace(h, '75', ''))) // 2 AS overlapping, hex(encode(props)) AS x, false AS padding FROM (SELECT *, replace(CAST(event_id AS VARCHAR), ' ', '') AS h FROM events)""")
def byte_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("b", F.encode("props", "UTF-8"))
    return e.select("event_id", B.overlapping(F.col("event_id").cast("string"), "75").cast("bigint").alias("overlapping"), F.hex("b").alias("x"), B.padding("b").alias("padding"))


def _encode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a byte space, each an event's frame after some noise."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", B.pack_time("ts").alias("packed"), F.encode("props", "UTF-8").alias("payload"))

    def run(batches):
        for b in batches:
            b["data"] = [b"noiseDHA" + frames.build(0xFD, u % 16, n % 2**32, p, n % 1000, b"\0\0\0\1\x67" + bytes(x), bytes([0x81, 0, 0xC, 15])) for n, u, p, x in zip(b["event_id"], b["user_id"], b["packed"], b["payload"], strict=True)]
            yield b.assign(source="events", base=b["event_id"] * 4096, size=[len(x) for x in b["data"]])[["source", "base", "size", "data"]]

    return e.mapInPandas(run, "source string, base long, size int, data binary")


@query("""SELECT event_id * 4096 + 8 AS "offset", CAST(user_id % 16 AS INTEGER) AS channel, event_id AS frame_number, date_trunc('second', ts) AS ts, CAST(event_id % 1000 AS INTEGER) AS millis, 'hevc' AS codec, 15 AS fps,
CAST(24 + 4 + 5 + octet_length(encode(props)) + 8 AS BIGINT) AS length, true AS valid, '0000000167' || hex(encode(props)) AS payload FROM events""")
def frame_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.carve(_encode_frames(spark, sf_dir))
    return f.select("offset", "channel", "frame_number", "ts", "millis", "codec", "fps", "length", "valid", F.hex("payload").alias("payload"))


@query("SELECT CAST(user_id % 16 AS INTEGER) AS channel, count(*) AS pieces, CAST(sum(octet_length(encode(props)) + 5) AS BIGINT) AS bytes FROM events GROUP BY 1")
def frame_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.demux(frames.carve(_encode_frames(spark, sf_dir)))
    return d.groupBy("channel").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.octet_length("payload")).cast("bigint").alias("bytes"))


@query("""SELECT event_id AS key, CAST(3 AS BIGINT) AS nals, CASE event_id % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'h264' END AS codec, CASE event_id % 3 WHEN 0 THEN CAST(0.98 AS DOUBLE) WHEN 1 THEN 0.94 ELSE 0.55 END AS confidence, CASE event_id % 3 WHEN 1 THEN '.hevc' WHEN 0 THEN '.h264' ELSE '.es' END AS suffix FROM events""")
def annexb_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = {0: "000000016742AA00000168CE00000165B8", 1: "0000000140010C000001420101000001440100", 2: "000001619A0000000161CC0000010688"}
    data = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit(streams[0]))).when(F.col("event_id") % 3 == 1, F.unhex(F.lit(streams[1]))).otherwise(F.unhex(F.lit(streams[2])))
    c = media.classify(t(spark, sf_dir, "events").select(F.col("event_id").alias("key"), data.alias("data")))
    return c.withColumn("suffix", media.suffix("codec", "confidence"))


@query("SELECT event_id AS key, CAST(1 AS INTEGER) AS packs, CAST(event_id % 4 AS INTEGER) AS video_pes FROM events")
def program_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("000001BA44"), F.repeat(F.lit("000001E00010"), (F.col("event_id") % 4).cast("int")), F.lit("000001C00001" + "000001000001E0"))
    return media.program_stream(t(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.unhex(body).alias("data")))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS source, CAST(1 AS INTEGER) AS number, CAST(131 AS BIGINT) AS type, s_suppkey + 63 AS first_lba, CAST(2048 + s_nationkey AS BIGINT) AS sectors, s_suppkey + 63 + 2048 + s_nationkey - 1 AS last_lba, false AS protective, 'ext' AS filesystem FROM supplier")
def mbr_and_filesystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier")
    le4 = lambda c: F.concat(*(F.lpad(F.hex(F.shiftright(c.cast("bigint"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)))
    sector = F.unhex(F.concat(F.lit("00" * 446), F.lit("0000000083000000"), le4(F.col("s_suppkey") + 63), le4(F.col("s_nationkey") + 2048), F.lit("00" * 48), F.lit("55AA")))
    parts = storage.mbr(s.select(F.col("s_suppkey").cast("string").alias("source"), sector.alias("data")))
    volume = F.unhex(F.lit("00" * 1080 + "53EF" + "00" * 64))
    found = storage.filesystems(spark, s.select(F.col("s_suppkey").cast("string").alias("source"), F.lit(0).alias("base"), volume.alias("data")))
    return parts.join(found.select("source", "filesystem"), "source")


@query("SELECT doc_id AS id, text AS cbc, text AS ctr FROM documents")
def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CBC against Spark's own cipher; CTR applied twice, once whole and once in two chunks."""
    key, iv, counter = (F.unhex(F.lit(x)) for x in ("2B7E151628AED2A6ABF7158809CF4F3C", "000102030405060708090A0B0C0D0E0F", "F0F1F2F3F4F5F6F7F8F9FAFBFCFDFEFF"))
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("data"))
    sealed = F.aes_encrypt("data", key, F.lit("CBC"), F.lit("PKCS"), iv)
    d = d.withColumns({"sealed": sealed, "once": integrity.ctr(F.col("data"), key, counter)})
    once, at = F.col("once"), 160
    twice = F.concat(integrity.ctr(F.substring(once, 1, at), key, counter), integrity.ctr(F.substring(once, at + 1, 1 << 30), key, counter, F.lit(at // 16)))
    return d.select("id", F.decode(integrity.decrypt_cbc(F.substring("sealed", 17, 1 << 30), key, iv), "UTF-8").alias("cbc"), F.decode(twice, "UTF-8").alias("ctr"))


@query("""WITH v(name, data) AS (VALUES ('sp800-38a', '874D6191B620E3261BEF6864990DB6CE9806F66B7970FDFF8617187BB9FFFDFF5AE4DF3EDBD5D35E5B4F09020DB03EAB1E031DDA2FBE03D1792170A0F3009CEE'),
('carry', '66E94BD4EF8A2C3B884CFA59CA342B2E'), ('wrap', '3F5B8CC9EA855A0AFA7347D23E8D664E66E94BD4EF8A2C3B884CFA59CA342B2E')) SELECT r_regionkey, name, data FROM region, v""")
def ctr_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published answers: SP 800-38A F.5.1, and AESAVS's blocks of zeros and ones under a zero key, at counters that overflow."""
    plain = "6BC1BEE22E409F96E93D7E117393172AAE2D8A571E03AC9C9EB76FAC45AF8E5130C81C46A35CE411E5FBC1191A0A52EFF69F2445DF4F9B17AD2B417BE66C3710"
    zero = "00" * 16
    vectors = [("sp800-38a", "2B7E151628AED2A6ABF7158809CF4F3C", "F0F1F2F3F4F5F6F7F8F9FAFBFCFDFEFF", plain, 0), ("carry", zero, "FF" * 16, zero, 1), ("wrap", zero, "FF" * 16, zero * 2, 0)]
    each = [F.struct(F.lit(n).alias("name"), F.hex(integrity.ctr(F.unhex(F.lit(d)), F.unhex(F.lit(k)), F.unhex(F.lit(c)), F.lit(b))).alias("data")) for n, k, c, d, b in vectors]
    return t(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*each)).alias("v")).select("r_regionkey", "v.*")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS probes, round(avg(30000.0 / 1001), 6) AS fps, 'h264' AS codec FROM events GROUP BY user_id")
def probe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit('{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":1280,"height":720,"avg_frame_rate":"30000/1001","duration":"N/A"}],"format":{"duration":"12.5"}}')
    p = media.probes(t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), text.alias("json")))
    return p.groupBy(F.col("key").alias("user_id")).agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg("fps"), 6).alias("fps"), F.max("codec").alias("codec"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Small problems from parts: 12 nodes each, edges 1 to 3 ahead."""
    p = t(spark, sf_dir, "part").select((F.col("p_partkey") - F.col("p_partkey") % 12).alias("problem"), F.col("p_partkey").alias("node"), (F.col("p_partkey") % 12).cast("int").alias("index"), F.col("p_size").alias("w"))
    nodes = p.select("problem", "node", "index", (F.col("index") < 2).alias("is_start"))
    e = p.select("problem", F.col("node").alias("src"), "w", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("d")).select("problem", "src", (F.col("src") + F.col("d")).alias("dst"), (F.col("w") * F.col("d") % 23).cast("double").alias("score"))
    # an edge stays within its problem and leads into no start
    return nodes, e.where("dst - problem >= 2 and dst - problem < 12").join(p.agg(F.max("node").alias("last")), F.col("dst") <= F.col("last"), "left_semi")


#: All beams of 24, level by level, and the 64 best finished paths of each start; a path can't meet itself, as edges lead ahead.
_BEAMS = """WITH RECURSIVE p AS (SELECT p_partkey - p_partkey % 12 AS problem, p_partkey AS node, p_partkey % 12 AS i, p_size AS w FROM part),
e AS (SELECT problem, node AS src, node + d AS dst, CAST(w * d % 23 AS DOUBLE) AS score FROM p, (VALUES (1), (2), (3)) v(d) WHERE i + d >= 2 AND i + d < 12 AND node + d <= (SELECT max(node) FROM p)),
open AS (SELECT problem, node AS start, [node] AS path, CAST(0 AS DOUBLE) AS cost FROM p WHERE i < 2
UNION ALL (SELECT problem, start, path, cost FROM (SELECT o.problem, start, list_append(path, dst) AS path, cost + score AS cost FROM open o JOIN e ON src = path[-1]) QUALIFY row_number() OVER (PARTITION BY start, len(path) ORDER BY cost, path) <= 24)),
h AS (SELECT * FROM open WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = path[-1]) QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(path) DESC, cost, path) <= 64)"""


@query(f"{_BEAMS} SELECT problem, start, array_to_string(path, ',') AS fragments, cost, 'no continuation' AS reason FROM h")
def path_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beams(spark, sf_dir).withColumn("fragments", F.array_join(F.col("fragments").cast("array<string>"), ","))


def _beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return paths.hypotheses(nodes.where("is_start").select("problem", F.col("node").alias("start")), edges)


@query(f"""{_BEAMS}, f AS (SELECT problem, start, [x FOR x IN path IF x % 2 = start % 2] AS path, cost FROM h),
c AS (SELECT a.problem, a.start AS s1, a.path AS p1, a.cost AS c1, b.start AS s2, b.path AS p2, b.cost AS c2 FROM f a LEFT JOIN f b ON a.problem = b.problem AND b.start > a.start WHERE a.start = (SELECT min(start) FROM f x WHERE x.problem = a.problem)),
k AS (SELECT *, len(p1) + coalesce(len(p2), 0) AS n, c1 + coalesce(c2, 0) AS total FROM c WHERE p2 IS NULL OR NOT list_has_any(p1, p2)),
r AS (SELECT *, row_number() OVER w AS rank, lead(n) OVER w AS n2, lead(total) OVER w AS total2 FROM k WINDOW w AS (PARTITION BY problem ORDER BY n DESC, total, p1, p2)),
b AS (SELECT *, CASE WHEN n2 = n THEN total2 - total END AS margin FROM r WHERE rank = 1)
SELECT problem, s1 AS start, array_to_string(p1, ',') AS fragments, c1 AS cost, margin, false AS cut FROM b UNION ALL SELECT problem, s2, array_to_string(p2, ','), c2, margin, false FROM b WHERE s2 IS NOT NULL""")
def disjoint_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    # beams hold whole paths; every second fragment is a start's own, so choices exist
    found = _beams(spark, sf_dir).withColumn("fragments", F.filter("fragments", lambda x: (x % 2 == F.col("start") % 2) | (x == F.col("start"))))
    chosen = choices.select_disjoint(found).select("problem", "start", "fragments", "cost", "margin", "cut")
    return chosen.withColumn("fragments", F.array_join(F.col("fragments").cast("array<string>"), ","))


@query()
def flow_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return paths.solve_flows(nodes, edges, 20.0)


@query()
def local_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return paths.local_chains(nodes.where("is_start").select("problem", F.col("node").alias("start")), edges)


@query("""WITH n AS (SELECT p_partkey // 12 AS problem, p_partkey % 11 AS node, p_size % 9 AS index FROM part), e AS (SELECT p_partkey // 12 AS problem, p_partkey % 13 AS src, p_size % 13 AS dst FROM part)
SELECT problem, CAST(node AS VARCHAR) AS item, 'node twice' AS fault FROM n GROUP BY ALL HAVING count(*) > 1 UNION SELECT problem, CAST(index AS VARCHAR), 'index twice' FROM n GROUP BY ALL HAVING count(*) > 1
UNION SELECT problem, src || '-' || dst, 'edge to itself' FROM e WHERE src = dst UNION SELECT problem, src || '-' || dst, 'unknown node' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.problem = e.problem AND n.node = e.src) OR NOT EXISTS (SELECT 1 FROM n WHERE n.problem = e.problem AND n.node = e.dst)""")
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").withColumn("problem", F.floor(F.col("p_partkey") / 12))
    nodes = p.select("problem", (F.col("p_partkey") % 11).alias("node"), (F.col("p_size") % 9).alias("index"))
    return paths.graph_violations(nodes, p.select("problem", (F.col("p_partkey") % 13).alias("src"), (F.col("p_size") % 13).alias("dst")))


@query("""SELECT CAST(s_suppkey * 4096 + 512 AS BIGINT) AS "offset", CAST(CAST(s_nationkey + 1 AS BIGINT) * 1073741824 AS DECIMAL(20, 0)) AS capacity, CAST(1073741824 AS DECIMAL(20, 0)) AS block_size,
CAST(CASE WHEN s_nationkey >= 1 THEN 0.95 ELSE 0.87 END AS DOUBLE) AS plausibility FROM supplier ORDER BY s_suppkey LIMIT 8""")
def master_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master sector in each supplier's 4 KiB; the first eight are looked at."""
    fields = {"capacity": (F.col("s_nationkey") + 1).cast("bigint") * (1 << 30), "logs_offset": F.lit(4096), "logs_size": F.lit(1 << 20), "video_offset": F.lit(1 << 29), "block_size": F.lit(1 << 30), "blocks": F.col("s_suppkey") + 1, "tree1_offset": F.lit(8192), "tree1_size": F.lit(4096), "tree2_offset": F.lit(16384), "tree2_size": F.lit(4096)}
    le8 = lambda c: F.concat(*(F.lpad(F.hex(F.shiftright(c.cast("bigint"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(8)))
    from ..operators import master as M

    h, at = [F.lit("00" * M.SIGNATURE_AT + M.SIGNATURE.hex())], M.SIGNATURE_AT + len(M.SIGNATURE)
    for name, where in sorted(M.FIELDS.items(), key=lambda x: x[1]):
        h += [F.lit("00" * (where - at)), le8(fields[name])]
        at = where + 8
    sector = F.unhex(F.concat(F.lit("00" * 512), *h, F.lit("00" * (4096 - 512 - at))))
    chunks = t(spark, sf_dir, "supplier").select(F.lit("s").alias("source"), (F.col("s_suppkey") * 4096).alias("base"), F.lit(4096).alias("size"), sector.alias("data"))
    return M.candidates(chunks).select("offset", "capacity", "block_size", "plausibility")


@query("SELECT 'events' AS source, 'dhav' AS plugin, CAST(0.98 AS DOUBLE) AS confidence")
def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import formats

    return formats.default().report(_encode_frames(spark, sf_dir)).select("source", "plugin", "confidence")


@query("""SELECT c_custkey, sha256(c_name) AS key_print, lower(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS guid,
strpos(c_name, '/') = 0 AND strpos(c_name, chr(92)) = 0 AS path_safe, rtrim(c_label, ' ') AS label, c_acctbal > 0 AS same FROM (SELECT *, md5(c_name) AS h, c_name || repeat(' ', CAST(c_custkey % 4 AS INTEGER)) AS c_label FROM customer)""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key fingerprints, GUIDs, safe names, FAT labels and fingerprints of sources, of every customer."""
    c = t(spark, sf_dir, "customer")
    print_ = lambda other: F.struct(F.col("c_custkey").alias("size"), F.lit(1).alias("mtime"), F.lit(None).cast("int").alias("device"), F.lit(2).alias("inode"), F.when(other, "x").otherwise(F.col("c_name")).alias("edge"))
    c = c.withColumns({"a": print_(F.lit(False)), "b": print_(F.col("c_acctbal") <= 0), "label": F.concat("c_name", F.repeat(F.lit(" "), (F.col("c_custkey") % 4).cast("int")))})
    return c.select("c_custkey", integrity.key_fingerprint(F.encode("c_name", "UTF-8")).alias("key_print"), B.guid(F.unhex(F.md5("c_name"))).alias("guid"), B.path_safe("c_name").alias("path_safe"), B.fat_label("label").alias("label"), integrity.same_source("a", "b").alias("same"))


@query("""SELECT event_id, '{"a":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS canonical, CAST(TIMESTAMP '2000-01-01' + to_microseconds(CAST(5000000 + event_id * 1000100 AS BIGINT)) AS TIMESTAMP) AS corrected FROM events""")
def canonical_and_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of every event with one more key, and its recorder time corrected by a clock model."""
    e = t(spark, sf_dir, "events").withColumns({"j": F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a":'), F.col("event_id").cast("string"), F.lit("}")), "s": F.col("event_id").cast("double")})
    return e.select("event_id", integrity.canonical_json(F.col("j")).alias("canonical"), timebase.corrected("s", 1.0001, 5.0).cast("timestamp_ntz").alias("corrected"))


@query("SELECT o_custkey AS source, max(o_orderkey) - min(o_orderkey) + 1 = count(*) AND bool_and(o_orderstatus = 'F') AS complete FROM orders GROUP BY 1")
def interval_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all that is expected of a customer, the keys from the first order to the last, is there and finished."""
    b = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("pos"), F.lit(1).cast("bigint").alias("size"), F.when(F.col("o_orderstatus") == "F", "+").otherwise("-").alias("status"))
    expected = b.groupBy("source").agg(F.min("pos").alias("expected_start"), (F.max("pos") + 1 - F.min("pos")).alias("expected_size"))
    return intervals.coverage(b, expected).select("source", "complete")


def _mixed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's frame with extensions that vary: declared codec or none, rate, size, an unknown type or a cut record; every ninth has a wrong footer."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", F.encode("props", "UTF-8").alias("payload"))

    def run(batches):
        for b in batches:
            data = []
            for n, u, x in zip(b["event_id"], b["user_id"], b["payload"], strict=True):
                ext = bytes([0x80, 0, n % 3, 9]) + (bytes([0x81, 0, 0xC if n % 2 else 4, n % 4]) if n % 5 else b"") + (b"\x82\0" if n % 7 == 0 else b"\x01" if n % 7 == 1 else b"")
                f = bytearray(frames.build(0xFD, u % 16, n % 2**32, 1 << 26, 0, b"\0\0\0\1\x67" + bytes(x) if n % 6 else b"", ext))
                f[-1] ^= n % 9 == 0
                data.append(bytes(f))
            yield b.assign(source="events", base=b["event_id"] * 4096, size=[len(x) for x in data], data=data)[["source", "base", "size", "data"]]

    return e.mapInPandas(run, "source string, base long, size int, data binary")


@query("""WITH f AS (SELECT user_id % 16 AS channel, event_id AS n, event_id * 4096 AS o, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 2 = 1 THEN 'hevc' ELSE 'h264' END AS d, CASE WHEN n % 6 > 0 THEN 'h264' END AS h,
CASE WHEN n % 6 > 0 THEN 5 + octet_length(encode(props)) ELSE 0 END AS p, 4 + CASE WHEN n % 5 > 0 THEN 4 ELSE 0 END + CASE n % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS x FROM events)
SELECT CAST(channel AS INTEGER) AS channel, count(*) FILTER (n % 9 > 0) AS valid_frames, count(*) FILTER (p > 0) AS video_frames, CAST(sum(32 + x + p) AS BIGINT) AS native_bytes, CAST(sum(p) AS BIGINT) AS elementary_bytes, count(*) FILTER (d <> h) AS codec_conflicts,
count(*) FILTER (n % 7 = 0) AS extension_truncated, string_agg(DISTINCT coalesce(d, h), ',' ORDER BY coalesce(d, h)) AS codecs, string_agg(DISTINCT d, ',' ORDER BY d) AS declared_codecs,
string_agg(DISTINCT CASE WHEN n % 3 > 0 THEN n % 3 * 8 || 'x72' END, ',' ORDER BY CASE WHEN n % 3 > 0 THEN n % 3 * 8 || 'x72' END) AS resolutions, string_agg(DISTINCT CASE WHEN n % 5 > 0 AND n % 4 > 0 THEN CAST(n % 4 AS VARCHAR) END, ',' ORDER BY CASE WHEN n % 5 > 0 AND n % 4 > 0 THEN CAST(n % 4 AS VARCHAR) END) AS frame_rates,
string_agg(DISTINCT CASE WHEN n % 7 = 1 THEN '1' END, ',') AS unknown_extension_types, min(o) AS first_offset, max(o) AS last_offset FROM f GROUP BY channel""")
def channel_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other measures of channels, over every event as a frame, with and without a valid footer."""
    m = channels.media_stats(frames.carve(_mixed_frames(spark, sf_dir), strict=False))
    sets = ("codecs", "declared_codecs", "resolutions", "frame_rates", "unknown_extension_types")
    return m.withColumns({c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ",")) for c in sets})


@query("""WITH k(i, name, confidence) AS (VALUES (0, 'xfs', 0.99), (1, 'ntfs', 0.99), (2, 'exfat', 0.99), (3, 'fat12', 0.95), (4, 'fat16', 0.95), (5, 'fat32', 0.95), (6, 'ext', 0.98), (7, 'jfs', 0.99), (8, 'btrfs', 0.99), (9, 'hfsplus', 0.95), (10, 'hfsplus', 0.95))
SELECT CAST(c_custkey AS VARCHAR) AS source, name AS filesystem, CAST(confidence AS DOUBLE) AS confidence FROM customer JOIN k ON c_custkey % 12 = i""")
def filesystem_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume of each customer with one of the magics, or none."""
    c = t(spark, sf_dir, "customer").withColumn("m", F.try_element_at(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(m).alias("magic")) for _, at, m, _ in storage.MAGICS)), (F.col("c_custkey") % 12 + 1).cast("int")))
    data = F.unhex(F.when(F.col("m").isNull(), "00").otherwise(F.concat(F.expr("repeat('00', m.at)"), F.col("m.magic"), F.lit("202020"))))
    return storage.filesystems(spark, c.select(F.col("c_custkey").cast("string").alias("source"), F.lit(0).alias("base"), data.alias("data"))).select("source", "filesystem", "confidence")
