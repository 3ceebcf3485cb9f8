"""Operators on small inputs with known or brute-force results."""

import datetime as dt
import hashlib
import itertools
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.operators import carry, channels, choices, detect, fragments, frames, integrity, intervals, media, paths, profiles, rebuild, scan, storage, timebase
from tracewell.plans import queries
from tracewell.sources import evidence, reports


def test_channel_anomalies_do_not_depend_on_blocks(spark):
    r = random.Random(1)
    rows = [(r.randrange(3), o, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(50)) if r.random() < 0.7 else None, r.randrange(5) if r.random() < 0.9 else None, 10, "I") for o in range(300)]
    df = spark.createDataFrame(rows, "channel int, offset long, ts timestamp_ntz, frame_number long, size long, frame_type string")
    want = {}
    for c in range(3):
        back = gap = reset = 0
        ts = n = None
        for _, _, t, k, *_ in (x for x in rows if x[0] == c):
            back += t is not None and ts is not None and t < ts
            gap += k is not None and n is not None and k > n + 1
            reset += k is not None and n is not None and k < n
            ts, n = t or ts, n if k is None else k
        want[c] = (back, gap, reset)
    for block in (1, 17, 10**6):
        got = {x["channel"]: (x["timestamp_backwards"], x["sequence_gaps"], x["sequence_resets"]) for x in channels.channel_stats(df, block).collect()}
        assert got == want


def test_documents_of_any_length_and_alphabet(spark, tmp_path):
    texts = ["", "a", "x" * 16, "é", "long ü€ text " * 3000, "plain " * 400, "ß" * 63, "日本" * 40, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: (r["cbc"], r["ctr"]) for r in queries.aes_roundtrip(spark, str(tmp_path)).collect()}
    assert got == {i: (x, x) for i, x in enumerate(texts)}
    edges = dict(queries.edge_digest(spark, str(tmp_path)).collect())
    b = {i: x.encode() for i, x in enumerate(texts) if x is not None}
    want = {i: hashlib.sha256(b"tracewell-edge-1:%d:" % len(x) + x[:64] + x[max(len(x) - 64, 0) :]).hexdigest() for i, x in b.items()}
    assert edges == {**want, 8: None}


def test_every_order_has_continuations(spark, tmp_path):
    r = random.Random(3)
    orders = [(k, r.randrange(1, 60), r.choice("FOP")) for k in range(1, 1200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    want = set()
    for current, c, _ in orders:
        found = [(f - current, f, s) for f, d, s in orders if d % 40 == c % 40 and f % 9 and 0 < f - current <= 400]
        near = [x for x in found if x[0] <= 32]
        ranked = sorted((gap - 0.25 * (s == "F"), f) for gap, f, s in near or found)[:6]
        want |= {(current, f, "near" if near else "far", score, i + 1) for i, (score, f) in enumerate(ranked)}
    assert {tuple(x) for x in queries.continuation_candidates(spark, str(tmp_path)).collect()} == want


def test_path_query_keeps_the_whole_beam(spark, tmp_path):
    spark.createDataFrame([(i, i * 7 % 50 + 1) for i in range(24)], "p_partkey long, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    nodes, edges = queries._graph(spark, str(tmp_path))
    rows = edges.collect()
    want = set()
    for problem in (0, 12):
        out = {}
        for e in rows:
            if e["problem"] == problem:
                out.setdefault(e["src"], []).append((e["score"], e["dst"]))
        for start in (problem, problem + 1):
            want |= {(problem, start, ",".join(map(str, p))) for p, _, _ in paths.beam(start, out, width=24, most=64)}
    found = queries.path_beam(spark, str(tmp_path)).collect()
    assert {(r["problem"], r["start"], r["fragments"]) for r in found} == want and len(want) > 4 * 8


def test_boundaries(spark):
    day = dt.datetime(2026, 8, 9)
    rows = [(0, day.replace(hour=9)), (1, day.replace(hour=9, second=5)), (3, day.replace(hour=10)), (4, dt.datetime(2026, 8, 10, 9))]
    got = channels.boundaries(spark.createDataFrame(rows, "start long, ts timestamp_ntz"), "2026-08-09").orderBy("label").collect()
    assert [(r["label"], r["starts"]) for r in got] == [("09-00", [0, 1]), ("10-00", [3])]


def test_intervals_against_bytes(spark):
    r = random.Random(2)
    blocks = [(s, r.randrange(60), r.randrange(1, 12), r.choice("?*/-+")) for s in range(5) for _ in range(r.randrange(1, 9))]
    df = spark.createDataFrame(blocks, "source int, pos long, size long, status string")
    expected = spark.createDataFrame([(s, 5, 50) for s in range(5)] + [(9, 0, 4)], "source int, expected_start long, expected_size long")
    for block in (1, 7, 1 << 20):
        check_coverage({x["source"]: x for x in intervals.coverage(df, expected, block).collect()}, blocks)


def check_coverage(got, blocks):
    for s in range(5):
        mine = [(p, p + n, t) for x, p, n, t in blocks if x == s]
        byte = lambda f: len({i for a, b, t in mine if f(t) for i in range(a, b) if 5 <= i < 55})
        assert (got[s]["covered"], got[s]["finished"]) == (byte(lambda t: True), byte(lambda t: t == "+"))
        assert got[s]["finished_bytes"] == sum(b - a for a, b, t in mine if t == "+")
    assert got[9]["covered"] == 0 and got[9]["complete"] is False


def test_overlap_counts_against_the_running_end(spark):
    df = spark.createDataFrame([(1, 0, 10, "+"), (1, 5, 12, "+"), (1, 7, 9, "+"), (1, 15, 16, "+")], 'source int, pos long, `end` long, status string')
    assert intervals.overlaps_and_gaps(df).first()[1:] == (7, 3)


def test_detection_review(spark):
    rows = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.9), ("b", "y", 0.1), ("c", "x", 0.5), ("d", "y", 0.7), ("d", "x", 0.7)]
    got = {r["source"]: r for r in detect.report(spark.createDataFrame(rows, "source string, plugin string, confidence double")).collect()}
    assert [got[s]["requires_review"] for s in "abcd"] == [True, False, True, True]
    assert got["d"]["plugin"] == "x" and got["d"]["runner_up"] == "y"


def test_signature_hits_do_not_depend_on_chunks(spark, tmp_path):
    r = random.Random(3)
    data = bytes(r.choice(b"ab\0") for _ in range(5000))
    path = tmp_path / "x.bin"
    path.write_bytes(data)
    signatures = [("aa", b"aa"), ("long", b"ab\0ab"), ("nul", b"\0\0")]
    want = sorted((i, o) for i, p in signatures for o in range(5000) if data.startswith(p, o))
    for chunk in (7, 512, 10_000):
        hits = scan.signature_hits(evidence.read(spark, [str(path)], chunk=chunk, overlap=4), signatures)
        assert sorted((x["id"], x["offset"]) for x in hits.collect()) == want
    s = {x["id"]: x for x in scan.hit_stats(hits, 5000, keep=3).collect()}
    of = [o for i, o in want if i == "aa"]
    assert (s["aa"]["count"], s["aa"]["offsets"], s["aa"]["truncated"], s["aa"]["last"]) == (len(of), of[:3], True, of[-1])
    with pytest.raises(ValueError):
        scan.as_signatures([("a", b"x"), ("a", b"y")])


def test_byte_spaces(spark, tmp_path):
    a, b = bytes(range(256)) * 6, bytes(reversed(range(256))) * 4
    for n, x in (("a", a), ("b", b)):
        (tmp_path / n).write_bytes(x)
    both = [str(tmp_path / n) for n in "ab"]
    joined = lambda df: b"".join(bytes(r["data"]) for r in df.orderBy("base").collect())
    assert joined(evidence.read(spark, both, layout="concat", chunk=700)) == a + b
    striped = joined(evidence.read(spark, both, layout="raid0", stripe=512, chunk=300))
    assert striped == a[:512] + b[:512] + a[512:1024] + b[512:1024]
    with evidence.Space(both, "concat") as space:
        assert space.read(len(a) - 3, 6) == (a + b)[len(a) - 3 : len(a) + 3] and space.read(10**6, 5) == b""
        assert list(space.plan(len(a) - 3, 6)) == [(0, len(a) - 3, 3), (1, 0, 3)]
        with pytest.raises(ValueError):
            space.read(-1, 3)
    with evidence.Space(both, "raid0", 512) as space:
        assert list(space.plan(500, 600)) == [(0, 500, 12), (1, 0, 512), (0, 512, 76)] and space.size == 2048
    (tmp_path / "short").write_bytes(b"x" * 511)
    (tmp_path / "empty").write_bytes(b"")
    for paths, layout in (([both[0], str(tmp_path / "short")], "raid0"), ([both[0], str(tmp_path / "empty")], "concat"), (both, "file")):
        with pytest.raises(ValueError):
            evidence.Space(paths, layout, 512)
    with pytest.raises(FileNotFoundError):
        evidence.Space([both[0], str(tmp_path / "none")], "concat")


def test_frames_over_borders(spark, tmp_path):
    """However chunks are cut, frames longer than chunk and overlap are read again at their offset."""
    data = b"noise" + b"".join(frames.build(0xFD, i % 3, i, 1 << 26, 0, bytes([i]) * n) for i, n in enumerate((10, 70_000, 3, 200_000, 0)))
    path = str(tmp_path / "f")
    (tmp_path / "f").write_bytes(data)
    for chunk in (999, 65_536, 1 << 20):
        got = frames.carve(evidence.read(spark, [path], chunk=chunk, overlap=3), space=([path],)).orderBy("offset").collect()
        assert [(r["frame_number"], len(r["payload"])) for r in got] == [(0, 10), (1, 70_000), (2, 3), (3, 200_000), (4, 0)]
    few = frames.carve(evidence.read(spark, [path], chunk=999, overlap=3), space=([path],), most=2)
    assert sorted(r["frame_number"] for r in few.collect()) == [0, 1]


def test_filesystems_in_partitions(spark, tmp_path):
    data = bytearray(300 * 512 + 70_000)
    data[63 * 512 + 1080 : 63 * 512 + 1082] = b"\x53\xef"
    data[300 * 512 + 65600 : 300 * 512 + 65608] = b"_BHRfS_M"
    data[3:11] = b"NTFS    "
    (tmp_path / "d").write_bytes(data)
    parts = spark.createDataFrame([(1, 63), (2, 300), (3, 10**6)], "number int, first_lba long")
    got = {tuple(r) for r in storage.filesystems_in(spark, ([str(tmp_path / "d")],), parts).collect()}
    assert got == {(None, 0, "ntfs", 0.99), (1, 63 * 512, "ext", 0.98), (2, 300 * 512, "btrfs", 0.99)}


def test_streams_by_source(spark, tmp_path):
    from tracewell.sources import sinks

    rows = [(s, c, "h264", o, f"{s}{c}{o};".encode()) for s in ("/x/a", "/y/a") for c in (1, 2) for o in range(50)]
    pieces = spark.createDataFrame(rows, "source string, channel int, codec string, offset long, payload binary").repartition(7)
    sizes = sinks.write_streams(pieces, str(tmp_path / "out"))
    texts = sorted((tmp_path / "out" / n).read_bytes() for n in sizes)
    assert texts == sorted(b"".join(p for s, c, _, _, p in rows if (s, c) == k) for k in (("/x/a", 1), ("/x/a", 2), ("/y/a", 1), ("/y/a", 2)))
    assert len(list((tmp_path / "out").iterdir())) == 4 and all(sizes[n] == (tmp_path / "out" / n).stat().st_size for n in sizes)


def test_digests_of_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc" * 1000)
    r = integrity.file_digests(spark, [str(tmp_path / "f")], 7).first()
    assert (r["size"], r["sha512"]) == (3000, hashlib.sha512(b"abc" * 1000).hexdigest())


def test_sample_offsets(spark):
    for size, sample, count in ((10**6, 4096, 5), (100, 4096, 5), (5000, 4096, 33), (10**9 + 7, 512, 1)):
        most = max(0, size - sample)
        want = list(dict.fromkeys(min(most, round(most * i / (count - 1)) // 512 * 512) for i in range(count))) if count > 1 else [0]
        got = spark.createDataFrame([(size,)], "n long").select(scan.sample_offsets(F.col("n"), sample, count)).first()[0]
        assert got == want


def gpt_image(flip=False):
    import uuid

    entry = uuid.uuid4().bytes_le + uuid.uuid4().bytes_le + struct.pack("<QQQ", 2048, 4095, 0) + "data".encode("utf-16-le").ljust(72, b"\0")
    table = entry + bytes(128 * 127)
    head = b"EFI PART" + struct.pack("<IIII", 0x10000, 92, 0, 0) + struct.pack("<QQQQ", 1, 8191, 34, 8000) + uuid.uuid4().bytes_le + struct.pack("<QIII", 2, 128, 128, zlib.crc32(table))
    head = head[:16] + struct.pack("<I", zlib.crc32(head)) + head[20:]
    if flip:
        head = head[:40] + bytes([head[40] ^ 1]) + head[41:]
    return bytes(512) + head.ljust(512, b"\0") + table


def test_partition_tables(spark):
    rows = [("good", bytearray(gpt_image())), ("bad", bytearray(gpt_image(True))), ("short", bytearray(b"x"))]
    got = storage.gpt(spark.createDataFrame(rows, "source string, data binary")).collect()
    assert [(r["source"], r["first_lba"], r["last_lba"], r["name"]) for r in got] == [("good", 2048, 4095, "data")]
    sector = bytearray(512)
    sector[446:462] = bytes([0, 0, 0, 0, 0x83, 0, 0, 0]) + struct.pack("<II", 2048, 4096)
    sector[462:478] = bytes([0, 0, 0, 0, 0xEE, 0, 0, 0]) + struct.pack("<II", 1, 99)
    sector[510:] = b"\x55\xaa"
    got = storage.mbr(spark.createDataFrame([("m", sector), ("none", bytearray(512))], "source string, data binary")).orderBy("number").collect()
    assert [(r["number"], r["type"], r["first_lba"], r["last_lba"], r["protective"]) for r in got] == [(1, 0x83, 2048, 6143, False), (2, 0xEE, 1, 99, True)]
    volume = bytearray(4096)
    volume[1080:1082] = b"\x53\xef"
    assert [r["filesystem"] for r in storage.filesystems(spark, spark.createDataFrame([("v", 0, volume)], "source string, base long, data binary")).collect()] == ["ext"]


def test_frames(spark, tmp_path):
    stamp = (26 << 26) | (8 << 22) | (9 << 17) | (13 << 12) | (27 << 6) | 45
    made = [frames.build(0xFD, i % 2, i, stamp, i, b"\0\0\0\1\x67abc" if i % 2 else b"zz", bytes([0x81, 0, 0xC, 15]) if i == 2 else b"") for i in range(6)]
    broken = bytearray(frames.build(0xFC, 1, 9, stamp, 0, b"pay"))
    broken[-1] ^= 255
    nested = frames.build(0xFD, 3, 7, stamp, 0, b"<" + made[0] + b">")
    data = b"n" * 123 + b"noise".join(made) + bytes(broken) + nested
    (tmp_path / "f").write_bytes(data)
    for chunk in (64, 10_000):
        chunks = evidence.read(spark, [str(tmp_path / "f")], chunk=chunk, overlap=300)
        got = frames.carve(chunks).orderBy("offset").collect()
        assert [r["frame_number"] for r in got] == [0, 1, 2, 3, 4, 5, 7, 0]
        assert frames.carve(chunks, strict=False).count() == 9
    assert got[0]["offset"] == 123 and got[0]["ts"] == dt.datetime(2026, 8, 9, 13, 27, 45)
    assert (got[1]["codec"], got[2]["codec"], got[2]["fps"], got[0]["codec"]) == ("h264", "hevc", 15, None)
    assert {(r["channel"], r["codec"]) for r in frames.demux(frames.carve(chunks)).collect()} == {(1, "h264"), (0, "hevc")}
    assert frames.carve(chunks, stop=got[1]["offset"] + got[1]["length"] - 1).count() == 1


def test_streams_and_probes(spark):
    rows = [(1, "0000000140010C000001420101000001440100000001260100"), (2, "000000016742AA00000168CE00000165B8"), (3, ""), (4, "00000106FF")]
    df = spark.createDataFrame([(k, bytearray(bytes.fromhex(h))) for k, h in rows], "key long, data binary")
    got = {r["key"]: (r["nals"], r["codec"], r["confidence"]) for r in media.classify(df).collect()}
    assert got == {1: (4, "hevc", 0.99), 2: (3, "h264", 0.98), 3: (0, "unknown", 0.0), 4: (1, "unknown", 0.30)}


def test_clock_models(spark):
    hours = [0, 1, 4, 8]
    m = timebase.fit(spark.createDataFrame([(h * 3600.0, h * 3600.0 * 1.0001 + 5) for h in hours], "x double, y double")).first()
    assert m["drift_ppm"] == pytest.approx(100, abs=1e-3) and m["intercept"] == pytest.approx(5) and m["status"] == "PASS"
    m = timebase.fit(spark.createDataFrame([(10.0, 12.0)], "x double, y double")).first()
    assert (m["slope"], m["intercept"], m["status"]) == (1.0, 2.0, "REVIEW")


def test_continuations(spark):
    states = spark.createDataFrame([(10,), (100,)], "current long")
    free = spark.createDataFrame([(f, f % 5 == 0) for f in [11, 12, 15, 42, 43, 150, 160]], "fragment long, terminal boolean")
    used = spark.createDataFrame([(11,)], "fragment long")
    got = fragments.candidates(states, free, used, near=32, far=4096, top=2).orderBy("current", "rank").collect()
    assert [(r["current"], r["fragment"], r["band"], r["score"]) for r in got] == [(10, 12, "near", 2.0), (10, 15, "near", 4.75), (100, 150, "far", 49.75), (100, 160, "far", 59.75)]


def test_alignment(spark):
    rows = [(1024 + 4096 * i, True, True, False) for i in range(12)] + [(512 * i, False, False, True) for i in range(8)]
    best = fragments.alignment(spark.createDataFrame(rows, "offset long, valid boolean, timestamped boolean, padding boolean"), 4096).first()
    assert best["residue"] == 1024 and best["rank"] == 1 and best["confidence"] > 0.5


def brute_flow(nodes, edges, starts, reward):
    worth = {(a, b): reward - s for a, b, s in edges if reward - s > 0 and nodes[b] > nodes[a] and b not in starts}
    best = 0.0
    for n in range(len(worth) + 1):
        for pick in itertools.combinations(worth, n):
            if len({a for a, _ in pick}) < n or len({b for _, b in pick}) < n:
                continue
            after = dict(pick)
            reached = set(starts)
            todo = list(starts)
            while todo:
                if (x := after.get(todo.pop())) is not None:
                    reached.add(x)
                    todo.append(x)
            if all(a in reached for a, _ in pick):
                best = max(best, sum(worth[p] for p in pick))
    return best


def test_flows_against_brute_force(spark):
    r = random.Random(4)
    for _ in range(25):
        nodes = {i: i for i in range(6)}
        edges = [(a, b, float(r.randrange(30))) for a in range(6) for b in range(a + 1, 6) if r.random() < 0.5]
        found, total = paths.flow(nodes, edges, [0, 1], 20.0)
        assert total == pytest.approx(brute_flow(nodes, edges, [0, 1], 20.0))
        flat = [x for p in found for x in p]
        assert len(flat) == len(set(flat))


def test_beams(spark):
    starts = spark.createDataFrame([(1, 0)], "problem long, start long")
    edges = spark.createDataFrame([(1, 0, 1, 5.0), (1, 0, 2, 1.0), (1, 2, 3, 1.0), (1, 1, 3, 0.5), (1, 3, 0, 0.1)], "problem long, src long, dst long, score double")
    got = paths.hypotheses(starts, edges).collect()
    assert [(r["fragments"], r["cost"]) for r in got] == [([0, 2, 3], 2.0), ([0, 1, 3], 5.5)]


def test_carried_records(spark):
    layout = carry.Layout(b"RX", {1: (8, 4, "<I"), 2: (8, 4, "<I")}, most=1000)
    rec = lambda kind, payload: b"RX" + bytes([kind, 0]) + struct.pack("<I", len(payload)) + payload
    body = b"".join(rec(1 + i % 2, bytes([65 + i]) * (20 + i)) for i in range(8))
    stream = body + b"\xff" * (-len(body) % 100)
    parts = [stream[i : i + 100] for i in range(0, len(stream), 100)]
    want = b"".join(bytes([65 + i]) * (20 + i) for i in range(0, 8, 2))
    df = spark.createDataFrame([(1, i, bytearray(p)) for i, p in enumerate(parts)] + [(2, 0, bytearray(parts[0])), (2, 1, bytearray(b"garbage!" * 12))], "path long, seq int, data binary")
    got = {r["path"]: r for r in carry.extract(df, layout, frozenset({1})).collect()}
    assert bytes(got[1]["payload"]) == want and got[1]["left_over"] == 0 and got[2]["error"] == "lost sync"
    ending, at = carry.walk(parts[0], 0, layout)
    pairs = [(0, i, bytearray(parts[0][at:]), bytearray(p)) for i, p in enumerate(parts)]
    assert ending == "carry"
    assert [r["dst"] for r in carry.continuations(spark.createDataFrame(pairs, "src long, dst long, tail binary, fragment binary"), layout).collect()] == [1]


def test_hash_chain(spark):
    import hashlib

    rows, last = [], integrity.GENESIS
    for i in range(1, 7):
        h = hashlib.sha256(f"{last}{i}".encode()).hexdigest()
        rows.append(("a", i, last, h, h if i != 4 else "tampered"))
        last = h
    rows += [("b", 1, integrity.GENESIS, "x", "x"), ("b", 3, "x", "y", "y")]
    for block in (1, 2, 1000):
        got = {r["chain"]: tuple(r)[1:] for r in integrity.verify_chain(spark.createDataFrame(rows, "chain string, seq int, prev_hash string, entry_hash string, recomputed string"), block).collect()}
        assert got == {"a": (6, 1, 4), "b": (2, 1, 3)}
    text = spark.createDataFrame([('{"b": 1, "a": [1, "é"]}',), (None,)], "j string").select(integrity.canonical_json(F.col("j"))).collect()
    assert [r[0] for r in text] == ['{"a":[1,"é"],"b":1}', None]


def test_aes_known_answers(spark):
    """NIST SP 800-38A, F.2.1 and F.5.1."""
    key, plain = "2B7E151628AED2A6ABF7158809CF4F3C", "6BC1BEE22E409F96E93D7E117393172A"
    u = lambda h: F.unhex(F.lit(h))
    cbc = spark.range(1).select(F.hex(integrity.decrypt_cbc(u("7649ABAC8119B246CEE98E9B12E9197D"), u(key), u("000102030405060708090A0B0C0D0E0F"), padded=False))).first()[0]
    assert cbc == plain
    rows = spark.range(1).select("id", u("874D6191B620E3261BEF6864990DB6CE").alias("data"), u("F0F1F2F3F4F5F6F7F8F9FAFBFCFDFEFF").alias("counter"))
    assert integrity.ctr_blocks(rows, u(key)).select(F.hex("data")).first()[0] == plain
    # counters carry over their halves and wrap at 2**128
    for counter, third in (("00" * 8 + "FF" * 8, "00" * 7 + "01" + "00" * 7 + "01"), ("FF" * 16, "00" * 15 + "01")):
        stream = integrity.ctr(u("00" * 40), u(key), u(counter))
        want = F.aes_encrypt(u(third), u(key), F.lit("ECB"), F.lit("PKCS"))
        row = spark.range(1).select(F.hex(stream), F.hex(F.substring(want, 1, 8)), F.hex(integrity.ctr(u(""), u(key), u(counter)))).first()
        assert row[0][64:] == row[1] and len(row[0]) == 80 and row[2] == ""


def test_profiles(spark):
    pack = {"schema_version": 1, "profiles": [{"profile_id": "p", "family_id": "f", "vendor_patterns": ["acme*"], "model_patterns": ["dvr-4?00"], "firmware_patterns": ["1.2.*"]}, {"profile_id": "q", "family_id": "f", "model_patterns": ["zzz"]}]}
    got = profiles.match(spark.createDataFrame([(1, "Acme Inc", "DVR-4200", "1.2.9"), (2, "Acme", None, "1.2")], "device long, vendor string, model string, firmware string"), profiles.load(pack)).collect()
    assert [(r["device"], r["profile_id"], r["score"]) for r in got] == [(1, "p", 1.0)]
    for bad in ({"schema_version": 2, "profiles": []}, {"schema_version": 1}, {"schema_version": 1, "profiles": [{"profile_id": "x"}]}):
        with pytest.raises(ValueError):
            profiles.load(bad)


def test_reports(spark, tmp_path):
    (tmp_path / "m.map").write_text("# map\n0x2800 + 1\n0x1000 0x1000 +\n0x2000 0x800 +\n10240 2048 -\n0x3000 0x0 ?\n")
    got = reports.mapfile(spark, str(tmp_path / "m.map")).orderBy("pos").collect()
    assert [(r["pos"], r["size"], r["status"]) for r in got] == [(0x1000, 0x1000, "+"), (0x2000, 0x800, "+"), (0x2800, 0x800, "-")]
    json = '{"model_name":"M","user_capacity":{"bytes":10},"ata_smart_attributes":{"table":[{"id":5,"raw":{"value":6}},{"id":197,"raw":{"value":2}}]}}'
    r = reports.smart(spark.createDataFrame([(1, json), (2, "{}")], "key long, json string")).orderBy("key").collect()
    assert (r[0]["model"], r[0]["capacity"], r[0]["reallocated"], r[0]["pending"], r[0]["uncorrectable"], r[1]["model"]) == ("M", 10, 6, 2, None, None)
    good = {"case_id": "a", "source": "x.txt", "source_sha256": "0" * 64}
    assert reports.check_manifest({"schema_version": 1, "cases": [good]}, str(tmp_path)) == [good]
    (tmp_path / "l").symlink_to("/etc/hostname")
    for bad in ({"source": "../x"}, {"source": "/etc/x"}, {"source": "l"}, {"case_id": "-"}, {"source_sha256": "zz"}):
        with pytest.raises(ValueError):
            reports.check_manifest({"schema_version": 1, "cases": [good | bad]}, str(tmp_path))


def test_expectations(spark):
    e = spark.createDataFrame([("c", "k", "1"), ("c", "m", "2"), ("d", "k", None)], "case string, key string, value string")
    a = spark.createDataFrame([("c", "k", "9"), ("d", "k", None)], "case string, key string, value string")
    x = detect.expectations(e, a)
    assert {(r["case"], r["key"]): r["reason"] for r in x.collect()} == {("c", "k"): "differs k", ("c", "m"): "missing m", ("d", "k"): None}
    h = spark.createDataFrame([("c", True), ("d", True), ("e", False)], "case string, hash_ok boolean")
    assert {r["case"]: r["status"] for r in detect.case_results(x, h).collect()} == {"c": "FAIL", "d": "PASS", "e": "FAIL"}


def test_assignments_against_brute_force():
    r = random.Random(6)
    for _ in range(40):
        options = {k: [(float(r.randrange(9)), f) for f in r.sample(range(5), r.randrange(1, 4))] for k in range(3)}
        best = min(sum(1e7 if x is None else x[0] for x in pick) for pick in itertools.product(*([*o, None] for o in options.values())) if len({x[1] for x in pick if x}) == sum(x is not None for x in pick))
        got = paths.assign(options)
        assert sum(1e7 if got[k] is None else dict((f, c) for c, f in options[k])[got[k]] for k in options) == best


def test_local_chains(spark):
    starts = spark.createDataFrame([(1, 0), (1, 1)], "problem long, start long")
    edges = spark.createDataFrame([(1, 0, 2, 1.0), (1, 0, 3, 2.0), (1, 1, 2, 1.0), (1, 2, 4, 1.0), (1, 3, 4, 5.0)], "problem long, src long, dst long, score double")
    got = {r["start"]: (r["fragments"], r["ambiguous"]) for r in paths.local_chains(starts, edges).collect()}
    assert got == {0: ([0, 3], 1), 1: ([1, 2, 4], 0)}


def test_registry_triage_and_corpus(spark, tmp_path):
    import hashlib
    import json

    from tracewell.operators import formats
    from tracewell.plans import corpus, triage
    from tracewell.sources import sinks

    stamp = (26 << 26) | (8 << 22) | (9 << 17)
    data = b"noise" + b"".join(frames.build(0xFD, i % 2, i, stamp + i, 0, b"\0\0\0\1\x67" + bytes([i]) * 9) for i in range(16))
    (tmp_path / "d.bin").write_bytes(data)
    r = formats.default()
    assert r.names() == ["annexb", "dhav", "hikvision", "mpegps"] and r.get("DHAV").supports("demux") and not r.get("annexb").supports("demux")
    assert r.descriptors(spark).count() == 4
    with pytest.raises(ValueError):
        r.register(r.get("dhav"))
    row = triage.triage(spark, str(tmp_path / "d.bin")).first()
    assert row["plugin"] == "dhav" and row["confidence"] == 0.98 and {s["id"]: s["count"] for s in row["signatures"]}["dhav"] == 16 and "scan as dhav" in row["recommendations"]
    sinks.write_report(triage.triage(spark, str(tmp_path / "d.bin")), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["scanned"] == len(data)
    with pytest.raises(FileExistsError):
        sinks.write_report(spark.range(1), str(tmp_path / "r.json"), replace=False)
    chunks = evidence.read(spark, [str(tmp_path / "d.bin")])
    sizes = sinks.write_streams(frames.demux(frames.carve(chunks)), str(tmp_path / "out"))
    assert {n.rsplit("-channel-")[1]: k for n, k in sizes.items()} == {"0.h264": 8 * 14, "1.h264": 8 * 14} and all((tmp_path / "out" / n).stat().st_size == 112 for n in sizes)
    good = {"case_id": "a", "source": "d.bin", "source_sha256": hashlib.sha256(data).hexdigest(), "expectations": [{"kind": "frame_count", "expected": 16}, {"kind": "size", "expected": 1}, {"kind": "magic", "expected": 1}]}
    bad = good | {"case_id": "b", "source_sha256": "0" * 64}
    got = {(x["case"], x["key"]): x["status"] for x in corpus.run(spark, {"schema_version": 1, "cases": [good, bad]}, str(tmp_path)).collect()}
    assert got == {("a", "source_sha256"): "PASS", ("a", "frame_count"): "PASS", ("a", "size"): "FAIL", ("a", "magic"): "ERROR", ("b", "source_sha256"): "FAIL"}


def _record(kind: int, payload: bytes) -> bytes:
    return b"RX" + bytes([kind, 0]) + struct.pack("<I", len(payload)) + payload


def _beam_by_hand(parts, start, layout):
    """All paths by whole bytes, each probed with what the path before it left."""
    done = []

    def go(path, tail, cost, ambiguous):
        nexts = []
        for n in range(path[-1] + 1, len(parts)):
            if (end := carry.probe(tail, parts[n], layout)) is not None:
                nexts.append((n - path[-1] - (0.25 if end[0] == "padding" else 0), n, end))
        unsure = ambiguous + (len(nexts) > 1)
        if not nexts:
            done.append((path, 1, unsure, cost, paths.OPEN))
        for c, n, (kind, at) in nexts:
            if kind == "padding":
                done.append(((*path, n), 0, unsure, cost + c, paths.ENDED))
            else:
                go((*path, n), parts[n][at:] if kind == "carry" else b"", cost + c, unsure)

    kind, at = carry.walk(parts[start], 0, layout)
    go((start,), parts[start][at:] if kind == "carry" else b"", 0.0, 0)
    return sorted(done, key=lambda h: (-len(h[0]), h[1], h[2], h[3], h[0]))


def test_rebuilding_against_all_paths(spark, tmp_path):
    layout = carry.Layout(b"RX", {1: (8, 4, "<I"), 2: (8, 4, "<I")}, most=5000, room=8)
    r, size = random.Random(7), 256
    for trial in range(12):
        # records of few lengths, so that fragments of one camera go on with the other's too
        streams = []
        for cam in range(2):
            body = b"".join(_record(1, bytes([65 + cam]) * r.choice((40, 56))) for _ in range(r.randrange(8, 16)))
            streams.append(body + b"\xff" * (64 + -(len(body) + 64) % size))
        cut = [[s[i : i + size] for i in range(0, len(s), size)] for s in streams]
        parts = [p for pair in itertools.zip_longest(*cut, fillvalue=b"\x55" * size) for p in pair]
        path = tmp_path / f"{trial}.raw"
        path.write_bytes(b"".join(parts) + b"part")
        of = rebuild.Fragments(([str(path)],), size)
        assert of.count() == len(parts)
        with evidence.Space(*of.space) as s:
            for start in (0, 1):
                got = rebuild.follow(s, of, layout, start, len(parts), top=100, width=10_000, most=10_000)
                assert got == _beam_by_hand(parts, start, layout)
                assert [h[4] for h in rebuild.follow(s, of, layout, start, len(parts), depth=0)] == [paths.CUT]
            assert rebuild.follow(s, of, layout, len(parts), len(parts))[0][4] == paths.OUTSIDE
            assert rebuild.follow(s, of, layout, 0, 1)[0][1:] == (1, 0, 0.0, paths.OPEN)


def test_ciphers_hold_a_batch_once():
    import tracemalloc

    import pyarrow as pa

    from tracewell.operators import integrity

    data, stream = pa.array([b"ab" * 5000, None] * 1000, pa.binary()), pa.array([b"  " * 6000] * 2000, pa.binary())
    tracemalloc.start()
    got = integrity._xor(data.slice(2), stream.slice(2))
    blocks = integrity._counters(pa.array([b"\xff" * 16, None] * 1000, pa.binary()), pa.array([2, 0] * 1000), pa.array([600, 5] * 1000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() == b"AB" * 5000 and got.null_count == 999 and len(got) == 1998
    assert blocks[2].as_py() == b"".join(i.to_bytes(16, "big") for i in range(1, 601)) and blocks.null_count == 1000
    assert peak < 1.3 * (10_000_000 + 9_600_000)


def test_a_long_recording_is_followed_to_its_end(tmp_path):
    layout = carry.Layout(b"RX", {1: (8, 4, "<I")}, most=5000, room=8)
    size, n = 64, 4400
    body = b"".join(_record(1, b"A" * (19 + i * 7 % 23)) for i in range(n * size // 30))[: (n - 2) * size]
    last = _record(1, b"A" * 19)
    # the cut record is made whole, so that the last fragment ends in padding
    at = 0
    while (r := carry.record(body, at, layout)) and at + r[1] + r[2] <= len(body):
        at += r[1] + r[2]
    path = tmp_path / "long.raw"
    path.write_bytes((body[:at] + last).ljust(n * size, b"\xff"))
    of = rebuild.Fragments(([str(path)],), size)
    with evidence.Space(*of.space) as s:
        best = rebuild.follow(s, of, layout, 0, of.count())[0]
    assert best[0] == tuple(range(len(best[0]))) and len(best[0]) >= n - 2 and best[1] == 0 and best[4] == paths.ENDED


def test_recovery_says_what_is_unsure(spark, tmp_path):
    layout = carry.Layout(b"RX", {1: (8, 4, "<I"), 2: (8, 4, "<I")}, most=5000, room=8)
    size = 256
    # two cameras with the same record lengths can't be told apart; a third ends without a continuation, a fourth at once
    streams = [b"".join(_record(1, bytes([65 + cam]) * 100) for _ in range(6)) for cam in range(2)]
    parts = [s[i : i + size].ljust(size, b"\0") for i in range(0, len(streams[0]), size) for s in streams]
    lost = _record(1, b"Z" * 100) * 2 + _record(2, b"Y" * 1000)
    parts += [lost[:size], _record(1, b"only").ljust(size, b"\xff")]
    path = tmp_path / "space.raw"
    path.write_bytes(bytes(512) + b"".join(parts))
    of = rebuild.Fragments(([str(path)],), size, 512)
    starts = spark.createDataFrame([(0, 0), (0, 1), (1, len(parts) - 2), (2, len(parts) - 1)], "problem long, start long")
    got = {x["start"]: x for x in rebuild.recover(spark, starts, of, layout, frozenset({1})).collect()}
    assert [got[i]["records"] for i in (0, 1)] == [6, 6] and not set(got[0]["fragments"]) & set(got[1]["fragments"])
    assert {"ambiguous", "close alternative"} <= set(got[0]["reasons"]) and got[0]["status"] == "REVIEW"
    third, fourth = got[len(parts) - 2], got[len(parts) - 1]
    assert third["status"] == "REVIEW" and {"unresolved", "left over"} <= set(third["reasons"]) and third["left_over"] == size - 216
    assert fourth["status"] == "UNKNOWN" and fourth["bytes"] == 4 and fourth["sha256"] == hashlib.sha256(b"only").hexdigest()
    sums = {x["problem"]: x for x in rebuild.totals(choices.select_disjoint(rebuild.hypotheses(starts, of, layout))).collect()}
    assert sums[0]["continuations"] == len(parts) - 4 and sums[1]["unresolved"] == 1
    with pytest.raises(ValueError):
        rebuild.Fragments(([str(path)],), size, 100)
    assert rebuild.heads(spark, of, 3, 2, 4).collect()[0]["head"] == parts[2][:3]
    # a path over a fragment that doesn't go on is an error of its own, and the path ends there
    bad = rebuild.payloads(spark.createDataFrame([(0, 0, [0, len(parts) - 2, 1])], "problem long, start long, fragments array<long>"), of, layout, frozenset({1})).orderBy("seq").collect()
    assert [x["error"] for x in bad] == [None, "lost sync"] and bad[1]["sha256"] == hashlib.sha256(bytes(bad[0]["payload"])).hexdigest()
