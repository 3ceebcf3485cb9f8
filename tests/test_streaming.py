"""Streams give what batches give."""

import datetime as dt
import random
import time

from tracewell.operators import scan
from tracewell.streaming import carry, reassembly, windows


def test_minute_buckets(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 9)
    rows = [(i % 2, t0 + dt.timedelta(seconds=20 * i), 5) for i in range(9)]
    spark.createDataFrame(rows, "channel int, ts timestamp_ntz, size long").write.parquet(str(tmp_path / "in"))
    batch = windows.minute_buckets(spark.read.parquet(str(tmp_path / "in"))).collect()
    q = windows.minute_buckets(spark.readStream.schema("channel int, ts timestamp_ntz, size long").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("buckets").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("buckets").collect())) == sorted(map(str, batch))


def test_hits_across_chunks(spark, tmp_path):
    data = b"xxabab" * 5
    for i, at in enumerate(range(0, len(data), 4)):
        spark.createDataFrame([("s", at, bytearray(data[at : at + 4]))], "source string, base long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, base long, data binary").parquet(str(tmp_path / "in"))
    q = carry.hits(stream, b"abab").writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["offset"] for r in spark.table("hits").collect()) == [o for o in range(len(data)) if data.startswith(b"abab", o)]


def test_reassembly_by_force():
    """Chunks in any order, some twice, some lost: hits of all that is whole, and the holes."""
    rng = random.Random(3)
    signatures = scan.as_signatures([("one", b"abab"), ("two", b"x"), ("three", b"aabxa")])
    for _ in range(200):
        data = bytes(rng.choice(b"abx") for _ in range(120))
        chunks = [(i, data[i : i + 7]) for i in range(0, 120, 7)]
        lost = set(rng.sample(range(1, 17), rng.randrange(3)))
        sent = [c for k, c in enumerate(chunks) if k not in lost]
        sent += rng.sample(sent, 3)
        rng.shuffle(sent)
        r, found = reassembly.Reassembly(signatures), []
        for base, part in sent:
            state = (r.at, r.tail, dict(r.waiting))  # as from a checkpoint
            r = reassembly.Reassembly(signatures, *state)
            r.add(base, part)
            found += r.go_on()
        while r.waiting:
            found += r.over()
        gone = {b for k in lost for b in range(7 * k, min(120, 7 * k + 7))}
        want = [(s.id, o) for s in signatures for o in range(120) if data.startswith(s.pattern, o) and not gone & set(range(o, o + len(s.pattern)))]
        assert sorted((i, o) for i, o, _ in found if i) == sorted(want)
        assert {b for i, o, n in found if not i for b in range(o, o + n)} == {b for b in gone if b < max(base + len(p) for base, p in sent)}


def test_chunks_in_any_order_and_a_restart(spark, tmp_path):
    """A stream that is stopped half way and started again gives what a batch gives."""
    rng = random.Random(1)
    data = {k: bytes(rng.choice(b"abx") for _ in range(200)) for k in "pq"}
    rows = [(k, i, bytearray(v[i : i + 13])) for k, v in data.items() for i in range(0, 200, 13)]
    rng.shuffle(rows)
    known = [("one", b"abab"), ("two", b"x")]

    def more(some):
        spark.createDataFrame(some, "source string, base long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("source string, base long, data binary").parquet(str(tmp_path / "in"))
        w = reassembly.hits(stream, known).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        w.trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()

    more(rows[: len(rows) // 2])
    more(rows[len(rows) // 2 :])
    got = [(r["source"], r["id"], r["offset"]) for r in spark.read.schema(reassembly.FOUND).parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted((k, i, o) for k, v in data.items() for i, p in known for o in range(200) if v.startswith(p, o))


def test_chunks_that_follow_are_searched_at_once():
    signatures = reassembly.as_signatures([("ab", b"ab")])
    matcher, asked = reassembly.Matcher([b"ab"]), []

    class Counted:
        def find(self, data):
            asked.append(data)
            return matcher.find(data)

    r = reassembly.Reassembly(signatures, matcher=Counted())
    for i in reversed(range(50)):
        r.add(3 * i, b"aba"[i % 2 :] + b"b" * (i % 2))
    data = b"".join(b"aba"[i % 2 :] + b"b" * (i % 2) for i in range(50))
    assert [p for _, p, _ in r.go_on()] == [i for i in range(len(data)) if data[i : i + 2] == b"ab"] and asked == [data]


def test_sources_of_a_bucket_by_force():
    """Many sources in one bucket, chunks in any order, some twice, some lost, with patience: what each source gives by itself."""
    rng = random.Random(5)
    signatures = scan.as_signatures([("one", b"abab"), ("two", b"x"), ("three", b"aabxa")])
    matcher = reassembly.Matcher([s.pattern for s in signatures])
    for patience in (None, 2.0):
        for _ in range(40):
            names = [*"pqrstuv", None]
            data = {k: bytes(rng.choice(b"abx") for _ in range(rng.randrange(1, 80))) for k in names}
            sent = [(k, i, v[i : i + 7]) for k, v in data.items() for i in range(0, len(v), 7) if rng.random() < 0.9]
            sent += rng.sample(sent, 5)
            rng.shuffle(sent)
            alone, until, state, want, got = {}, {}, None, [], []
            for turn in range(12):
                some, now = sent[8 * turn : 8 * turn + 8], 1000 * turn + 1
                b = reassembly.Bucket(signatures, matcher, state)  # as from a checkpoint
                for chunk in some:
                    b.add(*chunk)
                for frame in b.go_on([k for k, _, _ in some], now, patience):
                    got += [(k, i, o, n) for k, i, n, offsets in frame.itertuples(index=False) for o in offsets]
                state = b.state()
                for k in {k for k, _, _ in some} | {k for k, u in until.items() if u <= now}:
                    r = alone.setdefault(k, reassembly.Reassembly(signatures, matcher=matcher))
                    mine = [c for c in some if c[0] == k]
                    for _, base, part in mine:
                        r.add(base, part)
                    want += [(k, *f) for f in (r.go_on() if mine else r.over())]
                    until.pop(k, None)
                    if r.waiting and patience is not None:
                        until[k] = now + 2000
                assert b.until == until
            assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_many_sources_are_few_rows_of_state(spark, tmp_path, monkeypatch):
    """Short sources share calls and rows of the state."""
    monkeypatch.setattr(reassembly, "BUCKETS", 4, raising=False)
    data = {f"s{k}": b"abxab"[k % 5 :] + b"ab" * (k % 3) for k in range(300)}
    rows = [(k, i, bytearray(v[i : i + 2])) for k, v in data.items() for i in range(0, len(v), 2)]
    random.Random(2).shuffle(rows)
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, "source string, base long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, base long, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = reassembly.hits(stream, [("ab", b"ab"), ("x", b"x")]).writeStream.format("memory").queryName("few").outputMode("append").start()
    q.processAllAvailable()
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    want = sorted((k, i, o, len(p)) for k, v in data.items() for i, p in (("ab", b"ab"), ("x", b"x")) for o in range(len(v)) if v.startswith(p, o))
    assert sorted(tuple(r) for r in spark.table("few").collect()) == want and held <= 4


def test_a_hole_after_patience(spark, tmp_path):
    rows = [("p", 0, bytearray(b"ab")), ("p", 4, bytearray(b"ab")), ("p", 9, bytearray(b"ab")), ("q", 0, bytearray(b"xab"))]
    spark.createDataFrame(rows, "source string, base long, data binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, base long, data binary").parquet(str(tmp_path / "in"))
    q = reassembly.hits(stream, [("ab", b"ab")], patience=0.5).writeStream.format("memory").queryName("holes").outputMode("append").start()
    end = time.time() + 120
    while time.time() < end and spark.table("holes").count() < 6:
        time.sleep(0.5)
    q.stop()
    assert sorted(map(tuple, spark.table("holes").collect()), key=str) == sorted([("p", "ab", 0, 2), ("p", None, 2, 2), ("p", "ab", 4, 2), ("p", None, 6, 3), ("p", "ab", 9, 2), ("q", "ab", 1, 2)], key=str)
