"""Files that many tasks write: commits, repeated tasks, failures; recordings recovered into them."""

import hashlib
import json
import os
import random
import struct
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from tracewell.operators import carry, demux, frames, rebuild
from tracewell.sources import evidence, payloads

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def write(df, folder):
    df.sparkSession.dataSource.register(payloads.PayloadFiles)
    df.write.format("payload-files").option("folder", str(folder)).mode("append").save()


def pieces(spark, n=40, size=1000):
    """Two files whose pieces are dealt to all tasks."""
    return spark.range(2 * n).select(F.concat(F.lit("f"), F.col("id") % 2).alias("name"), (F.floor(F.col("id") / 2) * size).alias("at"), F.encode(F.rpad(F.col("id").cast("string"), size, "x"), "UTF-8").alias("data")).repartition(7)


def test_many_tasks_write_a_file(spark, tmp_path):
    write(pieces(spark), tmp_path / "out")
    assert sorted(os.listdir(tmp_path / "out")) == ["f0", "f1"]
    for k in (0, 1):
        assert (tmp_path / "out" / f"f{k}").read_bytes() == b"".join(str(i).encode().ljust(1000, b"x") for i in range(k, 80, 2))
    with pytest.raises(Exception, match="exists"):  # files are never overwritten
        write(pieces(spark), tmp_path / "out")
    with pytest.raises(Exception, match="earlier run"):
        write(pieces(spark), tmp_path / "out")
    with pytest.raises(Exception, match="file name"):
        write(pieces(spark).withColumn("name", F.lit("../f")), tmp_path / "other")


@pytest.mark.parametrize("fault", ["gap", "overlap", "error"])
def test_failures_leave_parts(spark, tmp_path, fault):
    df = pieces(spark)
    if fault == "gap":
        df = df.where("not (name = 'f1' and at = 5000)")
    elif fault == "overlap":
        df = df.withColumn("at", F.when(F.col("at") == 5000, 4999).otherwise(F.col("at")))
    else:
        df = df.withColumn("data", F.when((F.col("at") == 39_000) & (F.col("name") == "f1"), F.raise_error(F.lit("disk full")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="written|disk full"):
        write(df, tmp_path)
    # a task that fails at once may leave nothing; those that see the fault on commit have written all
    assert all(n.endswith(".partial") for n in os.listdir(tmp_path)) and (fault == "error" or len(os.listdir(tmp_path)) == 2)


def test_a_repeated_task_is_harmless(tmp_path):
    """The first try dies after some rows; Spark runs the task again, and the files are whole."""
    code = f"""
    import os
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    from tracewell.session import ready
    from tracewell.sources import payloads
    s = ready(SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate())

    def run(batches):
        from pyspark import TaskContext
        for b in batches:
            for i in range(len(b)):
                yield b.iloc[i : i + 1]
                if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
                    raise RuntimeError("lost")

    s.dataSource.register(payloads.PayloadFiles)
    df = s.range(0, 3000, 1, 3).select(F.lit("f").alias("name"), (F.col("id") * 7).alias("at"), F.encode(F.lpad(F.col("id").cast("string"), 7, "0"), "UTF-8").alias("data"))
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    df.mapInPandas(run, df.schema).write.format("payload-files").option("folder", {str(tmp_path)!r}).mode("append").save()
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "lost" in done.stderr
    assert os.listdir(tmp_path) == ["f"] and (tmp_path / "f").read_bytes() == b"".join(b"%07d" % i for i in range(3000))


LAYOUT = carry.Layout(b"RX", {1: (8, 4, "<I"), 2: (8, 4, "<I")}, most=5000, room=8)


def record(kind, payload):
    return b"RX" + bytes([kind, 0]) + struct.pack("<I", len(payload)) + payload


def test_pieces_are_the_payloads_of_paths(spark, tmp_path):
    """Records over borders, headers cut by borders, padding, an error and a cut fragment: planned by headers, read by fragment, equal to a walk through all bytes."""
    rng = random.Random(3)
    streams = []
    for _ in range(12):
        body = b"".join(record(rng.choice([1, 1, 2]), bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 400)))) for _ in range(rng.randrange(1, 20)))
        body += b"\0" * 64 if rng.random() < 0.5 else b""
        if rng.random() < 0.3:
            body = body[: len(body) // 2] + b"lost" * 40
        streams.append(body + b"\0" * (-len(body) % 256))
    parts, chosen = [], []
    for k, s in enumerate(streams):
        at = len(parts)
        parts += [s[i : i + 256] for i in range(0, len(s), 256)]
        chosen.append((0, k, list(range(at, len(parts)))))
    chosen.append((0, 99, [0, len(parts)]))
    path = tmp_path / "space"
    path.write_bytes(b"".join(parts) + b"half")
    of, media = rebuild.Fragments(([str(path)],), 256), frozenset({1})
    c = spark.createDataFrame(chosen, "problem long, start long, fragments array<long>")
    plan = rebuild.planned(c, of, LAYOUT, media).cache()
    got = {}
    for r in rebuild.pieces(plan, of, LAYOUT, media, "start").orderBy("key", "at").collect():
        assert r["at"] == len(got.setdefault(r["key"], b""))
        got[r["key"]] += r["data"]
    want = {}
    for r in rebuild.payloads(c, of, LAYOUT, media).orderBy("start", "seq").collect():
        want.setdefault(r["start"], [b"", None, None])
        want[r["start"]][0] += bytes(r["payload"])
        want[r["start"]][1:] = [r["left_over"], r["error"]]
    assert {k: v[0] for k, v in want.items() if v[0]} == got
    last = {r["start"]: [r["left_over"], r["error"]] for r in plan.where("left_over is not null").collect()}
    assert last == {k: v[1:] for k, v in want.items()} and any(v[1] for v in last.values()) and any(v[0] for v in last.values())


def nal(kind):
    return b"\0\0\1" + bytes([kind]) + b"data"


def test_recovering_into_files(spark, tmp_path):
    one = [record(1, nal(7) + nal(8) + nal(5)), record(2, b"other"), *(record(1, nal(1) * 20) for _ in range(4))]
    two = [record(1, b"noise" * 30) for _ in range(3)]
    streams = [b"".join(x) + b"\0" * 64 for x in (one, two)]
    parts = [s[i : i + 256].ljust(256, b"\0") for s in streams for i in range(0, len(s), 256)]
    second = -(-len(streams[0]) // 256)
    path = tmp_path / "space"
    path.write_bytes(b"".join(parts) + b"\x55" * 512)
    of = rebuild.Fragments(([str(path)],), 256)
    starts = spark.createDataFrame([(0, 0), (1, second), (2, len(parts))], "problem long, start long")
    out = str(tmp_path / "out")
    rows = {r["start"]: r for r in rebuild.recover_files(spark, starts, of, LAYOUT, frozenset({1}), out, "cam").collect()}
    payload = b"".join(r[8:] for r in one if r[2] == 1)
    assert rows[0]["name"] == "cam-0-0.h264" and (tmp_path / "out" / "cam-0-0.h264").read_bytes() == payload
    assert rows[0]["sha512"] == hashlib.sha512(payload).hexdigest() and rows[0]["codec"] == "h264" and "codec not sure" not in rows[0]["reasons"]
    assert rows[second]["name"] == f"cam-1-{second}.es" and "codec not sure" in rows[second]["reasons"] and rows[second]["status"] == "REVIEW"
    lost = rows[len(parts)]
    assert lost["name"] is None and lost["status"] == "FAIL" and lost["bytes"] == 0
    with open(f"{out}/manifest.json") as f:
        about = json.load(f)
    assert (about["schema_version"], about["recordings"], about["bytes"], about["fail"], about["unwritten"]) == (3, 3, len(payload) + 450, 1, 0)
    assert about["review"] == sum(r["status"] == "REVIEW" for r in rows.values())
    with pytest.raises(FileExistsError):
        rebuild.recover_files(spark, starts, of, LAYOUT, frozenset({1}), out, "cam")
    assert sorted(n for n in os.listdir(out) if not n.startswith(".")) == ["cam-0-0.h264", f"cam-1-{second}.es", "candidates", "manifest.json"]


def test_a_long_recording_is_one_file(spark, tmp_path):
    some = [record(1, bytes([97 + i % 26]) * (19 + i * 7 % 23)) for i in range(8000)]
    data = b"".join(some) + b"\0" * 64
    (tmp_path / "space").write_bytes(data + b"\0" * (-len(data) % 64))
    of = rebuild.Fragments(([str(tmp_path / "space")],), 64)
    layout = carry.Layout(b"RX", LAYOUT.types, most=5000, room=8)
    out = tmp_path / "out"
    (row,) = rebuild.recover_files(spark, spark.createDataFrame([(0, 0)], "problem long, start long"), of, layout, frozenset({1}), str(out), "cam").collect()
    assert of.count() > 4096 and row["records"] == len(some) and (out / row["name"]).read_bytes() == b"".join(r[8:] for r in some)


def test_rows_that_touch_are_one():
    rows = [("a", 0, b"12"), ("a", 2, b"3"), ("a", 4, b"5"), ("b", 5, b"6"), ("b", 6, b""), ("b", 6, b"7")]
    (frame,) = payloads.batched(iter(rows))
    assert frame.to_dict("records") == [{"key": "a", "at": 0, "data": b"123"}, {"key": "a", "at": 4, "data": b"5"}, {"key": "b", "at": 5, "data": b"67"}]
    many = list(payloads.batched((("a", i, b"x") for i in range(1000)), 6500))
    assert len(many) == 10 and b"".join(d for f in many for d in f["data"]) == b"x" * 1000


def test_channels_are_read_in_few_rows(spark, tmp_path):
    (tmp_path / "space").write_bytes(bytes(range(250)) * 40)
    plan = spark.range(10_000).selectExpr("'f' as name", "id as at", "id as place", "1L as size")
    got = demux.pieces(plan, ([str(tmp_path / "space")],)).orderBy("at").collect()
    assert b"".join(bytes(r["data"]) for r in got) == bytes(range(250)) * 40 and len(got) <= 2 * spark.sparkContext.defaultParallelism


def test_spaces_are_read_only(tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    with evidence.Space([str(tmp_path / "f")]) as s:
        assert s.read(1, 5) == b"bc" and all(f.mode == "rb" for f in s.files)


def test_channels_as_files(spark, tmp_path):
    """Nested and broken frames, channels of two codecs, audio; each file is what a walk over the space gives."""
    rng = random.Random(4)
    parts = []
    for i in range(200):
        payload = rng.choice([b"\0\0\0\1\x67a", b"\0\0\1\x40b", b"sound", b""]) + bytes(rng.choice(b"xy") for _ in range(rng.randrange(50)))
        f = bytearray(frames.build(rng.choice([0xFD, 0xFD, 0xF0]), i % 3, i, 1 << 26, 0, payload, bytes([0x81, 0, 0xC, 5]) if i % 7 == 0 else b""))
        if i % 11 == 0:
            f[-1] ^= 1
        parts += [bytes(f), b"between" * rng.randrange(3)]
    data = b"".join(parts)
    (tmp_path / "space").write_bytes(data)
    done = {r["name"]: r for r in demux.to_files(spark, ([str(tmp_path / "space")],), str(tmp_path / "out"), chunk=999).collect()}
    want = {}
    for f in frames.in_chunk(data, 0, len(data)):
        if f["valid"]:
            name = f"channel-{f['channel']:02d}."
            want[name + "native.dhav"] = want.get(name + "native.dhav", b"") + data[f["offset"] : f["offset"] + f["length"]]
            if f["frame_type"] == 0xFD and f["codec"] and f["payload"]:
                want[name + f["codec"]] = want.get(name + f["codec"], b"") + f["payload"]
    assert set(done) == set(want) and len(want) >= 8
    for name, raw in want.items():
        assert (tmp_path / "out" / name).read_bytes() == raw and done[name]["sha512"] == hashlib.sha512(raw).hexdigest()
    with open(tmp_path / "out" / "manifest.json") as f:
        about = json.load(f)
    assert about["schema_version"] == 2 and [c["channel"] for c in about["channels"]] == [0, 1, 2] and {f["name"]: f["bytes"] for f in about["files"]} == {n: len(r) for n, r in want.items()}
    assert {c["channel"]: c["status"] for c in about["channels"]} == {0: "REVIEW", 1: "REVIEW", 2: "REVIEW"}  # every eleventh is missing
    with pytest.raises(FileExistsError):
        demux.to_files(spark, ([str(tmp_path / "space")],), str(tmp_path / "out"))
