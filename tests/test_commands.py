"""Commands by their exit codes and output."""

import hashlib
import json
import struct

import pytest

from tracewell.__main__ import main, size
from tracewell.operators import frames, integrity
from tracewell.sources import reports

STAMP = (26 << 26) | (8 << 22) | (9 << 17) | (9 << 12)


@pytest.fixture
def source(tmp_path):
    data = b"noise" + b"".join(frames.build(0xFD, i % 2, i, STAMP + i, 0, b"\0\0\0\1\x67" + bytes([i]) * 9) for i in range(16))
    path = tmp_path / "d.bin"
    path.write_bytes(data)
    return str(path)


def test_sizes():
    assert [size(x) for x in ("4096", "0x10", "4 MiB", "1.5k")] == [4096, 16, 4 << 20, 1500]
    with pytest.raises(ValueError):
        size("0.3")


def test_commands(spark, source, tmp_path, capsys):
    run = lambda *args: (main([*args], spark), capsys.readouterr().out)
    assert run("inspect", source)[0] == 0 and "dhav" in run("formats")[1]
    code, out = run("hitmap", source, "--pattern", "m=44484156", "--keep", "2")
    assert code == 0 and json.loads(out)["count"] == 16 and json.loads(out)["truncated"]
    code, out = run("frames", source, "--channels")
    assert [json.loads(x)["frames"] for x in out.splitlines()] == [8, 8]
    assert len(run("frames", source)[1].splitlines()) == 16
    assert json.loads(run("boundaries", source, "--date", "2026-08-09")[1])["label"] == "09-00"
    made = {(x := json.loads(line))["name"]: x["bytes"] for line in run("demux", source, "--out", str(tmp_path / "o"))[1].splitlines()}
    assert made == {f"channel-0{c}.{kind}": n for c in (0, 1) for kind, n in (("h264", 112), ("native.dhav", 8 * 46))}
    assert run("triage", source, "--out", str(tmp_path / "t.json"))[0] in (0, 3) and (tmp_path / "t.json").exists()
    assert run("detect", source)[0] in (0, 3) and run("storage", source)[0] == 0
    assert len(run("samples", source, "--count", "1", "--chunk", "512")[1].splitlines()) == 1
    assert run("frames", str(tmp_path / "none"))[0] == 1


def test_maps_and_logs(spark, tmp_path, capsys):
    (tmp_path / "m").write_text("0x0 0x100 +\n0x100 0x100 +\n")
    assert main(["map", str(tmp_path / "m"), "--size", "512"], spark) == 0
    assert main(["map", str(tmp_path / "m"), "--size", "600"], spark) == 3
    lines, last = [], integrity.GENESIS
    for i in range(1, 5):
        e = {"seq": i, "event": "é", "prev_hash": last}
        last = hashlib.sha256(json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        lines.append(json.dumps(e | {"entry_hash": last}))
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    assert main(["verify-audit", str(tmp_path / "log")], spark) == 0
    (tmp_path / "log").write_text("\n".join([*lines[:2], lines[2].replace("\\u00e9", "x"), lines[3]]))
    assert main(["verify-audit", str(tmp_path / "log")], spark) == 1
    (tmp_path / "log").write_text("\n".join([*lines, "not json"]))
    assert main(["verify-audit", str(tmp_path / "log")], spark) == 1
    table = spark.createDataFrame([(i, "hash", "done" if i % 2 else "new", i) for i in range(9)], "job_id int, kind string, status string, created int")
    assert [r["job_id"] for r in reports.jobs(table, status="done", limit=2).collect()] == [7, 5]


def test_layout_and_recover(spark, tmp_path, capsys):
    """Two recordings whose fragments take turns, by a framing of a file: where fragments begin, then the recordings as files."""
    record = lambda kind, n, x: b"RX" + bytes([kind]) + bytes(5) + struct.pack("<II", STAMP, n) + x * n
    streams = []
    for x, n in ((b"a", 300), (b"b", 411)):
        body = record(2, n, x) + b"".join(record(1, n, x) for _ in range(20))
        streams.append(body + bytes(64) + b"\x55" * (-(len(body) + 64) % 1024))
    data = bytes(512) + b"".join(s[i : i + 1024].ljust(1024, b"\x55") for i in range(0, max(map(len, streams)), 1024) for s in streams)
    (tmp_path / "d").write_bytes(data)
    (tmp_path / "f.json").write_text(json.dumps({"sync": "5258", "types": {"1": [16, 12, "<I"], "2": [16, 12, "<I"]}, "times": {"2": 8}, "begins": 2, "media": [1, 2]}))
    code = main(["layout", str(tmp_path / "d"), "--framing", str(tmp_path / "f.json"), "--size", "1024", "--size", "512"], spark)
    last = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert code in (0, 3) and (last["fragment_size"], last["residue"]) == (1024, 512)
    args = ["recover", str(tmp_path / "d"), "--framing", str(tmp_path / "f.json"), "--fragment", "1024", "--data-offset", "512", "--date", "2026-08-09", "--out", str(tmp_path / "out")]
    assert main(args, spark) == 3
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["start"], r["bytes"]) for r in rows] == [(0, 300 * 21), (1, 411 * 21)]
    assert (tmp_path / "out" / rows[0]["name"]).read_bytes() == b"a" * 6300 and (tmp_path / "out" / rows[1]["name"]).read_bytes() == b"b" * 8631
    assert main(args, spark) == 1
    (tmp_path / "f.json").write_text("{}")
    assert main(args[:-1] + [str(tmp_path / "again")], spark) == 1
