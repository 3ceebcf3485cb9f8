"""Detectors: states that merge, one scan for all families."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tracewell.operators import carry, formats, frames, media


def whole(data, source="a"):
    return formats.Chunk(source, 0, len(data), data)


def cut(data, size, over=200):
    return [formats.Chunk("a", i, min(size, len(data) - i), data[i : i + size + over]) for i in range(0, len(data), size)]


def mixed(seed):
    rng = random.Random(seed)
    parts = []
    for i in range(60):
        parts.append(rng.choice([frames.build(0xFD, rng.randrange(256), i, 1 << 26, 0, b"x" * rng.randrange(40)), b"\0\0\0\1\x67sps", b"\0\0\1\x68pps", b"\0\0\1\xba", b"\0\0\1\xe7", b"\0\0\1\xf0", b"DHAV", rng.randbytes(rng.randrange(30))]))
    return b"".join(parts)


@pytest.mark.parametrize("seed", range(5))
def test_states_of_chunks_merge_to_that_of_the_whole(seed):
    data = mixed(seed)
    for f in formats.default().families.values():
        want = f.detector.look(whole(data))
        for size in (7, 64, 500):
            got = {}
            for c in cut(data, size):
                for k, v in f.detector.look(c).items():
                    got[k] = formats.merged(k, got[k], v) if k in got else v
            assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}, (f.name, size)


def test_one_scan_for_all_families(spark):
    """Each chunk is read once, whatever is registered."""
    seen = spark.sparkContext.accumulator(0)
    data = mixed(9)

    def read(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [(c.source, c.base, c.size, c.data) for c in cut(data, 100)]
    chunks = spark.createDataFrame(rows, "source string, base long, size int, data binary").mapInPandas(read, "source string, base long, size int, data binary")
    registry = formats.default()
    registry.register(formats.records("made", "Made", carry.Layout(b"RX", {2: (16, 12, "<I")}), {2: 8}, 2, 512))
    found = {r["plugin"]: r["confidence"] for r in registry.detect_all(chunks).collect()}
    assert seen.value == len(rows) and found["dhav"] > 0 and registry.names() == ["annexb", "dhav", "hikvision", "made", "mpegps"]
    row = registry.report(chunks).first()
    assert seen.value == 2 * len(rows) and row["plugin"] == max(found, key=lambda k: (found[k], k == "annexb"))


def test_nal_types_by_hand():
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"\0\0\0\1\1ghA\xff") for _ in range(rng.randrange(60)))
        heads = [data[i + 3] for i in range(len(data) - 3) if data[i : i + 3] == b"\0\0\1" and data[i + 3] < 128]
        avc, hevc, n = media.nal_types(data)
        assert n == len(heads) == sum(avc.values()) == sum(hevc.values())
        assert all(avc[t] == sum(h & 31 == t for h in heads) for t in avc) and all(hevc[t] == sum(h >> 1 & 63 == t for h in heads) for t in hevc)


def test_dates_by_family(spark):
    registry = formats.default()
    day = 24 << 26 | 2 << 22 | 29 << 17
    data = b"".join(frames.build(0xFD, 1, i, day + (i % 3 << 6) + (i % 2 << 17), 0, b"abc") for i in range(12))
    chunks = spark.createDataFrame([("a", 0, len(data), data)], "source string, base long, size int, data binary")
    got = registry.get("dhav").scan_date(chunks, "2024-02-29", None).collect()
    size = len(data) // 12
    assert {r["label"]: r["starts"] for r in got} == {f"00-0{m}": [i * size for i in range(12) if i % 3 == m and i % 2 == 0] for m in range(3)}
    of = carry.Layout(b"RX", {2: (16, 12, "<I")})
    made = formats.records("made", "Made", of, {2: 8}, 2, 1024)
    record = lambda time: (b"RX\x02" + bytes(5) + struct.pack("<II", time, 9)).ljust(512, b"U")
    data = b"".join(record(day + (i << 5)) for i in range(8))  # every second one is no fragment's beginning
    chunks = spark.createDataFrame([("a", 0, len(data), data)], "source string, base long, size int, data binary")
    got = made.scan_date(chunks, "2024-02-29", None).select("label", F.col("starts")).collect()
    assert sorted((r["label"], r["starts"]) for r in got) == [(f"00-0{i}", [i]) for i in range(4)]
    with pytest.raises(ValueError, match="no scan for dates"):
        registry.register(formats.Family("x", "X", frozenset({"scan_date"}), registry.get("dhav").detector))
