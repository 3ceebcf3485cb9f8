"""Layout inference and chunk ranges against brute force."""

import random
import struct

import pytest

from tracewell.operators import carry, layout
from tracewell.sources import evidence

LAYOUT = carry.Layout(b"RX", {1: (8, 4, "<H"), 2: (16, 12, "<I")}, most=5000)
GOOD, BAD = 24 << 26 | 2 << 22 | 29 << 17 | 23 << 12 | 59 << 6 | 59, 24 << 26 | 2 << 22 | 30 << 17


def record(kind, time=0, size=40):
    return b"RX\x02" + bytes(5) + struct.pack("<II", time, size) if kind == 2 else b"RX\x01\x00" + struct.pack("<H", size) + bytes(2)


def space(seed):
    """Fragments of 1536 bytes from 512 * 2 on, with decoys, cut at the end."""
    rng = random.Random(seed)
    out = bytearray(rng.choice([b"U", b"R", b"\x00"]) * 1024)
    for _ in range(rng.randrange(0, 40)):
        f = bytearray(b"U" * 1536)
        head = rng.choice([record(2, GOOD), record(2, BAD), record(1), record(2, GOOD, 9999), b"RY\x02"])
        f[: len(head)] = head
        if rng.random() < 0.5:
            f[-64:] = bytes(rng.choice([0, 255]) for _ in range(64))
        if rng.random() < 0.3:
            f[512 : 512 + 16] = record(2, GOOD)
        if rng.random() < 0.3:
            f[700 : 700 + 16] = record(2, GOOD)  # in no sector's first bytes
        out += f
    return bytes(out[: len(out) - rng.choice([0, 5, 500, 1000, 1530])])


def by_force(data, size, start=0):
    out = {}
    for p in range(start, len(data), 512):
        r = out.setdefault(p % size, [0, 0, 0, 0])
        r[0] += 1
        head = data[p : p + 16]
        if (head[:3] == b"RX\x01" and len(head) >= 8 and 0 < struct.unpack_from("<H", head, 4)[0] <= 5000) or (head[:3] == b"RX\x02" and len(head) == 16 and 0 < struct.unpack_from("<I", head, 12)[0] <= 5000):
            r[1] += 1
            r[2] += head[2] == 2 and struct.unpack_from("<I", head, 8)[0] in (GOOD,)
    for p in range(start + (-start) % 512, len(data) + 512, 512):  # ends of fragments that begin in the range
        window = data[p + size - 64 : p + size]
        if window and set(window) <= {0, 255}:
            out.setdefault(p % size, [0, 0, 0, 0])[3] += 1
    return {k: tuple(v) for k, v in out.items() if any(v)}


@pytest.mark.parametrize("seed", range(6))
def test_evidence_by_force(spark, tmp_path, seed):
    data = space(seed)
    path = tmp_path / "image"
    path.write_bytes(data)
    for chunk in (700, 4096):
        chunks = evidence.read(spark, [str(path)], chunk=chunk, overlap=64, tasks=3)
        sums = layout.evidence(chunks, LAYOUT, [512, 1536, 3072], {2: 8})
        rows = sums.collect()
        for size in (512, 1536, 3072):
            assert {r["residue"]: (r["tested"], r["valid"], r["timestamped"], r["padding"]) for r in rows if r["fragment_size"] == size} == by_force(data, size)


def test_ranking(spark):
    rows = [("a", 1536, 0, 10, 4, 0, 1), ("a", 1536, 512, 10, 8, 6, 4), ("a", 1536, 1024, 10, 0, 0, 9), ("a", 512, 0, 30, 12, 6, 14), ("a", 3072, 512, 5, 4, 3, 2), ("a", 3072, 2048, 5, 4, 3, 2), ("a", 3072, 0, 5, 4, 0, 0), ("b", 512, 0, 3, 0, 0, 0)]
    found = layout.hypotheses(spark.createDataFrame(rows, layout.SUMS))
    r = {(x["source"], x["fragment_size"], x["residue"]): x for x in found.collect()}
    one, two, three = r["a", 1536, 512], r["a", 1536, 0], r["a", 1536, 1024]
    assert (one["score"], two["score"], three["score"]) == (66.0, 8.5, 4.5) and (one["rank"], two["rank"], three["rank"]) == (1, 2, 3)
    assert one["confidence"] == round(66 / 74.5, 6) and three["confidence"] == 0.0
    assert two["confidence"] == round(8.5 / 17 * (4 / 6) * (8.5 / 66), 6)
    assert r["b", 512, 0]["confidence"] == 0.0 and r["b", 512, 0]["fit"] == 0.0
    best = {x["source"]: (x["fragment_size"], x["residue"]) for x in layout.best(found).collect()}
    assert best == {"a": (1536, 512), "b": (512, 0)}
    assert found.where("source = 'b'").select(layout.notes().alias("n")).first()["n"][1:] == ["weak lead: scan more", "no fragment size fits well"]


def test_sizes_are_sectors(spark):
    with pytest.raises(ValueError, match="multiples"):
        layout.evidence(spark.range(0), LAYOUT, [1000], {})


def test_ranges_of_large_spaces():
    """2 TiB in 4 MiB chunks are some thousand tasks, each of whole chunks that lie together, and none is lost."""
    for total, chunk, tasks in ((2 << 40, 4 << 20, 64), (100 << 40, 4 << 20, 5000), (10_000, 777, 64), (0, 5, 2), (3, 5, 2), (1 << 30, 1 << 20, 16)):
        parts = evidence.ranges(100, 100 + total, chunk, tasks)
        assert len(parts) <= evidence.MOST and len(parts) >= min(tasks, -(-total // chunk)) // 2
        at = 100
        for p in parts:
            assert p.base == at and (at - 100) % chunk == 0 and p.first == (at - 100) // chunk
            at = p.stop
        assert at == 100 + total
    assert len(evidence.ranges(0, 2 << 40, 4 << 20, 64)) == 8192
