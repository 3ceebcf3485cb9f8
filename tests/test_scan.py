"""One pass over all signatures against a search for each."""

import random
import re
import time

import pytest

from tracewell.operators import scan
from tracewell.sources import evidence


def places(data, pattern):
    return [m.start() for m in re.finditer(b"(?=" + re.escape(pattern) + b")", data, re.S)]


@pytest.mark.parametrize("seed", range(8))
def test_matcher_by_force(seed):
    """Patterns of all lengths, of filling, with common beginnings, within one another; some at the borders."""
    rng = random.Random(seed)
    word = lambda n: bytes(rng.choice(b"\x00\x01\xffab") for _ in range(n))
    patterns = list({word(rng.choice([1, 2, 3, 4, 5, 7, 12])) for _ in range(40)} | {b"\0" * 4, b"\0\0\0\1", b"\0\0\0\1g", b"\0\0\1", b"a" * 9})
    data = word(3000) + b"a" * 20 + bytes(10)
    for cut in (data, data[:5], data[:1], b""):
        got = {}
        for i, at in scan.Matcher(patterns).find(cut):
            assert i not in got
            got[i] = at.tolist()
        assert got == {i: x for i, p in enumerate(patterns) if (x := places(cut, p))}


def test_hits_over_chunks(spark, tmp_path):
    rng = random.Random(1)
    data = bytes(rng.choice(b"xyz\0") for _ in range(5000))
    (tmp_path / "f").write_bytes(data)
    known = [scan.Signature("one", b"xy\0z", "a", "structural"), scan.Signature("two", b"z", "b"), ("three", b"\0\0"), ("none", b"never")]
    chunks = evidence.read(spark, [str(tmp_path / "f")], chunk=333, overlap=4)
    got = scan.signature_hits(chunks, known, 10, 4900)
    want = {(s, o) for s, p in (("one", b"xy\0z"), ("two", b"z"), ("three", b"\0\0")) for o in places(data, p) if 10 <= o < 4900}
    assert {(r["id"], r["offset"]) for r in got.collect()} == want and got.count() == len(want)
    stats = {r["id"]: r for r in scan.with_strength(scan.hit_stats(got, len(data)), known).collect()}
    assert stats["one"]["strength"] == "structural" and stats["three"]["category"] == "custom" and stats["none"]["count"] == 0 and stats["none"]["offsets"] is None
    assert stats["two"]["count"] == sum(s == "two" for s, _ in want) and stats["two"]["truncated"]
    cut = {r["offset"]: r["data"] for r in scan.signature_hits(chunks, [("one", b"xy\0z")], around=(2, 6)).collect()}
    assert all(v is None or bytes(v) == data[k - 2 : k + 4] for k, v in cut.items()) and any(cut.values())


def test_signatures_are_checked():
    for bad in (("", b"x"), ("a", b""), ("a", b"x" * 4097), ("a", b"x", "c", "proof")):
        with pytest.raises(ValueError, match="a signature has"):
            scan.Signature(*bad)
    with pytest.raises(ValueError, match="unique"):
        scan.as_signatures([("a", b"x"), ("a", b"y")])


def test_two_hundred_signatures_cost_little_more_than_one():
    rng = random.Random(6)
    data = rng.randbytes(16 << 20)
    patterns = [rng.randbytes(rng.randrange(4, 20)) for _ in range(200)]

    def cost(some):
        m = scan.Matcher(some)
        best = 9.0
        for _ in range(4):
            began = time.process_time()
            list(m.find(data))
            best = min(best, time.process_time() - began)
        return best

    assert cost(patterns) < 3 * cost(patterns[:1])
