"""Column helpers against plain Python."""

import datetime as dt
import math
import struct
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import bytesx as B


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_little_endian(spark):
    data = struct.pack("<BHIQ", 7, 0xBEEF, 0xDEADBEEF, 2**64 - 2)
    row = spark.createDataFrame([(bytearray(data),)], ["b"]).select(B.le("b", 0, 1), B.le("b", 1, 2), B.le("b", 3, 4), B.le("b", 7, 8), B.le("b", 14, 4)).first()
    assert [None if x is None else int(x) for x in row] == [7, 0xBEEF, 0xDEADBEEF, 2**64 - 2, None]


def test_packed_time_roundtrip_and_impossible_dates(spark):
    times = [dt.datetime(2026, 8, 9, 13, 27, 45), dt.datetime(2000, 1, 1), dt.datetime(2063, 12, 31, 23, 59, 59)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    assert [r[0] for r in df.select(B.packed_time(B.pack_time("ts"))).collect()] == times
    bad = [13 << 22 | 1 << 17, 1 << 22 | 1 << 17 | 60, 2 << 22 | 30 << 17, 0]
    assert [r[0] for r in spark.createDataFrame([(b,) for b in bad], "v long").select(B.packed_time("v")).collect()] == [None] * 4
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(dt.datetime(1999, 1, 1),)], "ts timestamp_ntz").select(B.pack_time("ts")).collect()


def test_overlapping_and_disjoint_counts(spark):
    assert one(spark, F.struct(B.overlapping("s", "AA"), B.disjoint("s", "AA")), s="AAAA") == (3, 2)


def test_padding(spark):
    rows = [(bytearray(x),) for x in (b"", b"\0\xff\0", b"\0\1")]
    assert [r[0] for r in spark.createDataFrame(rows, ["b"]).select(B.padding("b")).collect()] == [True, True, False]


def test_video_pes_takes_four_bytes_each(spark):
    rows = [(bytearray(bytes.fromhex(x)),) for x in ("000001000001E0", "000001E0000001EF", "000001C0000001E0", "")]
    assert [r[0] for r in spark.createDataFrame(rows, ["b"]).select(B.video_pes("b")).collect()] == [0, 2, 1, 0]


def test_guid(spark):
    import uuid

    g = uuid.uuid4()
    assert one(spark, B.guid("b"), b=bytearray(g.bytes_le)) == str(g)
    assert one(spark, B.guid("b"), b=bytearray(b"\1\2")) == "0102"


def test_byte_sizes(spark):
    cases = {"4096": 4096, "0x1000": 4096, "1.5 KiB": 1536, "2GB": 2 * 10**9, "7 mib": 7 << 20, "1.0001 kb": None, "0.3": None, "-1": None, "": None, "12 parsecs": None, "1e3": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", B.byte_size("s").alias("n")).collect()
    assert {r["s"]: r["n"] for r in rows} == cases


@settings(max_examples=60, deadline=None)
@given(st.text("ab*?[]!c", max_size=8), st.text("abc[]", max_size=8))
def test_globs_match_fnmatch(pattern, text):
    import fnmatch
    import re

    if "[]" in pattern or "[!]" in pattern:
        return  # an empty set is a literal in one reading and not in the other
    assert bool(re.match(B.glob_regex(pattern), text)) == fnmatch.fnmatchcase(text, pattern)


def test_fractions(spark):
    rows = spark.createDataFrame([("30000/1001",), ("25",), ("0/0",), ("N/A",), (None,), ("1/2/3",)], "s string").select(B.fraction("s")).collect()
    assert [r[0] for r in rows] == [30000 / 1001, 25.0, None, None, None, None]


def test_stripes(spark):
    member, at = B.stripe("o", 3, 512, 100)
    got = spark.range(0, 5000, 7).select(F.col("id").alias("o")).select("o", member, at).collect()
    assert all((m, a) == (o // 512 % 3, o // 512 // 3 * 512 + o % 512 + 100) for o, m, a in got)
    for bad in ((1, 512), (2, 500), (2, 256)):
        with pytest.raises(ValueError, match="stripes"):
            B.stripe("o", *bad)


def test_entropy_and_labels(spark):
    c = Counter(b"aab")
    want = -sum(n / 3 * math.log2(n / 3) for n in c.values())
    assert one(spark, B.entropy("c"), c=[2, 1, 0]) == pytest.approx(want)
    assert one(spark, B.entropy("c"), c=[0]) == 0
    assert one(spark, B.fat_label("s"), s="NO NAME \0 ") == "NO NAME"
    assert [one(spark, B.case_id("s"), s=x) for x in ("A-1", ".x", "a" * 81)] == [True, False, False]
    assert [one(spark, B.path_safe("s"), s=x) for x in ("a", "a/b", "a\\b", "a\0")] == [True, False, False, False]
