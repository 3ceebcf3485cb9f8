"""Master sectors of a recorder file system: a signature and little-endian geometry fields, scored for plausibility."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytesx import le
from . import scan

SIGNATURE = b"HIKVISION@HANGZHOU"
SIZE, SIGNATURE_AT = 256, 16
#: 64-bit fields by offset, and the 32-bit time of initialisation: fixed values.
FIELDS = {"capacity": 0x38, "logs_offset": 0x50, "logs_size": 0x58, "video_offset": 0x68, "block_size": 0x78, "blocks": 0x80, "tree1_offset": 0x88, "tree1_size": 0x90, "tree2_offset": 0x98, "tree2_size": 0xA0}
INITIALISED = 0xE0


#: What adds to a plausibility of 35, in hundredths: fixed values.
POINTS = {"capacity": 18, "block size": 12, "blocks": 10, "logs": 5, "video": 8, "first tree": 4, "second tree": 3, "time": 5}


def _signs(value: Callable[[str], Any]) -> dict[str, Any]:
    """What speaks for a master sector, by its fields; of columns or of numbers."""
    inside = lambda at, size: (value(at) > 0) & (value(at) + value(size) <= value("capacity"))
    return {
        "capacity": value("capacity") > 0, "block size": (value("block_size") >= 1 << 20) & (value("block_size") <= 8 << 30), "blocks": value("blocks") > 0, "logs": inside("logs_offset", "logs_size"),
        "video": inside("video_offset", "block_size"), "first tree": inside("tree1_offset", "tree1_size"), "second tree": inside("tree2_offset", "tree2_size"), "time": value("initialised") > 946_684_800,
    }


def plausibility(sector: bytes) -> int:
    """Of a sector's bytes, in hundredths; 0 without the signature."""
    if len(sector) < SIZE or sector[SIGNATURE_AT : SIGNATURE_AT + len(SIGNATURE)] != SIGNATURE:
        return 0
    fields = {**{n: int.from_bytes(sector[at : at + 8], "little") for n, at in FIELDS.items()}, "initialised": int.from_bytes(sector[INITIALISED : INITIALISED + 4], "little")}
    return 35 + sum(POINTS[k] for k, holds in _signs(fields.__getitem__).items() if holds)


def parse(sectors: DataFrame) -> DataFrame:
    """Fields of sectors (source, offset, data) that have the signature, and plausibility from 0.35 to 1."""
    has = F.substring("data", SIGNATURE_AT + 1, len(SIGNATURE)) == F.lit(SIGNATURE)
    x = sectors.where((F.octet_length("data") >= SIZE) & has).select("source", "offset", *(le("data", at, 8).alias(n) for n, at in FIELDS.items()), le("data", INITIALISED, 4).alias("initialised"))
    score = sum((F.when(holds, POINTS[k]).otherwise(0) for k, holds in _signs(F.col).items()), F.lit(35))
    return x.withColumn("plausibility", score / 100)


def candidates(chunks: DataFrame, start: int = 0, size: int = 64 << 20, most: int = 8) -> DataFrame:
    """The first `most` master sectors in physical order within a range, by plausibility. chunks: source, base, size, data with an overlap of SIZE.

    A sector is cut out where its signature is found, in the chunk that it starts in, which may go on past the chunk's size.
    """
    whole = chunks.withColumn("size", (F.col("size") + SIGNATURE_AT).cast("int"))
    hits = scan.signature_hits(whole, [("master", SIGNATURE)], start, start + size, (SIGNATURE_AT, SIZE)).where("data is not null")
    first = parse(hits.select("source", (F.col("offset") - SIGNATURE_AT).alias("offset"), "data")).orderBy("offset").limit(most)
    return first.orderBy(F.desc("plausibility"), "offset")
