"""Partition tables and file systems by public specifications (MBR, UEFI GPT, superblock magics)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytesx import guid, le
from ..sources.evidence import Space

MOST_TABLE, MOST_ENTRIES = 16 << 20, 4096


def mbr(sectors: DataFrame) -> DataFrame:
    """Primary partitions of first sectors (source, data of 512 bytes); type EE is a protective entry of a GPT."""
    valid = sectors.where((F.octet_length("data") >= 512) & (F.hex(F.substring("data", 511, 2)) == "55AA"))
    each = valid.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("entry", F.expr("substring(data, 447 + 16 * number, 16)"))
    out = each.select("source", (F.col("number") + 1).alias("number"), le("entry", 4, 1).alias("type"), le("entry", 8, 4).alias("first_lba"), le("entry", 12, 4).alias("sectors"))
    return out.where("type <> 0 and sectors <> 0").withColumns({"last_lba": F.col("first_lba") + F.col("sectors") - 1, "protective": F.col("type") == 0xEE})


GPT = "source string, sector_size int, number int, type_guid binary, unique_guid binary, first_lba long, last_lba long, name string"


def parse_gpt(data: bytes) -> list[tuple] | None:
    """(sector size, number, type, unique, first, last, name) of a valid table at the start of data; None if it isn't valid."""
    for size in (512, 4096):
        head = data[size : 2 * size]
        if len(head) < size or head[:8] != b"EFI PART":
            continue
        header_size, crc = struct.unpack_from("<II", head, 12)
        lba, _, first, last = struct.unpack_from("<QQQQ", head, 24)
        table, count, entry, table_crc = struct.unpack_from("<QIII", head, 72)
        if not 92 <= header_size <= size or zlib.crc32(head[:16] + bytes(4) + head[20:header_size]) != crc:
            return None
        if lba != 1 or first > last or not 128 <= entry <= 4096 or not 1 <= count <= MOST_ENTRIES or entry * count > MOST_TABLE:
            return None
        raw = data[table * size : table * size + entry * count]
        if len(raw) < entry * count or zlib.crc32(raw) != table_crc:
            return None
        found = []
        for i in range(count):
            e = raw[i * entry : (i + 1) * entry]
            if e[:16] == bytes(16):
                continue
            a, b = struct.unpack_from("<QQ", e, 32)
            if not first <= a <= b <= last:
                return None
            found.append((size, i + 1, e[:16], e[16:32], a, b, e[56:128].decode("utf-16-le", "ignore").partition("\0")[0]))
        spans = sorted((x[4], x[5]) for x in found)
        return None if any(p[1] >= q[0] for p, q in zip(spans, spans[1:], strict=False)) else found
    return None


def gpt(heads: DataFrame) -> DataFrame:
    """Partitions of valid GPTs; heads: source, data (from the source's start to the table's end)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in GPT.split(", ")]
        for b in batches:
            yield pd.DataFrame([(s, *row) for s, d in zip(b["source"], b["data"], strict=True) for row in parse_gpt(bytes(d)) or ()], columns=columns)

    out = heads.select("source", "data").mapInPandas(run, GPT)
    return out.withColumns({"type_guid": guid("type_guid"), "unique_guid": guid("unique_guid")})


#: name, offset of the magic, magic in hexadecimal, confidence: fixed values of public formats.
MAGICS = [
    ("xfs", 0, "58465342", 0.99), ("ntfs", 3, "4E54465320202020", 0.99), ("exfat", 3, "4558464154202020", 0.99), ("fat12", 54, "4641543132", 0.95), ("fat16", 54, "4641543136", 0.95),
    ("fat32", 82, "4641543332", 0.95), ("ext", 1080, "53EF", 0.98), ("jfs", 32768, "4A465331", 0.99), ("btrfs", 65600, "5F42485266535F4D", 0.99), ("hfsplus", 1024, "482B", 0.95), ("hfsplus", 1024, "4858", 0.95),
]
#: Bytes that hold all magics.
PROBE = 65608


def filesystems(spark: SparkSession, volumes: DataFrame) -> DataFrame:
    """File systems by magic at each base, with confidences; volumes: source, base, data. The magics are eleven rows, so the join is broadcast.

    A FAT's label of eight bytes goes on with spaces or zeros.
    """
    magics = spark.createDataFrame(MAGICS, "filesystem string, at int, magic string, confidence double")
    met = F.hex(F.expr("substring(data, at + 1, octet_length(magic) div 2)")) == F.col("magic")
    label = F.hex(F.expr("substring(data, at + 6, 3)")).rlike("^((20|00)*)$")
    found = volumes.join(F.broadcast(magics), met).where(~F.col("filesystem").startswith("fat") | label)
    return found.select("source", "base", "filesystem", "confidence")


def filesystems_in(spark: SparkSession, space: tuple, partitions: DataFrame) -> DataFrame:
    """partition (null: the whole), base, filesystem and confidence at base 0 and at each partition that lies in the space.

    space: the arguments of evidence.Space; partitions: number, first_lba, in sectors of 512 bytes. Each base's first PROBE bytes are read.
    """
    bases = partitions.select(F.col("number").cast("long").alias("partition"), (F.col("first_lba").cast("long") * 512).alias("base"))
    bases = bases.unionByName(spark.createDataFrame([(None, 0)], "partition long, base long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Space(*space) as s:
            for b in batches:
                inside = b[(b["base"] >= 0) & (b["base"] < s.size)]
                for i in range(0, len(inside), 64):
                    some = inside[i : i + 64]
                    yield some.assign(data=[s.read(int(x), PROBE) for x in some["base"]])

    volumes = bases.mapInPandas(run, "partition long, base long, data binary").withColumn("source", F.to_json(F.struct("partition")))
    found = filesystems(spark, volumes)
    return found.select(F.get_json_object("source", "$.partition").cast("long").alias("partition"), "base", "filesystem", "confidence")
