"""Text and JSON inputs: acquisition maps, SMART reports, profile packs and corpus manifests."""

from __future__ import annotations

import hashlib
import json
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a line of a GNU ddrescue map: position, size, status.
_LINE = r"^\s*(0[xX][0-9a-fA-F]+|[0-9]+)\s+(0[xX][0-9a-fA-F]+|[0-9]+)\s+([?*/+-])\s*$"


def mapfile(spark: SparkSession, path: str) -> DataFrame:
    """source, pos, size, status of a ddrescue map's blocks; comments, the status line and empty blocks are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value")
    number = lambda i: F.when(F.regexp_extract("value", _LINE, i).rlike("^0[xX]"), F.conv(F.substring(F.regexp_extract("value", _LINE, i), 3, 32), 16, 10)).otherwise(F.regexp_extract("value", _LINE, i)).cast("bigint")
    found = lines.where(F.col("value").rlike(_LINE) & ~F.col("value").startswith("#"))
    return found.select("source", number(1).alias("pos"), number(2).alias("size"), F.regexp_extract("value", _LINE, 3).alias("status")).where("size > 0")


SMART = "model_name string, serial_number string, user_capacity struct<bytes:bigint>, ata_smart_attributes struct<table:array<struct<id:int,raw:struct<value:bigint>>>>"
#: SMART attributes of failing sectors by id: fixed values.
ATTRIBUTES = {5: "reallocated", 9: "power_on_hours", 187: "uncorrectable", 197: "pending", 198: "offline_uncorrectable"}


def smart(reports: DataFrame) -> DataFrame:
    """Model, serial, capacity and sector attributes of smartctl's JSON (key, json)."""
    x = reports.withColumn("s", F.from_json("json", SMART))
    value = lambda i: F.try_element_at(F.filter("s.ata_smart_attributes.table", lambda a: a["id"] == i), F.lit(1))["raw"]["value"]
    return x.select("key", F.col("s.model_name").alias("model"), F.col("s.serial_number").alias("serial"), F.col("s.user_capacity.bytes").alias("capacity"), *(value(i).alias(n) for i, n in ATTRIBUTES.items()))


def check_manifest(manifest: dict, root: str) -> list[dict]:
    """The cases of a corpus manifest; versions, ids and paths that leave root, or go through links, are errors."""
    if manifest.get("schema_version") != 1 or not isinstance(manifest.get("cases"), list):
        raise ValueError("not a corpus manifest of this version")
    seen: set[str] = set()
    for c in manifest["cases"]:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,79}", c.get("case_id", "")) or c["case_id"] in seen:
            raise ValueError("case ids must be plain and unique")
        seen.add(c["case_id"])
        path = os.path.join(root, c["source"])
        if os.path.isabs(c["source"]) or os.path.islink(path) or os.path.commonpath([os.path.realpath(root), os.path.realpath(path)]) != os.path.realpath(root):
            raise ValueError(f"{c['source']} leaves the corpus")
        if not re.fullmatch("[0-9a-f]{64}", c.get("source_sha256", "")):
            raise ValueError("a case needs the SHA-256 of its source")
    return manifest["cases"]


def audit_log(spark: SparkSession, path: str, chain: str = "audit") -> DataFrame:
    """A hash-chained JSONL log as chain, seq, prev_hash, entry_hash and recomputed, for `integrity.verify_chain`.

    An entry's hash is SHA-256 of its canonical JSON without entry_hash. Lines that aren't JSON objects are entries
    without a number, and so are bad.
    """
    def recompute(lines: pd.Series) -> pd.DataFrame:
        out = []
        for line in lines:
            try:
                e = json.loads(line)
                stated = e.pop("entry_hash", None)
                text = json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
                out.append((int(e["seq"]), e.get("prev_hash"), stated, hashlib.sha256(text.encode()).hexdigest()))
            except (ValueError, KeyError, TypeError, AttributeError):
                out.append((None, None, None, ""))
        return pd.DataFrame(out, columns=["seq", "prev_hash", "entry_hash", "recomputed"]).astype({"seq": "Int64"})

    f = F.pandas_udf(recompute, "seq long, prev_hash string, entry_hash string, recomputed string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.lit(chain).alias("chain"), f("value").alias("e")).select("chain", F.coalesce("e.seq", F.lit(0)).alias("seq"), "e.prev_hash", "e.entry_hash", "e.recomputed")


def jobs(table: DataFrame, status: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """The newest jobs with a status and kind, if given."""
    if not 1 <= limit <= 10_000:
        raise ValueError("1 to 10000 jobs")
    for column, value in (("status", status), ("kind", kind)):
        if value is not None:
            table = table.where(F.col(column) == value)
    return table.orderBy(F.desc("created"), F.desc("job_id")).limit(limit)
