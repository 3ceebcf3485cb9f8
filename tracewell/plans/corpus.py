"""Runs the expectations of a ground-truth corpus: the source's hash first, then each expected value."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, formats, frames, integrity
from ..sources import evidence, reports


def measure(spark: SparkSession, path: str, kind: str, parameters: dict) -> str | None:
    """The actual value of an expectation's kind."""
    chunks = evidence.read(spark, [path], chunk=int(parameters.get("chunk", 4 << 20)), overlap=64)
    if kind == "frame_count":
        return str(frames.carve(chunks, strict=bool(parameters.get("strict", True)), space=([path],)).count())
    if kind == "best_format":
        row = formats.default().report(chunks, space=([path],)).first()
        return row["plugin"] if row else None
    if kind == "size":
        return str(os.path.getsize(path))
    raise ValueError(f"unknown kind {kind}")


def run(spark: SparkSession, manifest: dict, root: str) -> DataFrame:
    """case, key, value, actual, reason, status of every expectation; a case whose hash differs has one failed row, an error its own."""
    cases = reports.check_manifest(manifest, root)
    expected, actual = [], []
    paths = sorted({os.path.join(root, c["source"]) for c in cases})
    hashed = {r["path"]: r["sha256"] for r in integrity.file_digests(spark, paths).collect()}  # a row a case
    for c in cases:
        path = os.path.join(root, c["source"])
        same = hashed[path] == c["source_sha256"]
        expected.append((c["case_id"], "source_sha256", "True"))
        actual.append((c["case_id"], "source_sha256", str(same)))
        for e in c.get("expectations", []) if same else []:
            expected.append((c["case_id"], e["kind"], str(e["expected"])))
            try:
                actual.append((c["case_id"], e["kind"], measure(spark, path, e["kind"], e.get("parameters", {}))))
            except (OSError, ValueError) as x:
                actual.append((c["case_id"], e["kind"], f"ERROR {x}"))
    schema = "case string, key string, value string"
    out = detect.expectations(spark.createDataFrame(expected, schema), spark.createDataFrame(actual, schema))
    return out.withColumn("status", F.when(F.col("actual").startswith("ERROR "), "ERROR").otherwise(F.col("status")))
