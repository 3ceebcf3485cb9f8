"""Ranked detections, review rules and the other status ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_CONFIDENCE, LEAST_MARGIN = 0.60, 0.15


def ranked(detections: DataFrame) -> DataFrame:
    """detections (source, plugin, confidence) with rank by confidence, then plugin."""
    return detections.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "plugin")))


def report(detections: DataFrame, least: float = LEAST_CONFIDENCE, margin: float = LEAST_MARGIN) -> DataFrame:
    """Per source: best, runner-up, margin and requires_review. The two best are kept by a bounded aggregate, not a window."""
    pair = F.struct((-F.col("confidence")).alias("minus"), F.col("plugin"))
    # the best, then the best of the rest, each with partial sums
    best = detections.groupBy("source").agg(F.min(pair).alias("best"))
    rest = detections.join(best, "source").where(pair > F.col("best")).groupBy("source").agg(F.min(pair).alias("second"))
    out = best.join(rest, "source", "left")
    first, second = -F.col("best.minus"), F.coalesce(-F.col("second.minus"), F.lit(0.0))
    gap = first - second
    return out.select("source", F.col("best.plugin").alias("plugin"), first.alias("confidence"), F.col("second.plugin").alias("runner_up"), gap.alias("margin"), ((first < least) | ((second > 0) & (gap < margin))).alias("requires_review"))


def candidate_status(packets: str, size: str, reasons: str) -> F.Column:
    """FAIL without packets or bytes, REVIEW with any reason, else UNKNOWN: extraction alone never passes."""
    return F.when((F.col(packets) == 0) | (F.col(size) == 0), "FAIL").when(F.size(reasons) > 0, "REVIEW").otherwise("UNKNOWN")


def duration_status(actual: str, expected: str) -> F.Column:
    """FAIL beyond 2 % of the expected duration, REVIEW beyond 0.5 % or without one, else PASS."""
    off = F.abs(F.col(actual) - F.col(expected)) / F.col(expected)
    return F.when(F.col(expected).isNull() | (F.col(expected) <= 0) | F.col(actual).isNull(), "REVIEW").when(off > 0.02, "FAIL").when(off > 0.005, "REVIEW").otherwise("PASS")


def receipt_status(return_codes: str, complete: str, size: str, requested: str, hashed: str) -> F.Column:
    """COMPLETE if every pass ended with 0, the map is complete, all was captured and hashed; else REVIEW."""
    clean = ~F.exists(return_codes, lambda c: c != 0) & F.coalesce(F.col(complete), F.lit(False)) & (F.col(size) >= F.col(requested)) & F.col(hashed)
    return F.when(clean, "COMPLETE").otherwise("REVIEW")


def full_qc_status(clean: str, actual: str, expected: str, ambiguous: str) -> F.Column:
    """PASS only for a clean decode of the expected duration without ambiguity."""
    d = duration_status(actual, expected)
    return F.when(~F.col(clean) | (d == "FAIL"), "FAIL").when((d == "REVIEW") | F.col(ambiguous), "REVIEW").otherwise("PASS")


def fast_qc_status(windows: str, actual: str, expected: str) -> F.Column:
    """Of decoded windows: FAIL if one failed or the duration is far off, else REVIEW; a spot check never passes."""
    return F.when(F.exists(windows, lambda ok: ~ok) | (duration_status(actual, expected) == "FAIL"), "FAIL").otherwise("REVIEW")


def close_alternative(margin: str, most: float = 1.0) -> F.Column:
    return F.coalesce(F.col(margin) <= most, F.lit(False))


def expectations(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected (case, key, value) against actual (case, key, value): PASS, or FAIL with the reason."""
    a = actual.select("case", "key", F.col("value").alias("actual"), F.lit(True).alias("__has"))
    x = expected.join(a, ["case", "key"], "left")
    reason = F.when(F.col("__has").isNull(), F.concat(F.lit("missing "), "key")).when(~F.col("value").eqNullSafe(F.col("actual")), F.concat(F.lit("differs "), "key"))
    return x.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "PASS").otherwise("FAIL")).drop("__has")


def case_results(checked: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per case: FAIL at once if the source's hash differs, else FAIL if any expectation fails. hashes: case, hash_ok."""
    sums = checked.groupBy("case").agg(F.count_if(F.col("status") == "FAIL").alias("failed"), F.count(F.lit(1)).alias("checked"))
    return hashes.join(sums, "case", "left").select("case", F.when(F.col("hash_ok"), F.coalesce("failed", F.lit(0))).otherwise(0).alias("failed"), F.when(~F.col("hash_ok") | (F.col("failed") > 0), "FAIL").otherwise("PASS").alias("status"))


def recommendations(best: str, confidence: str, review: str, partitions: str) -> F.Column:
    """What to do next, by the evidence."""
    return F.array_compact(F.array(
        F.when(F.col(review), F.lit("compare the ranked formats before recovery")), F.when(F.col(confidence) == 0, F.lit("no known format: profile samples at other offsets")),
        F.when(F.col(confidence) > 0, F.concat(F.lit("scan as "), F.col(best))), F.when(F.col(partitions) > 0, F.lit("examine file systems too"))))


#: Ranks of what a format supports, in order: fixed values.
STAGES = ["detect", "profile", "scan", "recover", "validate"]
