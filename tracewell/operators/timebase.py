"""Clock models from anchors: Theil-Sen slopes and correction of recorder time."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import slopes

MOST_RESIDUAL, MOST_PPM = 2.0, 50_000.0
#: Anchors of one clock that a task holds; clocks with more are fitted one after another, each by jobs over all its anchors.
HELD = 1 << 16
EPOCH = "2000-01-01 00:00:00"
#: slope and intercept are null for a clock without an anchor that has both times.
MODEL = "slope double, intercept double, max_residual double, anchors long"


def _held(pdf: pd.DataFrame) -> tuple:
    x, y = pdf["x"].to_numpy(np.float64), pdf["y"].to_numpy(np.float64)
    slope = slopes.in_memory(x, y)
    slope = 1.0 if slope is None else slope
    intercept = float(np.median(y - slope * x))
    return slope, intercept, float(np.abs(y - intercept - slope * x).max()), len(x)


def _large(anchors: DataFrame, block: int | None) -> DataFrame:
    """The model of one clock, by passes over its anchors."""
    slope = slopes.distributed(anchors, block)
    slope = 1.0 if slope is None else slope
    intercept = slopes.middle(anchors.select((F.col("y") - F.lit(slope) * F.col("x")).alias("v")), "v")
    off = F.max(F.abs(F.col("y") - F.lit(intercept) - F.lit(slope) * F.col("x")))
    return anchors.agg(F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"), off.alias("max_residual"), F.count(F.lit(1)).alias("anchors"))


def fit(anchors: DataFrame, keys: list[str] | None = None, held: int = HELD, block: int | None = None) -> DataFrame:
    """Per key (none: one row): slope, intercept, drift_ppm, max_residual, anchors, status. anchors: keys, x and y in seconds.

    The slope is the exact median over pairs with different x; without any it is 1. A single anchor, a large residual or a large
    drift have REVIEW. Anchors without x or y are left out.
    """
    keys = keys or []
    a = anchors.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    counts = a.groupBy(*keys).count()
    large = counts.where(F.col("count") > held).select(*keys).collect() if keys else [()] if counts.first()[0] > held else []
    same = lambda k: functools.reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.lit(k[c])) for c in keys), F.lit(True))
    small = a if not large else a.where(~functools.reduce(lambda p, q: p | q, map(same, large))) if len(large) <= 64 else a.join(F.broadcast(anchors.sparkSession.createDataFrame(large, a.select(*keys).schema)), keys, "left_anti")
    schema = StructType([*a.select(*keys).schema.fields, *StructType.fromDDL(MODEL).fields])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *_held(pdf))], columns=schema.fieldNames())

    found = small.groupBy(*keys).applyInPandas(run, schema)
    for k in large:
        found = found.unionByName(_large(a.where(same(k)) if keys else a, block).select(*(F.lit(k[c]).cast(a.schema[c].dataType).alias(c) for c in keys), "*"))
    ppm = (F.col("slope") - 1) * 1e6
    review = (F.col("anchors") < 2) | (F.col("max_residual") > MOST_RESIDUAL) | (F.abs(ppm) > MOST_PPM)
    return found.select(*keys, "slope", "intercept", ppm.alias("drift_ppm"), "max_residual", "anchors", F.when(review, "REVIEW").otherwise("PASS").alias("status"))


def corrected(seconds: str, slope: float, intercept: float) -> F.Column:
    """UTC for seconds of recorder time since EPOCH; a derived value beside the native one."""
    micros = F.bround((F.lit(intercept) + F.lit(slope) * F.col(seconds)) * 1e6).cast("bigint")
    return F.timestamp_micros(F.unix_micros(F.lit(EPOCH + "+00:00").cast("timestamp")) + micros)
