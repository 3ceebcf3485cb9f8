"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers that share this file system import the package; on a cluster it is installed or sent with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that executors read at the same path, removed when the driver ends: below spark.checkpoint.dir, or on a local master, if that is unset, a temporary one."""
    url = spark.conf.get("spark.checkpoint.dir", None)
    if url is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    at = urlsplit(url or tempfile.gettempdir())
    if at.scheme not in ("", "file"):
        raise ValueError(f"byte spaces are files of a mounted folder, not {url}")
    path = os.path.join(at.path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it is computed once, its lineage is cut, and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
