"""Scratch paths in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; in local mode without one, under a folder of our own."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="ledgerflow-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = f"file://{_own[app]}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once and read back: what follows reads them as often as it needs, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 1 << 20, n: int | None = None) -> DataFrame:
    """df in partitions of about `rows` rows, by keys or evenly, which adaptive execution leaves apart; n: how many rows there are, where that is known."""
    n = df.count() if n is None else n
    return df.repartition(max(8, -(-n // rows)), *keys)


def clear(spark: SparkSession) -> None:
    """Remove what this application wrote as scratch; for long-lived sessions, once their results are written."""
    removed(spark, scratch(spark, "x").rpartition("/")[0])


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
