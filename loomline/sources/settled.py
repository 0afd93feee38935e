"""Intermediate results as tables in the folder that driver and executors share.

What several steps look at is written once and read again: plans stay short, a
lost executor costs a re-read, and nothing is kept in executors' memory.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a new local one, if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir is not set: executors of {master} don't see a folder of the driver's machine")
        found = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(rows: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/loomline-{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def release() -> None:
    """Delete all settled tables of sessions that still run."""
    while _TABLES:
        spark, path = _TABLES.pop()
        if spark.sparkContext._jsc is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(release)
