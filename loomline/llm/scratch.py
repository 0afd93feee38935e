"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is
unset (local tests) does this module choose one of its own.  A table written
here cuts the lineage: a lost executor costs a re-read, not a recomputation,
and steps that look at a result twice don't compute it twice.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; where it names none, a new local one, if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise ValueError(f"spark.checkpoint.dir is not set: executors of {master} don't see a folder of the driver's machine")
        found = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(tables: list[DataFrame]) -> DataFrame:
    """Staged tables of one schema as one table, read by one scan."""
    first = tables[0]
    paths = sorted({f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()})
    return first.sparkSession.read.schema(first.schema).parquet(*paths) if len(tables) > 1 and paths else first


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended, and its folder with it
        return
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    files = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for entry in [x for x in _WRITTEN if any(f.endswith(x[1].split("://")[-1]) for f in files)]:
        _WRITTEN.remove(entry)
        _delete(*entry)


def mark() -> int:
    """A point that :func:`since` can look back to."""
    return len(_WRITTEN)


def since(point: int) -> list[tuple[SparkSession, str]]:
    """The tables staged after ``point``."""
    return _WRITTEN[min(point, len(_WRITTEN)) :]


def release_unread(tables: list[tuple[SparkSession, str]], df: DataFrame) -> list[tuple[SparkSession, str]]:
    """Delete those of ``tables`` that ``df`` doesn't read; gives the others."""
    files = df.inputFiles() if tables else []
    read = [t for t in tables if any(t[1].split("://")[-1] in f for f in files)]
    for entry in tables:
        if entry not in read and entry in _WRITTEN:
            _WRITTEN.remove(entry)
            _delete(*entry)
    return read


def release() -> None:
    """Delete all staged tables."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


atexit.register(release)
