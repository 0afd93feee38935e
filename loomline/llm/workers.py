"""Memory of Python workers: small batches, and what a partition has used goes back to the system."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Documents in an Arrow batch, and their bytes, a longer document being a batch of its own.
#: Spark's defaults hold tens of megabytes of text, several times over, for each task.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Settings of a batch's size: the key, Spark's default, ours.
_SIZES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b"))


def small_batches(spark: SparkSession) -> None:
    """Let the session send documents in batches of BATCH_ROWS and BATCH_BYTES, unless it has sizes of its own."""
    for key, default, ours in _SIZES:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives its memory back when a partition is done; Spark keeps workers for the next."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped
