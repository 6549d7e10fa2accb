"""Bounds on what a Python worker holds at a time: of a batch from the JVM, and of its rows as Python objects."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes in an Arrow batch: Spark's default of 10,000 rows of long texts can exceed a worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Rows are handled in slices of about this many bytes, whatever the size of the Arrow batch.
SLICE_BYTES = 1 << 20


def batched(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes.

    The settings stay: a plan reads them when it runs, which may be after any call returns.
    """
    conf, name, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    if conf.get(size).rstrip("b") == str(64 << 20):  # Spark's default
        conf.set(size, BATCH_BYTES)
    return df


def cut(rows, limit: int = SLICE_BYTES) -> Iterator:
    """An Arrow array or batch in runs of as many rows as have about ``limit`` bytes on average; of none, nothing."""
    n = max(1, len(rows) * limit // max(1, rows.nbytes))
    for at in range(0, len(rows), n):
        yield rows.slice(at, n)


def release() -> None:
    """Hand memory that this worker has freed back to the system: idle workers live on beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
