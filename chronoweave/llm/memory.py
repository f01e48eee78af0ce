"""Bounds on the memory of Python workers, and of the JVM that feeds them.

Rows pass between the two in Arrow batches, whose buffers are native memory that
the JVM's allocator keeps, so a session's batches are bounded by bytes as soon as
an operator hands rows to Python; and a worker gives memory back when a task ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20


def bound_batches() -> None:
    """Lower the session's limit on a batch's bytes to BATCH_BYTES; a lower one stays."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        now = str(spark.conf.get(SETTING)).lower().rstrip("b")
        scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
        size = int(float(now[:-1]) * scale[now[-1]]) if now[-1:] in scale else int(now)
        if size > BATCH_BYTES:
            spark.conf.set(SETTING, str(BATCH_BYTES))


def release() -> None:
    """Return freed pages of Arrow's pool and of the C heap to the system; the latter where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, fed in batches of bounded bytes and with the memory given back when a task ends, so that idle workers don't hold the peak of their last task."""
    bound_batches()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
