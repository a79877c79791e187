"""Arrow kernels: the one place where batches are bounded and Python functions are applied to them."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch that goes to a Python worker. Long rows stay whole: a batch holds one row at least.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings, changed within the block only."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def limit_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that a worker holds a few megabytes at a time. Limits that the user has set stay.

    The limits are read when a plan runs, so they must outlast the call that makes it.
    """
    for key, value in LIMITS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow under the batch limits. A worker gives back what it has freed when its task ends."""
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system, so that idle workers, which are kept for later tasks, don't hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
