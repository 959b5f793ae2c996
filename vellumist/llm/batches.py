"""Bounded Arrow batches and slices of them, state kept from task to task, and memory handed back between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch of whole texts; it stands several times in the JVM and in Python, for each core.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lower the session's bound of an Arrow batch to so many bytes; the default is 64 MB. A smaller bound stays. Only sizes of batches change by it, never rows."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING, "64m"))
    if not 0 < size <= most:
        spark.conf.set(BATCH_SETTING, str(most))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of at most so many rows and bytes of a text column, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right"))
        upto = min(max(at + 1, upto), at + most_rows)
        yield batch.slice(at, upto - at)
        at = upto


_kept: dict[str, dict] = {}


def keep(operator: str | None = None) -> dict:
    """What an operator keeps in this worker process from task to task. What others kept is let go: workers are reused, and would hold the state of every operator of the session."""
    others = [name for name in _kept if name != operator]
    for name in others:
        del _kept[name]
    if others:
        hand_back()
    return _kept.setdefault(operator, {}) if operator else {}


def hand_back() -> None:
    """Give freed memory back to the system: a worker waits for its next task with what it holds, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
