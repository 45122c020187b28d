"""Bounded Arrow batches for the steps that leave the JVM."""

from __future__ import annotations

import contextlib
import ctypes
import re

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that one Arrow batch to a Python worker holds at most.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def _bytes(size: str) -> int:
    """A size as Spark writes it ("8m", "64kb", "1048576b", "-1") in bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit.removesuffix("b").removesuffix("i") if unit != "b" else "b"]


def bound_batches(spark: SparkSession) -> None:
    """Keep batches small, so long texts don't fill a worker; a smaller setting stays."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return a worker's freed memory to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)
