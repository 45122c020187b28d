"""Bounds of Arrow batches."""

import pytest

from strataloom.llm import arrow


@pytest.mark.parametrize(("size", "want"), [("8m", 8 << 20), ("64kb", 64 << 10), ("1048576b", 1 << 20), ("-1", -1), ("1g", 1 << 30), ("256MB", 256 << 20), ("0", 0)])
def test_sizes_as_spark_writes_them(size, want):
    assert arrow._bytes(size) == want


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, kept in (("4m", "4m"), ("1g", str(arrow.BATCH_BYTES)), ("2000000000b", str(arrow.BATCH_BYTES))):
            spark.conf.set(name, given)
            arrow.bound_batches(spark)
            assert spark.conf.get(name) == kept
    finally:
        spark.conf.set(name, before)
