"""Numbers that follow a global order, without putting the order into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def running_sum(rows: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before each one in ``order``, 0 for the first.

    Rows are dealt into ranges by ``order``, each range is summed on its own, and the ranges' totals, one row
    each, give where each starts.  ``order`` must tell rows apart for the result to be the same each time.  Columns
    named __part and __before are the helper's own.
    """
    dealt = staged(rows.withColumn(out, value.cast("bigint")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(F.sum(out).alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn(out, F.coalesce(F.sum(out).over(inside), F.lit(0)))
    joined = summed.join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return joined.withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__p", "__before")


#: Starts of groups, a row a group, of at most so many rows are broadcast.
BROADCAST_ROWS = 200_000
_ROWS = (1 << 33) - 1


def place_in_group(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: each row's place in its ``group`` in ``order``, from 0.

    All rows are numbered in one order, group by group, and each group's first number is taken off, so a group
    with most of the rows is no single task's work.  Nulls in ``group`` are a group.
    """
    placed = numbered(rows, [group, *order], "__place")
    starts = staged(placed.groupBy(F.col(group).alias("__s")).agg(F.min("__place").alias("__first")), "starts")
    few = starts.count() <= BROADCAST_ROWS
    joined = placed.join(F.broadcast(starts) if few else starts, F.col(group).eqNullSafe(F.col("__s")))
    return joined.withColumn(out, F.col("__place") - F.col("__first")).drop("__s", "__first", "__place")


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out``: each row's place in ``order``, from 0.

    Rows are dealt into sorted ranges and staged with their place in the range; the ranges' sizes, one row each, give where each
    starts.  ``order`` must tell rows apart for the result to be the same each time.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = staged(dealt, "ranges")
    part = F.shiftright("__at", 33)
    totals = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    joined = dealt.join(F.broadcast(starts), part == F.col("__part"))
    return joined.withColumn(out, F.col("__at").bitwiseAND(F.lit(_ROWS)) + F.col("__before")).drop("__at", "__part", "__before")
