"""Gapless numbering inside groups without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: A bucket of more rows than this holds repeated rows above all and is split by row number.
LARGE = 100_000


def gapless_rank(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each ``key`` 0, 1, 2, ... in column ``out``.

    ``key`` must have a bounded number of values (lengths, shards): its counts
    are one small broadcast table.  A group of c rows is dealt by a hash of
    ``order`` into about sqrt(c) buckets; each bucket is numbered on its own,
    and the bucket sizes, summed in front of it, give its start.  So no task
    holds more than about sqrt(c) rows of a group, even if one group holds a
    third of the table.  Rows alike in ``order`` share a bucket; one of more than LARGE rows is split further by the
    rows' numbers.  Else the numbering depends on the values in ``key`` and ``order``
    alone; rows alike in both are interchangeable.

    ``rows`` is read several times: stage it first.  Nulls in ``key`` are
    a group of their own; an empty table gives an empty table.
    """
    counts = rows.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__c"))
    spread = rows.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(counts), F.col(key).eqNullSafe(F.col("__k")), "left")
    buckets = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("__c").cast("double")))).cast("long")
    spread = spread.withColumn("__b", F.pmod(F.xxhash64(*order), buckets)).drop("__c")
    sizes = staged(spread.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("__n")), "buckets")
    large = sizes.where(F.col("__n") > LARGE).select(F.col("__k").alias("__lk"), F.col("__b").alias("__lb"), F.ceil(F.col("__n") / LARGE).alias("__parts"))
    if large.isEmpty():
        spread = spread.withColumn("__s", F.lit(0).cast("long"))
        parts = sizes.withColumn("__s", F.lit(0).cast("long"))
    else:  # at most one such bucket for every LARGE rows
        marked = spread.join(large, F.col("__k").eqNullSafe(F.col("__lk")) & (F.col("__b") == F.col("__lb")), "left")
        spread = marked.withColumn("__s", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("__parts")), F.lit(0).cast("long"))).drop("__lk", "__lb", "__parts")
        parts = spread.groupBy("__k", "__b", "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__k").orderBy("__b", "__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("__k").alias("__sk"), F.col("__b").alias("__sb"), F.col("__s").alias("__ss"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy("__k", "__b", "__s").orderBy(*order)
    numbered = spread.withColumn("__i", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, F.col("__k").eqNullSafe(F.col("__sk")) & (F.col("__b") == F.col("__sb")) & (F.col("__s") == F.col("__ss")))
    return joined.withColumn(out, F.col("__start") + F.col("__i")).drop("__k", "__b", "__s", "__i", "__sk", "__sb", "__ss", "__start", "__row")
