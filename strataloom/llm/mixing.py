"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .names import own

#: A table of sources of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Means above this are sums of equal Poisson parts, so that no probability underflows.
PART_MEAN = 32.0


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 of the parts, as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """source and rate, the mean number of copies that gives each source its share of characters.

    ``weights`` are relative; None gives all sources found the same weight, and a source
    that isn't named weighs 0.  The whole output has ``epochs`` times the input's characters.  Sizes count
    all documents; an empty text counts as one character, so no source is of size 0.
    """
    size = F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(1)).cast("bigint")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        weight = F.coalesce(F.create_map(*pairs)[F.coalesce("source", F.lit(""))], F.lit(0.0)) if pairs else F.lit(0.0)
    weighed = staged(sizes.withColumn("weight", weight), "sources")
    total = weighed.agg(F.sum("size"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(total[1] or 1.0))
    return weighed.select("source", (F.lit(float(epochs)) * share * F.lit(float(total[0] or 0)) / F.col("size")).alias("rate"))


def _distribution(rate: DataFrame) -> DataFrame:
    """To each source: parts, and the cumulative Poisson probabilities of one part's mean."""
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / PART_MEAN).cast("double"))
    by = rate.withColumn("parts", parts.cast("int")).withColumn("mean", F.col("rate") / parts)
    most = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int")
    steps = by.select("source", "rate", "parts", "mean", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    log_factorial = F.aggregate(F.when(F.col("k") > 0, F.sequence(F.lit(1), F.col("k"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))
    p = F.when(F.col("mean") > 0, F.exp(F.col("k") * F.log("mean") - F.col("mean") - log_factorial)).otherwise((F.col("k") == 0).cast("double"))
    up = Window.partitionBy("source").orderBy("k")
    summed = steps.withColumn("p", p).select("source", "rate", "parts", F.struct("k", F.sum("p").over(up).alias("c")).alias("s"))
    return summed.groupBy("source", "rate", "parts").agg(F.sort_array(F.collect_list("s"))["c"].alias("cumulative"))


def replicate(docs: DataFrame, rate: DataFrame, seed: int = 0, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row of ``docs`` as often as its Poisson draw says, in one global random order.

    The draw inverts the Poisson distribution with the source's rate at a hash
    of ``seed`` and the row's key, so it is the same in every run and in any
    partitioning; rows with the same key draw alike.  Adds copies, copy (0 to
    copies - 1) and shuffle_key, by whose hash the copies are dealt to partitions and by
    which they are sorted there.  A null source is a source like any other, a null key
    draws once for all its rows; an empty table stays empty.  Columns of
    ``docs`` with the names of the added ones are replaced, all others stay.
    """
    of, parts, cumulative = own(docs.columns, "__source", "__parts", "__cumulative")
    spread = _distribution(rate).select(F.col("source").alias(of), F.col("parts").alias(parts), F.col("cumulative").alias(cumulative))
    table = staged(spread, "rates")
    small = table.count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(table) if small else table, F.col(source).eqNullSafe(F.col(of)))
    who = F.coalesce(F.col(key).cast("string"), F.lit(""))
    drawn = F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda j: uniform(F.lit(seed), who, j))  # once, before the search
    draws = F.transform(drawn, lambda u: F.size(F.filter(cumulative, lambda c: c <= u)))
    copies = F.aggregate(draws, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    some = joined.withColumn("copies", copies).where("copies > 0").drop(of, parts, cumulative)
    each = some.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    marked = each.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed).cast("string"), who, F.col("copy").cast("string")).cast("binary")))
    return marked.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
