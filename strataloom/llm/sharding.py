"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .ranks import gapless_rank

Shards = Sequence[tuple[int, float]]


def _bid(keys: Sequence[Column], shard: int, weight: float) -> Column:
    """(-ln u) / weight and the shard: the least bid wins, so a shard wins in proportion to its weight."""
    if not weight > 0:
        raise ValueError(f"shard {shard} has weight {weight}")
    u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("bid"), F.lit(int(shard)).alias("shard"))


def rendezvous(keys: Sequence[Column], shards: Shards) -> Column:
    """The shard of the least bid.

    The key values and the shards decide alone: a new shard takes rows only into
    itself, a removed one gives up only its own, and a changed weight moves the
    difference.  Null key columns hash as absent, so they share a shard.
    """
    bids = [_bid(keys, k, w) for k, w in shards]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign_shards(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of ``n_shards`` equal shards by its key.

    Columns: key, size (UTF-8 bytes of the text, none if null, and 8), text_crc32, law,
    shard, slot (gapless from 0 in the shard) and grown_shard (the shard with one shard more).
    Repeated rows get slots of their own; rows with a null key share a shard.  Other columns
    are ignored, an empty table gives an empty table.
    """
    shards = [(k, 1.0) for k in range(n_shards)]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    best = F.least(*(_bid([F.col(key)], *s) for s in shards)) if n_shards > 1 else _bid([F.col(key)], *shards[0])
    grown = F.least(best, _bid([F.col(key)], n_shards, 1.0))
    rows = docs.select(
        F.col(key), (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
        best["shard"].alias("shard"), grown["shard"].alias("grown_shard"),
    )
    ranked = gapless_rank(staged(rows, "shards"), "shard", [key, "text_crc32", "size"], "slot")
    return ranked.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def write_shards(rows: DataFrame, path: str, keys: Sequence[str], shards: Shards) -> None:
    """Write whole rows under ``path``/shard=<id>/, as many files a shard as its rows need.

    A shard is spread over writers by a hash of the keys, so a heavy one isn't one task's work.
    """
    placed = rows.withColumn("shard", rendezvous([F.col(k) for k in keys], shards))
    placed.write.partitionBy("shard").parquet(path)
