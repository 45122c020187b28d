"""Shards and slots against an independent rendezvous."""

import math
import struct
import zlib
from collections import Counter

import xxhash

from strataloom.llm import ranks, sharding


def plain_shard(doc, weights):
    def bid(shard, weight):
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc), 42) if doc is not None else 42
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight, shard

    return min(bid(k, w) for k, w in weights)[1]


def test_shards_are_those_of_a_plain_version(spark, odd, real):
    for docs in (odd.select("doc_id", "text"), real.select("doc_id", "text")):
        rows = docs.collect()
        found = sharding.assign_shards(docs, 24).collect()
        want = Counter()
        for r in rows:
            body = (r.text or "").encode()
            want[r.doc_id, len(body) + 8, zlib.crc32(body), "key", plain_shard(r.doc_id, [(k, 1.0) for k in range(24)]), plain_shard(r.doc_id, [(k, 1.0) for k in range(25)])] += 1
        assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == want
        slots = {}
        for r in found:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weighted_shards(spark):
    from pyspark.sql import functions as F

    shards = [(3, 1.0), (7, 2.5), (9, 0.5)]
    rows = spark.range(5000).select("id", sharding.rendezvous([F.col("id")], shards).alias("s")).collect()
    assert all(r.s == plain_shard(r.id, shards) for r in rows)
    share = Counter(r.s for r in rows)
    assert all(abs(share[k] / 5000 - w / 4) < 0.03 for k, w in shards)


def test_repeated_rows_are_split(spark, monkeypatch):
    """Rows that are all alike are numbered by several tasks, without gaps."""
    monkeypatch.setattr(ranks, "LARGE", 500)
    rows = spark.createDataFrame([(1, None, "same")] * 3000 + [(1, i, "other") for i in range(200)] + [(None, 1, "x")] * 3, "k int, d long, t string").repartition(4)
    found = ranks.gapless_rank(rows, "k", ["d", "t"], "n")
    assert found.columns == ["k", "d", "t", "n"]
    got = {}
    for r in found.collect():
        got.setdefault(r.k, []).append(r.n)
    assert {k: sorted(v) for k, v in got.items()} == {1: list(range(3200)), None: [0, 1, 2]}
