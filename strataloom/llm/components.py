"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged

#: A label table of at most so many rows (16 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def _with_least(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Add to each pair (u, v) m, the least of u and all v of that u; also the staged table of these."""
    least = staged(pairs.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.min("u")).alias("m")), name)
    small = least.count() <= BROADCAST_ROWS
    return pairs.join(F.broadcast(least) if small else least, F.col("u") == F.col("w")).drop("w"), least


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, root): root is the least node reachable from node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges are stars around the least nodes, which takes a number of rounds
    logarithmic in the longest path.  Each step is an aggregation with partial
    sums and a join whose hot keys the adaptive skew join can split.  Edges
    stay distributed; the driver sees counts and checksums only, and a round's tables go once the next one's
    are there.  Nulls and loops are ignored, repeated edges are one, an empty list gives no rows.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = staged(edges.where("a is not null and b is not null and a <> b").select(a.alias("u"), b.alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, before = mark, now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, first = _with_least(both, "least")
        large = staged(starred.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low, second = _with_least(large, "least")
        small = low.select(F.col("u"), F.col("m").alias("v")).unionByName(low.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "small")
        discard(before, first, large, second)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
