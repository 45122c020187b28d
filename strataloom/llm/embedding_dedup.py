"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so cosine 0.95 is a distance.  Each of several tables has a key of several
quantised Gaussian projections, floor((a.v + b) / w); near vectors share a key in some table with a
probability that the numbers of tables and projections set.  Keys travel with ids and sketches (the signs of 64 more
projections), not with vectors: of vectors with a key in common those are candidates whose
sketches differ as little as near ones' do, and only they are fetched and compared by exact
cosine in double precision.

Pairs inside a dense group aren't listed: in a few tables each key's vectors are first checked against one of them,
and then only pairs of different groups are candidates.  Linked vectors
lie in the same component, so each component's exact comparison, in blocks, counts all
links, also those between vectors that no table brought together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .arrow import bound_batches
from .blocks import candidate_pairs, candidate_stars, deal, runs, whole_groups
from .components import components

#: Width of a quantisation step, the chance to miss a pair at the threshold by keys and by sketches, and the seed of the projections.
WIDTH, MISS, SKETCH_MISS, SEED = 2.0, 1e-4, 2e-5, 7
#: Unrelated vectors that share a vector's key in a table, about.
MATES = 16
#: Tables of each of the rounds that check a key's vectors against one of them.
STAR_TABLES = 6


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that two vectors at ``distance`` share one quantised projection (Datar et al., 2004)."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Projections a key and tables: MATES unrelated vectors share a key, pairs at the threshold are missed with chance MISS."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n / MATES, 2)) / math.log(1 / far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near**k))


def most_apart(threshold: float) -> int:
    """The bits of 64 by which the sketches of vectors at the threshold differ, exceeded with chance SKETCH_MISS."""
    p, left = math.acos(threshold) / math.pi, 1.0
    for c in range(65):
        left -= math.comb(64, c) * p**c * (1 - p) ** (64 - c)
        if left <= SKETCH_MISS:
            return c
    return 64


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as float64 rows."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _by_width(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one length."""
    lengths = np.asarray(batch.column(name).value_lengths())
    for d in np.unique(lengths):
        yield batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))


def _sketched(vectors: DataFrame) -> DataFrame:
    """Add sketch to (id, v, ...)."""
    names = vectors.columns

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in _by_width(whole, "v"):
                rows = _matrix(batch.column("v"))
                if not len(rows):
                    continue
                d = rows.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d, 1]).standard_normal((d, 64))
                bits = np.packbits((_unit(rows) @ planes[d]) >= 0, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ascontiguousarray(bits).view(np.int64).ravel())], names=[*names, "sketch"])

    return vectors.mapInArrow(signs, _schema(vectors) + ", sketch bigint")


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _keys(nodes: DataFrame, per_key: int, tables: int, first: int, last: int) -> DataFrame:
    """key, id, sketch and grp for the tables ``first`` to ``last``; keys of different tables or vector lengths differ."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for whole in batches:
            for batch in _by_width(whole, "v"):
                rows = _matrix(batch.column("v"))
                if not len(rows):
                    continue
                d = rows.shape[1]
                if d not in held:
                    rng = np.random.default_rng([SEED, d])
                    planes, shifts = rng.standard_normal((d, per_key * tables)), rng.random(per_key * tables) * WIDTH
                    odd, start = rng.integers(1, 1 << 62, (tables, per_key), dtype=np.int64) * 2 + 1, rng.integers(1, 1 << 62, tables, dtype=np.int64)
                    held[d] = np.ascontiguousarray(planes[:, first * per_key : last * per_key]), shifts[first * per_key : last * per_key], odd[first:last], start[first:last]
                planes, shifts, odd, start = held[d]
                for i in range(0, len(rows), 256):
                    part = batch.slice(i, 256)
                    steps = np.floor((_unit(rows[i : i + 256]) @ planes + shifts) / WIDTH).astype(np.int64).reshape(-1, last - first, per_key)
                    key = (steps * odd).sum(axis=2) + start
                    key ^= key >> np.int64(31)
                    owner = pa.array(np.repeat(np.arange(len(steps)), last - first))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(part.column(c).take(owner) for c in ("id", "sketch", "grp"))], names=["key", "id", "sketch", "grp"])

    return nodes.select("id", "v", "sketch", "grp").mapInArrow(hashed, "key bigint, id bigint, sketch bigint, grp bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The groups (a, b) of the pairs (a, b) whose vectors are near enough."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_width(batch, "va"):
                part = part.filter(pa.array(np.asarray(part.column("va").value_lengths()) == np.asarray(part.column("vb").value_lengths())))
                if part.num_rows:
                    good = (_unit(_matrix(part.column("va"))) * _unit(_matrix(part.column("vb")))).sum(axis=1) >= threshold
                    yield pa.RecordBatch.from_arrays([part.column("ga").filter(pa.array(good)), part.column("gb").filter(pa.array(good))], names=["a", "b"])

    ends = pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).distinct()
    met = nodes.join(ends, F.col("id") == F.col("e"), "left_semi")  # only these vectors move
    x, y = (met.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"), F.col("grp").alias(f"g{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("va", "vb", "ga", "gb").mapInArrow(near, "a bigint, b bigint").distinct()


def _regrouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the groups that ``links`` (a, b) join made one."""
    found = staged(components(links), "joined")
    small = found.count() <= 200_000
    return staged(nodes.join(F.broadcast(found) if small else found, F.col("grp") == F.col("node"), "left").withColumn("grp", F.coalesce("root", "grp")).drop("node", "root"), "grouped")


def _counts(rows: DataFrame, threshold: float) -> DataFrame:
    """id and the copies of other vectors of its component that it is linked to."""
    by = ["root", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, by):
            ids, side = np.asarray(batch.column("id")), batch.column("side").to_numpy(zero_copy_only=False)
            copies, linked = np.asarray(batch.column("copies")).astype(np.float64), np.zeros(batch.num_rows)
            for a, b in runs(batch, by):
                v, s, w = _unit(_matrix(batch.column("v").slice(a, b - a))), side[a:b], copies[a:b]
                if s.any():
                    left, right = np.flatnonzero(~s), np.flatnonzero(s)
                    near = v[left] @ v[right].T >= threshold
                    linked[a + left] += near @ w[right]
                    linked[a + right] += w[left] @ near
                elif np.asarray(batch.column("lo"))[a] == np.asarray(batch.column("hi"))[a]:
                    near = v @ v.T >= threshold
                    np.fill_diagonal(near, False)
                    linked[a:b] += near @ w
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked.astype(np.int64))], names=["id", "linked"])

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "id bigint, linked bigint").groupBy("id").agg(F.sum("linked").alias("linked"))


def _valid(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, n_links, component_id and kept of every row.

    Rows at cosine ``threshold`` or more, in double precision, are linked; component_id is the least key reachable.
    Vectors that are null, empty, zero or hold null or non-finite numbers link with
    nothing; neither do vectors of different lengths.  Equal vectors, repeated rows too, are
    compared once and counted as often as they occur.  Rows with a null key have links like others but aren't the least
    unless no key is there (then component_id is null).  An empty
    table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = "array<float>" if vectors.schema[column].dataType.simpleString() == "array<float>" else "array<double>"
    rows = staged(vectors.select(F.col(key).cast("bigint").alias("vec"), F.col(column).cast(kind).alias("v")).withColumn("valid", _valid(F.col("v"))), "vectors")
    distinct = rows.where("valid").groupBy("v").agg(F.min("vec").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(_sketched(distinct.withColumn("id", F.monotonically_increasing_id())).withColumn("grp", F.col("id")), "nodes")
    (per_key, tables), most = plan(nodes.count(), threshold), most_apart(threshold)
    for turn in range(3):
        star = turn < 2
        first, last = (turn * STAR_TABLES, (turn + 1) * STAR_TABLES) if star else (0, tables)
        first, last = min(first, tables), min(last, tables)
        if first == last:
            continue
        keyed = _keys(nodes, per_key, tables, first, last)
        pairs = candidate_stars(keyed, most) if star else candidate_pairs(keyed, most)
        nodes = _regrouped(nodes, _verified(pairs, nodes, threshold))
    sizes = staged(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("component")), "sizes")
    several = sizes.where("n > 1").select(F.col("grp").alias("root"), "n")
    members = nodes.join(several.select(F.col("root").alias("r")), F.col("grp") == F.col("r"), "left_semi").select("id", "v", "copies", F.col("grp").alias("root"))
    counted = staged(_counts(deal(members, several, "root"), threshold), "counted")
    about = nodes.join(counted.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left").join(sizes.select(F.col("grp").alias("g"), "component"), F.col("grp") == F.col("g"))
    about = staged(about.select(F.col("v").alias("dv"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"), "linked")
    joined = rows.where("valid").join(about, F.col("v") == F.col("dv"), "left").select("vec", "links", "component")
    every = joined.unionByName(rows.where("not valid").select("vec", F.lit(0).cast("bigint").alias("links"), F.col("vec").alias("component")))
    return every.select(F.col("vec").alias(key), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.col("component").alias("component_id"), F.col("vec").eqNullSafe(F.col("component")).alias("kept"))
