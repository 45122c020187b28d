"""Exact nearest neighbours of many queries at once, over vectors that are kept by pivots.

An index deals unit vectors to the nearest of some pivots and sorts each pivot's rows by their distance from it,
so a file's row groups hold narrow ranges of distances.  By the triangle inequality a vector x within r of a query
q lies no nearer to and no farther from a pivot p than |q - p| - r and |q - p| + r.  A search takes r from each query's own
nearest pivot first, and then reads only the ranges that may hold a nearer vector; what it returns is what a
scan of all vectors would.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged

#: Pivots for so many vectors each, and at most; rows of a parquet row group, about, so bounds can skip them.
ROWS_A_PIVOT, MOST_PIVOTS, GROUP_BYTES = 4096, 4096, 1 << 20
#: Queries that are searched for at once; more go in turns.
QUERIES_AT_ONCE = 4096
#: Slack for rounding in distances of unit vectors; similarities that are the same in so many digits are equal; conditions of a scan at most.
SLACK, DIGITS, MOST_CONDITIONS = 1e-6, 12, 128
_ROW = "pivot int, away double, id bigint, unit array<double>"


@dataclass(frozen=True)
class PivotIndex:
    """Where the rows are, and the pivots, one a row."""

    spark: SparkSession
    path: str
    pivots: np.ndarray


def _units(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(vector: Column) -> Column:
    """The vector at length 1 in doubles; null if it is null, empty, zero, or holds what isn't a finite number."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bound = F.transform(F.array(F.struct(wide.alias("v"), F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)).alias("n"))), lambda s: F.when((s["n"] > 0) & (s["n"] < float("inf")), F.transform(s["v"], lambda x: x / s["n"])))
    return F.element_at(bound, 1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of unit vectors, all pairs."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def build(vectors: DataFrame, path: str, id_: str = "id", vector: str = "embedding", pivots: int | None = None) -> PivotIndex:
    """Write the index of ``vectors`` (with integer ids) at ``path``.

    Pivots are a sample by the hash of the id; which vectors they are changes only how much a search reads.  Vectors that are null, zero or not
    finite have no direction and aren't kept; all others must have the same length.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_).cast("bigint").alias("id"), _unit(F.col(vector)).alias("unit")).where("unit is not null")
    many = pivots or max(1, min(MOST_PIVOTS, -(-vectors.count() // ROWS_A_PIVOT)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(many).select("unit").toPandas()["unit"]  # at most MOST_PIVOTS rows
    centres = np.array([np.asarray(u) for u in chosen], np.float64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(_units(batch.column("unit")), centres)
                nearest = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(away[np.arange(len(nearest)), nearest]), batch.column("id"), batch.column("unit")], names=["pivot", "away", "id", "unit"])

    placed = rows.mapInArrow(place, _ROW) if len(centres) else spark.createDataFrame([], _ROW)
    dealt = placed.repartitionByRange("pivot", "away", "id").sortWithinPartitions("pivot", "away", "id")
    dealt.write.mode("overwrite").option("parquet.block.size", str(GROUP_BYTES)).parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(centres.tolist()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/pivots")
    return PivotIndex(spark, path, centres)


def opened(spark: SparkSession, path: str) -> PivotIndex:
    return PivotIndex(spark, path, np.array(json.loads(spark.read.text(f"{path}/pivots").first().value), np.float64))


def _scored(rows: DataFrame, queries: np.ndarray, numbers: np.ndarray, bounds: np.ndarray | None, index: PivotIndex, k: int) -> DataFrame:
    """(query, id, similarity): of each task the ``k`` nearest rows of each query, of those that the query's bounds leave."""
    shared = index.spark.sparkContext.broadcast((queries, numbers, bounds, _distances(queries, index.pivots) if len(index.pivots) else np.zeros((len(queries), 0))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names, most, to_pivots = shared.value
        best_s, best_i = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            units, ids = _units(batch.column("unit")), np.asarray(batch.column("id"))
            pivot, away = np.asarray(batch.column("pivot")), np.asarray(batch.column("away"))
            for a in range(0, len(q), 256):
                b = min(a + 256, len(q))
                near = np.round(units @ q[a:b].T, DIGITS)
                if most is not None:  # rows that can't be among the nearest
                    near = np.where(np.abs(to_pivots[a:b][:, pivot].T - away[:, None]) <= most[a:b] + SLACK, near, -2.0)
                s, i = np.concatenate([best_s[a:b], near.T], 1), np.concatenate([best_i[a:b], np.broadcast_to(ids, (b - a, len(ids)))], 1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                part_s, part_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                if a == 0:
                    new_s, new_i = [part_s], [part_i]
                else:
                    new_s.append(part_s)
                    new_i.append(part_i)
            best_s, best_i = np.concatenate(new_s), np.concatenate(new_i)
        some = best_s > -1.5
        rows_, _ = np.nonzero(some)
        yield pa.RecordBatch.from_arrays([pa.array(names[rows_]), pa.array(best_i[some]), pa.array(best_s[some])], names=["query", "id", "similarity"])

    found = rows.mapInArrow(search, "query bigint, id bigint, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def ranges(index: PivotIndex, queries: np.ndarray, bounds: np.ndarray) -> Column:
    """The rows that any of the queries may need, as a condition on pivot and away that a scan can push down."""
    to_pivots = _distances(queries, index.pivots)
    low, high = (to_pivots - bounds[:, None]).min(axis=0) - SLACK, (to_pivots + bounds[:, None]).max(axis=0) + SLACK
    need = np.flatnonzero(low <= 2.0)
    out = F.lit(False)
    for part in np.array_split(need, min(len(need), MOST_CONDITIONS)) if len(need) else []:
        where = F.col("pivot").between(int(part[0]), int(part[-1])) if len(part) > 1 else F.col("pivot") == int(part[0])
        out = out | (where & F.col("away").between(float(max(low[part].min(), 0.0)), float(high[part].max())))
    return out


def nearest(index: PivotIndex, queries: DataFrame, k: int = 10, key: str = "query", vector: str = "vector") -> DataFrame:
    """key, place (from 1), id and similarity (cosine) of the ``k`` nearest rows of each query; equal ones by id.

    ``queries`` is a stated set, taken in turns of about QUERIES_AT_ONCE.  Queries without a direction have no rows, keys may repeat or be null.
    """
    asked = staged(queries.select(F.col(key).alias("key"), _unit(F.col(vector)).alias("unit"), F.monotonically_increasing_id().alias("n")).where("unit is not null"), "queries")
    rows = index.spark.read.schema(_ROW).parquet(f"{index.path}/rows")
    turns, out = -(-asked.count() // QUERIES_AT_ONCE) if len(index.pivots) else 0, None
    for turn in range(turns):
        some = asked.where(F.pmod(F.xxhash64("n"), F.lit(turns)) == turn).select("n", "unit").toArrow()  # about QUERIES_AT_ONCE rows
        numbers = np.asarray(some.column("n").combine_chunks()).astype(np.int64)
        if not len(numbers):
            continue
        part = _units(some.column("unit").combine_chunks())
        home = _distances(part, index.pivots).argmin(axis=1)
        first = _scored(rows.where(F.col("pivot").isin(sorted(set(home.tolist())))), part, numbers, None, index, k)
        far = {r["query"]: r.similarity for r in first.where(F.col("place") == k).select("query", "similarity").collect()}  # a row a query
        bounds = np.array([np.sqrt(max(0.0, 2.0 - 2.0 * far[n])) if n in far else 2.0 for n in numbers.tolist()])
        found = _scored(rows.where(ranges(index, part, bounds)), part, numbers, bounds, index, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = index.spark.createDataFrame([], "query bigint, id bigint, similarity double, place int")
    return out.join(asked.select("n", "key"), F.col("query") == F.col("n")).select(F.col("key").alias(key), F.col("place"), "id", "similarity")
