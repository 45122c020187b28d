"""Nearest neighbours by pivots against a scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import pivots


def plain(vectors, queries, k):
    out = []
    for name, q in queries:
        if q is None or not np.isfinite(q).all() or not np.any(q):
            continue
        q = np.array(q) / np.linalg.norm(q)
        sims = [(-round(float(np.dot(np.array(v) / np.linalg.norm(v), q)), pivots.DIGITS), i) for i, v in vectors if v is not None and np.isfinite(v).all() and np.any(v)]
        out += [(name, p, i, -s) for p, (s, i) in enumerate(sorted(sims)[:k], 1)]
    return sorted(out, key=str)


def got(found, key="query"):
    return sorted(((r[key], r.place, r.id, r.similarity) for r in found.collect()), key=str)


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(x[3] == pytest.approx(y[3], abs=1e-9) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 16))
    points = [(i, (centres[i % 8] + rng.normal(scale=0.2, size=16)).tolist()) for i in range(3000)]
    points += [(5000 + i, points[i][1]) for i in range(30)]  # copies: equal ones go by id
    points += [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [float("inf")] * 16), (6004, []), (10, points[3][1])]
    queries = [(f"q{i}", points[i * 37][1]) for i in range(40)] + [("far", rng.normal(size=16).tolist()), ("none", None), ("zero", [0.0] * 16), (None, points[0][1])]
    return points, queries


@pytest.mark.parametrize("k", [1, 7])
def test_nearest_are_those_of_a_scan(spark, rows, tmp_path, k, monkeypatch):
    monkeypatch.setattr(pivots, "QUERIES_AT_ONCE", 17)
    points, queries = rows
    vectors = spark.createDataFrame(points, "id long, embedding array<double>").repartition(3)
    index = pivots.build(vectors, str(tmp_path / "i"), pivots=16)
    asked = spark.createDataFrame(queries, "query string, vector array<double>")
    usable = [(i, v) for i, v in points if v]
    same(got(pivots.nearest(index, asked, k)), plain(usable, queries, k))
    again = pivots.opened(spark, str(tmp_path / "i"))
    same(got(pivots.nearest(again, asked.limit(3), k)), plain(usable, queries[:3], k))


def test_few_vectors_and_none(spark, rows, tmp_path):
    points, queries = rows
    some = spark.createDataFrame(points[:3], "id long, embedding array<double>")
    asked = spark.createDataFrame(queries, "query string, vector array<double>")
    same(got(pivots.nearest(pivots.build(some, str(tmp_path / "a")), asked, 10)), plain(points[:3], queries, 10))
    assert pivots.nearest(pivots.build(some.limit(0), str(tmp_path / "b")), asked).count() == 0
    assert pivots.nearest(pivots.opened(spark, str(tmp_path / "a")), asked.limit(0)).count() == 0


def test_ranges_spare_most_of_the_rows(spark, rows, tmp_path, monkeypatch):
    """The condition reaches the scan, which passes over row groups; no row within the bound is lost."""
    monkeypatch.setattr(pivots, "GROUP_BYTES", 1 << 12)
    points, _ = rows
    vectors = spark.createDataFrame(points[:3000], "id long, embedding array<double>")
    index = pivots.build(vectors, str(tmp_path / "i"), pivots=8)
    q = np.array([points[5][1]]) / np.linalg.norm(points[5][1])
    need = pivots.ranges(index, q, np.array([0.3]))
    kept = spark.read.schema(pivots._ROW).parquet(f"{index.path}/rows").where(need)
    ids = {r.id for r in kept.collect()}
    leaves = kept._jdf.queryExecution().executedPlan().collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    close = {i for i, v in points[:3000] if np.linalg.norm(np.array(v) / np.linalg.norm(v) - q[0]) <= 0.3}
    assert close and close <= ids
    assert len(ids) <= read < 3000 / 2 and "PushedFilters: [Or" in kept._jdf.queryExecution().toString().replace("PushedFilters: [And", "PushedFilters: [Or")
    assert kept.where(F.col("id").isin(sorted(close))).count() == len(close)
