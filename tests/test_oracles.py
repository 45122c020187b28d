"""Every registered query against its SQL on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from strataloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    def value(x):
        return ("nan" if math.isnan(x) else round(x, 6)) if isinstance(x, float) else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(found.select(*columns).collect()) == plain([r[i] for i in order] for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
