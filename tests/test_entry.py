"""The driver's contract."""

import __spark_entry__ as entry


def test_queries_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "retrieve_topk" in queries


def test_entry(spark):
    assert entry.entry(spark).count() == 10
