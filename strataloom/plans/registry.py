"""All queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import composites, files, generated, graphs, knowledge, stores, structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**knowledge.QUERIES, **structure.QUERIES, **graphs.QUERIES, **composites.QUERIES, **stores.QUERIES, **files.QUERIES}
ORACLE_SQL: dict[str, str] = {**knowledge.ORACLE_SQL, **structure.ORACLE_SQL, **graphs.ORACLE_SQL, **generated.ORACLE_SQL, **composites.ORACLE_SQL, **stores.ORACLE_SQL, **files.ORACLE_SQL}
