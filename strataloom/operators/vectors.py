"""Exact vector search: cosine similarity and top-k retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine_similarity(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """1 - cosine distance in doubles, in [-1, 1]; null if a norm is 0 or an input is null."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * (b_norm if b_norm is not None else F.sqrt(dot(b, b))))


def top_k(chunks: DataFrame, query: DataFrame, k: int, key: str, embedding: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``chunks`` nearest to the one row (query) of ``query``.

    Rows without an embedding are filtered at the scan.  The query is a single row, so its
    broadcast is bounded; each partition keeps k rows, so nothing but those is shuffled.
    Ties go to the smaller key; rows without a similarity come last.  An empty query gives no rows.
    """
    one = query.limit(1).select(F.col("query").alias("__q"), F.sqrt(dot(F.col("query"), F.col("query"))).alias("__n"))
    scored = chunks.where(F.col(embedding).isNotNull()).crossJoin(F.broadcast(one))
    similar = scored.withColumn("similarity", cosine_similarity(F.col(embedding), F.col("__q"), F.col("__n"))).drop("__q", "__n")
    return similar.orderBy(F.col("similarity").desc_nulls_last(), F.col(key)).limit(k)


def retrieve(chunks: DataFrame, documents: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """Top-k chunks with their documents.

    ``chunks`` (id, document_id, embedding, ...), ``documents`` (id, source_document).  The
    top k are taken before the join: a chunk has one document, so the join neither drops nor
    repeats rows once chunks without document are left out.
    """
    best = top_k(chunks.where(F.col("document_id").isNotNull()), query, k, "id")
    named = documents.select(F.col("id").alias("__doc"), "source_document")
    joined = best.join(named, F.col("document_id") == F.col("__doc")).drop("__doc")
    return joined.orderBy(F.col("similarity").desc_nulls_last(), "id")
