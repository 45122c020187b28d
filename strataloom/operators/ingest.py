"""Documents and chunks as store rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered, place_in_group


def document_rows(chunks: DataFrame, source: str = "source_document", licence: str = "license", pos: str = "pos") -> DataFrame:
    """A row a source: id in order of first appearance, chunk_count, and the first chunk's licence."""
    grouped = chunks.groupBy(F.col(source).alias("source_document")).agg(
        F.count(F.lit(1)).cast("int").alias("chunk_count"), F.min_by(licence, pos).alias("license"), F.min(pos).alias("first_pos")
    )
    return numbered(grouped, ["first_pos", "source_document"], "id").withColumn("id", F.col("id") + 1).drop("first_pos")


def with_chunk_index(chunks: DataFrame, source: str = "source_document", pos: str = "pos") -> DataFrame:
    """Add chunk_index: 0-based place within the source, whatever the content."""
    return place_in_group(chunks, source, [pos], "chunk_index").withColumn("chunk_index", F.col("chunk_index").cast("int"))


def ingest(chunks: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """Document rows and chunk rows with embeddings.

    ``chunks`` has source_document, section_path, heading_level, content, license and pos;
    ``embed`` turns a text column into a vector column.  Ingesting twice gives the rows twice.
    """
    documents = document_rows(chunks)
    ids = documents.select(F.col("id").alias("document_id"), F.col("source_document").alias("__s"))
    rows = with_chunk_index(chunks).join(ids, F.col("source_document").eqNullSafe(F.col("__s")))
    out = rows.select("document_id", "chunk_index", F.col("content").alias("chunk_text"), "section_path", "heading_level", embed(F.col("content")).alias("embedding"))
    return documents, out
