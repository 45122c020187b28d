"""Sinks: texts, JSON, store tables, pages, routed folders and metadata."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_text
from ..session import complete, staged
from .named_files import write_files
from .readers import CACHE_SUFFIX

DOCUMENTS = "id bigint, source_document string, chunk_count int, license string"
CHUNKS = "id bigint, document_id bigint, chunk_index int, chunk_text string, section_path string, heading_level int, embedding array<float>"


def write_texts(rows: DataFrame, path: str, by: str | None = None, text: str = "text") -> None:
    """Whole texts as files; with ``by`` in a folder for each value."""
    if by is None:
        rows.select(F.col(text).alias("value")).write.mode("overwrite").text(path)
    else:
        rows.select(F.col(text).alias("value"), F.col(by).alias("name")).write.mode("overwrite").partitionBy("name").text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """OCR pages (book, file_name, body) as files <book>/<file_name>."""
    write_files(pages, path, "file_name", "body", "book")


def write_ocr_cache(entries: DataFrame, path: str, language: str = "fr", generated_at: str | None = None) -> None:
    """Cache entries (ocr.CACHE) as a JSON file each, which readers.read_ocr_cache reads; the folder is replaced."""
    result = F.struct(
        F.col("text").alias("structuredText"), "confidence", F.lit(language).alias("language"), F.lit("png").alias("sourceFormat"), F.lit(generated_at or datetime.now(UTC).isoformat()).alias("generatedAt"), "model",
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    rows = entries.select(F.concat("page_id", F.lit(CACHE_SUFFIX)).alias("file_name"), json_text(F.struct(F.col("source_hash").alias("sourceHash"), result.alias("result"))).alias("text"))
    write_files(rows, path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def chunks_json(chunks: DataFrame) -> DataFrame:
    """source_document and text: each document's chunks as a JSON array in order."""
    one = F.struct(
        "id", F.col("source_document").alias("sourceDocument"), F.col("section_path").alias("sectionPath"), F.col("heading_level").alias("headingLevel"), "content",
        F.col("code_blocks").alias("codeBlocks"), "entities", F.col("overlap_next").alias("overlapNext"), "license",
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", one.alias("c")))), lambda r: r["c"])
    return chunks.groupBy("source_document").agg(json_text(ordered).alias("text"))


class ChunkStore:
    """documents and chunks as Parquet tables that grow by batches.

    A batch is a folder of its own, chunks first and documents last; it counts once both are complete, so a write that
    was broken off is as if it hadn't been, and is written over by the next.  Ids go on from the largest one
    there.  Ingesting a document again stores it again, but a batch whose name is there is stored once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def batches(self) -> list[str]:
        return [n for n in complete(self.spark, f"{self.path}/documents") if n in set(complete(self.spark, f"{self.path}/chunks"))]

    def table(self, name: str) -> DataFrame:
        schema = {"documents": DOCUMENTS, "chunks": CHUNKS}[name]
        paths = [f"{self.path}/{name}/{b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _next(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def add(self, chunks: DataFrame, embed, batch: str | None = None) -> None:
        """Store ``chunks`` (source_document, section_path, heading_level, content, license, pos) and their vectors as a batch.

        Without a name the batch is a new one.
        """
        from ..functions.ordering import running_sum
        from ..operators.ingest import ingest

        name = f"batch-{batch or uuid.uuid4().hex}"
        if name in self.batches():
            return
        documents, rows = ingest(chunks, embed)
        first, base = self._next("documents"), self._next("chunks")
        documents = staged(documents, "documents")
        # a document's chunks follow those of the documents before it
        starts = running_sum(documents.select(F.col("id").alias("__d"), "chunk_count"), ["__d"], F.col("chunk_count"), "__b").drop("chunk_count")
        numbered = rows.join(starts, F.col("document_id") == F.col("__d"))
        numbered = numbered.select((F.col("__b") + F.col("chunk_index") + F.lit(base)).cast("bigint").alias("id"), (F.col("document_id") + F.lit(first - 1)).alias("document_id"), "chunk_index", "chunk_text", "section_path", "heading_level", "embedding")
        numbered.write.mode("overwrite").parquet(f"{self.path}/chunks/{name}")
        documents.select((F.col("id") + F.lit(first - 1)).alias("id"), "source_document", "chunk_count", "license").write.mode("overwrite").parquet(f"{self.path}/documents/{name}")

    def search(self, query_vector: list[float], k: int = 10) -> DataFrame:
        """The k nearest chunks with their documents; no query vector gives no rows."""
        from ..operators.vectors import retrieve

        query = self.spark.createDataFrame([([float(x) for x in query_vector],)] if query_vector else [], "query array<double>")
        return retrieve(self.table("chunks"), self.table("documents"), query, k)


def write_routed(rows: DataFrame, path: str, zone: str = "zone") -> None:
    """Rows under route=OSS or route=office by their licence zone."""
    from ..operators.licences import route

    rows.withColumn("route", route(F.col(zone))).write.mode("overwrite").partitionBy("route").parquet(path)


def metadata_json(kind: str, sessions: int, source: str = "engine", model: str = "", version: str = "0.1.0", dependencies: tuple[str, ...] = ()) -> str:
    """The text of a metadata sidecar; its time is the call's."""
    about = {"source": source, "type": kind, "sessions": sessions, "generatedAt": datetime.now(UTC).isoformat(), "model": model, "version": version, "dependencies": list(dependencies)}
    return json.dumps(about, indent=2)


def write_metadata(spark: SparkSession, path: str, kind: str, sessions: int, **about) -> None:
    spark.createDataFrame([(metadata_json(kind, sessions, **about),)], "value string").coalesce(1).write.mode("overwrite").text(path)
