"""Continuous ingest: Markdown files that arrive in a folder become chunks in a store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents
from ..sources.readers import file_stem
from ..sources.sinks import ChunkStore


def ingest_folder(spark: SparkSession, folder: str, store: ChunkStore, embed, checkpoint: str, license: str = "UNKNOWN", once: bool = True) -> StreamingQuery:
    """Start the query; each micro-batch of new files is chunked and appended to ``store``.

    The checkpoint remembers which files were taken.  A micro-batch is stored under its number and the checkpoint's
    name, so one that failed between its write and its commit is taken again but stored once.
    """
    texts = spark.readStream.format("text").schema("value string").option("wholetext", "true").load(folder)
    docs = texts.select(file_stem(F.col("_metadata.file_path")).alias("source_document"), F.col("value").alias("text"), F.lit(license).alias("license"))

    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.add(chunk_documents(batch), embed, f"{name}-{number}")

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
