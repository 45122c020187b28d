"""Documents that are larger than a row or a file should be, as files of consecutive lines and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import running_sum
from ..functions.text import json_text
from .named_files import read_files, write_files

#: Characters of a part, about; a longer line is a part of its own.
PART_CHARS = 1 << 24
MANIFEST = "manifest.json"


def write_parts(lines: DataFrame, path: str, doc: str = "doc", place: str = "place", line: str = "line", chars: int = PART_CHARS) -> None:
    """The ``lines`` of each document in order of ``place`` as files <doc>/part-<number>, each line with its break, and <doc>/manifest.json.

    The manifest has the parts' names and their lines and characters in order, so the text is theirs put together.  Lines
    are dealt out by ranges, so a document with most of the lines is no single task's work; a part is a row
    while it is written.  Documents' names are names of folders; ``place`` must tell a document's lines apart.
    """
    rows = lines.select(F.col(doc).cast("string").alias("doc"), F.col(place).cast("bigint").alias("place"), F.coalesce(F.col(line), F.lit("")).alias("line"))
    ahead = running_sum(rows, ["doc", "place"], F.length("line") + 1, "ahead")
    first = ahead.groupBy("doc").agg(F.min("ahead").alias("first")).withColumnRenamed("doc", "d")
    numbered = ahead.join(first, F.col("doc") == F.col("d")).withColumn("part", F.floor((F.col("ahead") - F.col("first")) / chars))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda r: F.concat(r["line"], F.lit("\n")))
    file_name = F.concat(F.lit("part-"), F.lpad(F.col("part").cast("string"), 9, "0"))
    named = numbered.groupBy("doc", "part").agg(F.array_join(ordered, "").alias("text")).select("doc", file_name.alias("file_name"), "text")
    # from the lines' lengths, so no text is put together twice
    counted = numbered.groupBy("doc", "part").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line") + 1).alias("chars"))
    entry = F.struct("part", F.struct(file_name.alias("name"), "lines", "chars").alias("e"))
    sizes = counted.groupBy("doc").agg(json_text(F.struct(F.transform(F.sort_array(F.collect_list(entry)), lambda r: r["e"]).alias("parts"), F.sum("lines").alias("lines"))).alias("text"))
    files = named.unionByName(sizes.select("doc", F.lit(MANIFEST).alias("file_name"), "text"))
    write_files(files, path, folder="doc")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """doc, part (from 0) and text of the parts that write_parts has made; every part that a manifest names has to be there."""
    files = read_files(spark, path).select(F.regexp_extract("name", "^(.*)/([^/]*)$", 1).alias("doc"), F.regexp_extract("name", "^(.*)/([^/]*)$", 2).alias("file"), "text")
    listed = files.where(F.col("file") == MANIFEST).select("doc", F.posexplode(F.from_json("text", "parts array<struct<name:string,lines:bigint,chars:bigint>>")["parts"]).alias("part", "e"))
    there = files.where(F.col("file") != MANIFEST).select(F.col("doc").alias("d"), "file", "text")
    joined = listed.join(there, (F.col("doc") == F.col("d")) & (F.col("e.name") == F.col("file")), "left")
    whole = F.when(F.col("text").isNull() | (F.length("text") != F.col("e.chars")), F.raise_error(F.concat(F.lit("a part is missing: "), F.col("doc"), F.lit("/"), F.col("e.name")))).otherwise(F.col("text"))
    return joined.select("doc", "part", whole.alias("text"))
