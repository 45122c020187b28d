"""Section trees enriched with chunks, graph nodes and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_text, rtrim_ws, trim_ws

#: Fixed value: runs of capitalised words.
ENTITY = r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*(?![A-Za-z0-9_])"


def last_segment(path: Column) -> Column:
    return trim_ws(F.element_at(F.split(trim_ws(path), ">"), -1))


def entities(title: Column, text: Column) -> Column:
    """Capitalised names of title and text, each once, in order."""
    some = lambda c: F.when(trim_ws(F.coalesce(c, F.lit(""))) != "", c).otherwise(F.lit(""))
    source = F.concat(F.when(some(title) != "", F.concat(title, F.lit(" "))).otherwise(F.lit("")), some(text))
    return F.array_distinct(F.regexp_extract_all(source, F.lit(ENTITY), F.lit(0)))


def enrich(nodes: DataFrame, chunks: DataFrame, graph: DataFrame) -> DataFrame:
    """Each node of ``nodes`` (node_id, title, text, ...) with what its title matches, ignoring case.

    Adds chunk_ids (of ``chunks``: id, section_path, pos, by the last part of the path), graph_ids (of
    ``graph``: id, label), density (matched share of all chunks, 0 without chunks) and entities.  A blank
    title matches nothing.  The matches are joined on derived keys, not compared pair by pair;
    each side is grouped by its key first, so a title that many nodes share isn't multiplied.
    """
    key = F.when(trim_ws(F.col("title")) != "", F.lower("title"))
    total = chunks.agg(F.count(F.lit(1)).alias("total"))
    by_section = chunks.where(trim_ws(F.col("section_path")) != "").groupBy(F.lower(last_segment(F.col("section_path"))).alias("ck")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda r: r["id"]).alias("chunk_ids")
    )
    by_label = graph.groupBy(F.lower("label").alias("gk")).agg(F.sort_array(F.collect_list("id")).alias("graph_ids"))
    joined = nodes.withColumn("key", key).join(by_section, F.col("key") == F.col("ck"), "left").join(by_label, F.col("key") == F.col("gk"), "left").crossJoin(F.broadcast(total))
    none = F.array().cast("array<string>")
    matched = F.coalesce(F.size("chunk_ids"), F.lit(0))
    density = F.coalesce(F.try_divide(F.when(F.col("chunk_ids").isNull(), 0).otherwise(matched).cast("double"), F.col("total").cast("double")), F.lit(0.0))
    return joined.select(
        *nodes.columns, F.coalesce(F.col("chunk_ids").cast("array<string>"), none).alias("chunk_ids"), F.coalesce(F.col("graph_ids").cast("array<string>"), none).alias("graph_ids"),
        density.alias("density"), entities(F.col("title"), F.col("text")).alias("entities"),
    )


def summary(enriched: DataFrame) -> DataFrame:
    """One row: sections, chunks attached and graph nodes resolved."""
    total = lambda c: F.coalesce(F.sum(F.size(c).cast("bigint")), F.lit(0))
    return enriched.agg(F.count(F.lit(1)).alias("sections"), total("chunk_ids").alias("chunks"), total("graph_ids").alias("graph_nodes"))


def as_json(enriched: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
    """One row, text: the enriched nodes (title, level, ...) in ``order`` as a JSON array, with their chunks whole."""
    names = {"id": "id", "source_document": "sourceDocument", "section_path": "sectionPath", "heading_level": "headingLevel", "content": "content", "license": "license"}
    one = F.struct(*(F.col(c).alias(n) for c, n in names.items() if c in chunks.columns))
    ids = enriched.select(F.col(order).alias("o"), F.posexplode("chunk_ids").alias("n", "cid"))
    attached = ids.join(chunks.select(F.col("id").alias("i"), one.alias("c")), F.col("cid") == F.col("i")).groupBy("o").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "c"))), lambda r: r["c"]).alias("rag"))
    joined = enriched.join(attached, F.col(order) == F.col("o"), "left")
    node = F.struct(F.struct("title", "level").alias("ldd"), F.coalesce("rag", F.array().cast(attached.schema["rag"].dataType)).alias("ragChunks"), F.col("graph_ids").alias("graphifyNodes"), F.col("density").alias("semanticDensity"), "entities")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), node.alias("v")))), lambda r: r["v"])
    return joined.agg(json_text(ordered).alias("text"))


def graph_section(enriched: DataFrame, group: str, order: str) -> DataFrame:
    """group and text: the titles of nodes with graph ids, each with its ids as a list, two blank lines between."""
    block = F.concat(F.col("title"), F.lit("\n"), F.array_join(F.transform("graph_ids", lambda g: F.concat(F.lit("- "), g, F.lit("\n"))), ""))
    blocks = F.sort_array(F.collect_list(F.when(F.size("graph_ids") > 0, F.struct(F.col(order).alias("o"), block.alias("b")))))
    return enriched.groupBy(group).agg(rtrim_ws(F.array_join(F.transform(blocks, lambda r: r["b"]), "\n\n")).alias("text"))
