"""Composite contexts: retrieved chunks as entries and as a budgeted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_text

#: The token budget, its shares, how many characters a token is taken for, and an entry's longest text.
BUDGET = 8000
SHARES = {"eager": 0.40, "rag": 0.30, "graphify": 0.20, "docs": 0.10}
CHARS_PER_TOKEN = 3.5
ENTRY_CHARS = 500


def docs_line(source: Column, path: Column, similarity: Column, text: Column) -> Column:
    return F.concat(F.lit("["), source, F.lit(" / "), path, F.lit("] (similarity="), F.format_string("%.3f", similarity), F.lit(")\n"), text)


def within_budget(text: Column, share: str, total: int = BUDGET) -> Column:
    """``text`` cut to what its channel's share of the tokens holds."""
    return F.left(text, F.lit(int(total * SHARES[share] * CHARS_PER_TOKEN)))


def entries(results: DataFrame, source: str) -> DataFrame:
    """Retrieved rows as context entries, texts cut to ENTRY_CHARS."""
    return results.select(F.lit(source).alias("source"), "chunk_id", F.left("chunk_text", F.lit(ENTRY_CHARS)).alias("chunk_text"), "section_path", "heading_level", "source_document", "similarity")


def docs_section(results: DataFrame, group: str, total: int = BUDGET) -> DataFrame:
    """group and text: the results, best first, as one text within the docs budget."""
    line = docs_line(F.col("source_document"), F.col("section_path"), F.col("similarity"), F.col("chunk_text"))
    row = F.struct((-F.col("similarity")).alias("s"), "chunk_id", line.alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["line"]), "\n\n")
    return results.groupBy(group).agg(within_budget(text, "docs", total).alias("text"), F.count(F.lit(1)).alias("results"))


def composite_json(results: DataFrame, query: str, top_k: int, source: str) -> DataFrame:
    """One row, text: {source, query, topK, entries, count}, best first."""
    rows = entries(results, source)
    entry = F.struct(
        "source", F.col("chunk_id").alias("chunkId"), F.col("chunk_text").alias("chunkText"), F.col("section_path").alias("sectionPath"), F.col("heading_level").alias("headingLevel"),
        F.col("source_document").alias("sourceDocument"), "similarity",
    )
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("chunk_id").alias("c"), entry.alias("e"))))
    grouped = rows.agg(F.transform(ordered, lambda r: r["e"]).alias("entries"), F.count(F.lit(1)).cast("int").alias("count"))
    return grouped.select(json_text(F.struct(F.lit(source).alias("source"), F.lit(query).alias("query"), F.lit(top_k).alias("topK"), "entries", "count")).alias("text"))


def typed_json(results: DataFrame, query: str, top_k: int, source: str, total: int = BUDGET) -> DataFrame:
    """One row, text: the docs section within its budget, and the budget."""
    section = docs_section(results.withColumn("all", F.lit(1)), "all", total)
    budget = F.struct(F.lit(total).alias("totalTokenBudget"), *(F.lit(v).alias(k) for k, v in SHARES.items()))
    return section.select(json_text(F.struct(F.lit(source).alias("source"), F.lit(query).alias("query"), F.lit(top_k).alias("topK"), F.col("text").alias("docsSection"), budget.alias("budget"), F.col("results").alias("count"))).alias("text"))
