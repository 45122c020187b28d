"""Driver tables, and structured documents derived from them, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document a conversation: a heading, then a section a turn; every third assistant turn is fenced."""
    turns = table(spark, sf_dir, "conversations")
    heading = F.concat(F.when(F.col("turn") % 2 == 0, "## Turn ").otherwise("### Turn "), F.col("turn").cast("string"), F.lit("\n"))
    fenced = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 1), F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    block = F.struct("turn", "role", "text", F.concat(heading, fenced).alias("block"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    text = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"))
    return grouped.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source_document"), text.alias("text"), F.lit("Apache-2.0").alias("license"))


#: The same as CTEs: docs, lines, sections.
CONVERSATION_SQL = r"""
turns AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN '## Turn ' ELSE '### Turn ' END || turn || chr(10) ||
  CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS block FROM conversations),
docs AS (SELECT 'conv-' || conv_id AS source_document, '# Conversation ' || conv_id || chr(10) || string_agg(block, chr(10) ORDER BY turn, role, text) AS text FROM turns GROUP BY conv_id),
split AS (SELECT source_document, string_split_regex(text, '\r\n|\n|\r') AS l FROM docs),
raw AS (SELECT source_document, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM split),
heads AS (SELECT *, regexp_matches(line, '^(#{1,6})\s+(.+)$') AS h FROM raw),
numbered AS (SELECT *, sum(h::INT) OVER (PARTITION BY source_document ORDER BY pos) AS sec FROM heads),
lines AS (SELECT *, CASE WHEN NOT h THEN ltrim(line) LIKE '```%' ELSE false END AS fence FROM numbered WHERE sec > 0),
runs AS (SELECT *, sum(fence::INT) OVER (PARTITION BY source_document, sec ORDER BY pos) AS run FROM lines),
trimmed AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM runs),
sections AS (SELECT source_document, sec::INT AS sec,
  length(regexp_extract(first(line ORDER BY pos), '^(#{1,6})\s+(.+)$', 1))::INT AS level,
  trim(regexp_extract(first(line ORDER BY pos), '^(#{1,6})\s+(.+)$', 2)) AS title,
  first(line ORDER BY pos) AS heading_line,
  list(line ORDER BY pos) FILTER (NOT h) AS body,
  coalesce(list(t ORDER BY pos) FILTER (NOT h AND t <> '' AND t NOT LIKE '#%' AND t NOT LIKE '```%'), []) AS texts
  FROM trimmed GROUP BY source_document, sec),
chapters AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY source_document ORDER BY sec) AS chapter FROM sections),
earlier AS (SELECT *, coalesce(list({'level': level, 'title': title}) OVER (PARTITION BY source_document, chapter ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS prev FROM chapters),
paths AS (SELECT *, array_to_string(list_concat(list_transform(list_filter(prev, lambda e: e.level < level AND e.level > 0), lambda e: e.title), [title]), ' > ') AS path FROM earlier),
contents AS (SELECT *, regexp_replace(heading_line || chr(10) || regexp_replace(coalesce(array_to_string(body, chr(10)), ''), '^(\s*\n)+', ''), '^\s+|\s+$', '', 'g') AS content FROM paths)
"""
