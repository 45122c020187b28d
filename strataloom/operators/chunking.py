"""Markdown texts to heading-level chunks.

Lines are exploded once, and everything that depends on their order is a window over the
same partitioning by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, rtrim_ws, split_lines, trim_ws

HEADING = r"^(#{1,6})\s+(.+)$"


def _lines(docs: DataFrame) -> DataFrame:
    each = docs.select("source_document", "license", F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    return each.withColumn("is_heading", F.col("line").rlike(HEADING))


def sections(docs: DataFrame, strict_ancestors: bool = False) -> DataFrame:
    """Sections of ``docs`` (source_document, text, license), in order by sec.

    A heading line opens a section, in code fences too.  Text before the first heading is
    dropped, unless there is no heading: then the whole text is one level-0 section with the
    source's name.  Columns: level, title, heading_line, lines (without blank ones at the
    ends), path, overlap (the next section's first two sentences) and code_blocks.  The path holds earlier headings of lower level
    since the last level-1 heading; with ``strict_ancestors`` those alone that enclose the section.
    """
    by_line = Window.partitionBy("source_document").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source_document")
    numbered = _lines(docs).withColumn("sec", F.sum(F.col("is_heading").cast("int")).over(by_line)).withColumn("most", F.max("sec").over(whole))
    numbered = numbered.where((F.col("sec") > 0) | (F.col("most") == 0))
    fence = (~F.col("is_heading")) & F.regexp_replace("line", r"^[\s\p{Z}]+", "").startswith("```")
    in_section = Window.partitionBy("source_document", "sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fenced = numbered.withColumn("fence", fence).withColumn("run", F.sum(F.col("fence").cast("int")).over(in_section))
    # a run is what lies between two fences; odd ones that another fence follows are code
    line = F.struct("pos", "line", "is_heading", "fence")
    runs = fenced.groupBy("source_document", "sec", "run").agg(F.first("license").alias("license"), F.sort_array(F.collect_list(line)).alias("rows"))
    code = F.when(F.col("run") % 2 == 1, rtrim_ws(F.array_join(F.transform(F.filter("rows", lambda r: ~r["fence"]), lambda r: r["line"]), "\n")))
    coded = runs.withColumn("code", code)
    grouped = coded.groupBy("source_document", "sec").agg(F.first("license").alias("license"), F.max("run").alias("last"), F.sort_array(F.collect_list(F.struct("run", "rows", "code"))).alias("runs"))
    grouped = grouped.withColumn("rows", F.flatten(F.transform("runs", lambda r: r["rows"])))
    blocks = F.transform(F.filter("runs", lambda r: r["code"].isNotNull() & (r["run"] < F.col("last"))), lambda r: r["code"])
    head = F.element_at("rows", 1)
    body = F.filter("rows", lambda r: ~r["is_heading"])
    level = F.when(head["is_heading"], F.length(F.regexp_extract(head["line"], HEADING, 1))).otherwise(0)
    title = F.when(head["is_heading"], trim_ws(F.regexp_extract(head["line"], HEADING, 2))).otherwise(F.col("source_document"))
    out = grouped.select(
        "source_document", "license", "sec", level.alias("level"), title.alias("title"), F.when(head["is_heading"], head["line"]).alias("heading_line"),
        F.when(head["is_heading"], _stripped(F.transform(body, lambda r: r["line"]))).otherwise(F.transform(body, lambda r: r["line"])).alias("lines"), blocks.alias("code_blocks"),
    )
    order = Window.partitionBy("source_document").orderBy("sec")
    return _with_paths(out.withColumn("overlap", first_sentences(F.lead("lines").over(order))), strict_ancestors)


def _with_paths(found: DataFrame, strict: bool) -> DataFrame:
    """Add path, the titles above each section and its own."""
    up = Window.partitionBy("source_document").orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("chapter", F.sum((F.col("level") == 1).cast("int")).over(up))
    if strict:  # the last heading of each lower level, unless a later one is lower still
        before = Window.partitionBy("source_document", "chapter").orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
        last = [F.last(F.when(F.col("level") == k, F.struct("sec", "title")), ignorenulls=True).over(before) for k in range(1, 6)]
        placed = placed.withColumns({f"h{k}": c for k, c in enumerate(last, 1)})
        kept = [F.when((F.col("level") > k) & _behind(k), F.col(f"h{k}.title")) for k in range(1, 6)]
        return placed.withColumn("path", F.array_join(F.concat(F.filter(F.array(*kept), lambda t: t.isNotNull()), F.array("title")), " > ")).drop("chapter", *(f"h{k}" for k in range(1, 6)))
    # a chapter's headings of each level or a lower one are listed once; a path is the beginning of one list
    inside = Window.partitionBy("source_document", "chapter").orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    counts = [F.coalesce(F.sum(F.col("level").between(1, k).cast("int")).over(inside), F.lit(0)).cast("int") for k in range(1, 6)]
    counted = placed.select("source_document", "chapter", "sec", "level", "title", F.array(F.lit(0), *counts).alias("n"))
    ahead = F.when(F.col("level") > 1, F.element_at("n", F.least(F.col("level"), F.lit(6)))).otherwise(0)
    lists = [F.sort_array(F.collect_list(F.when(F.col("level").between(1, k), F.struct("sec", "title")))).alias(f"l{k}") for k in range(1, 6)]
    chapters = counted.withColumn("n", ahead).groupBy("source_document", "chapter").agg(F.collect_list(F.struct("sec", "level", "title", "n")).alias("s"), *lists)
    titles = F.array(*(F.transform(f"l{k}", lambda h: h["title"]) for k in range(1, 6)))
    paths = F.transform("s", lambda s: F.struct(s["sec"].alias("sec"), F.array_join(F.concat(F.when(s["n"] > 0, F.slice(F.element_at("titles", s["level"] - 1), 1, s["n"])).otherwise(F.array().cast("array<string>")), F.array(s["title"])), " > ").alias("path")))
    named = chapters.withColumn("titles", titles).select(F.col("source_document").alias("d"), F.explode(paths).alias("p")).select("d", F.col("p.sec").alias("s"), "p.path")
    return placed.drop("chapter").join(named, F.col("source_document").eqNullSafe(F.col("d")) & (F.col("sec") == F.col("s"))).drop("d", "s")


def _behind(k: int) -> Column:
    """No heading of a level below k comes after the last one of level k."""
    out = F.lit(True)
    for j in range(1, k):
        out = out & (F.col(f"h{j}").isNull() | (F.col(f"h{j}.sec") < F.col(f"h{k}.sec")))
    return out


def _stripped(lines: Column) -> Column:
    """Without blank lines at either end."""
    marked = F.transform(lines, lambda x, i: F.when(~is_blank(x), i))
    first, last = F.array_min(marked), F.array_max(marked)
    return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(lines, first + 1, last - first + 1))


def first_sentences(lines: Column) -> Column:
    """The first two sentences of at most three text lines; null if there are none."""
    text = F.filter(lines, lambda x: ~trim_ws(x).startswith("#") & ~trim_ws(x).startswith("```") & ~is_blank(x))
    joined = F.array_join(F.slice(text, 1, 3), " ")
    two = trim_ws(F.array_join(F.slice(F.split(joined, r"(?<=[.!?])\s+"), 1, 2), " "))
    return F.when(two != "", two)


def chunk_id(source: Column, path: Column) -> Column:
    return F.concat(F.lit("chk-"), F.substring(F.sha2(F.concat(source, F.lit(":"), path).cast("binary"), 256), 1, 16))


def summary(chunks: DataFrame) -> DataFrame:
    """source_document, chunks and their lines in all."""
    return chunks.groupBy("source_document").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size(split_lines(F.col("content"))).cast("bigint")).alias("lines"))


def chunk_documents(docs: DataFrame, strict_ancestors: bool = False) -> DataFrame:
    """Chunks of ``docs`` (source_document, text, license): one a section that isn't blank.

    Null texts are empty and give no chunks.  Equal paths in one source have
    equal ids; (source_document, pos) tells chunks apart.
    """
    found = sections(docs, strict_ancestors)
    content = trim_ws(F.concat_ws("\n", F.when(F.col("heading_line").isNotNull(), F.array("heading_line")).otherwise(F.array().cast("array<string>")), "lines"))
    return found.withColumn("content", content).where(F.col("content") != "").select(
        chunk_id(F.col("source_document"), F.col("path")).alias("id"), "source_document", F.col("sec").alias("pos"), F.col("path").alias("section_path"), F.col("level").alias("heading_level"),
        "content", "code_blocks", F.array().cast("array<string>").alias("entities"), F.col("overlap").alias("overlap_next"), F.coalesce("license", F.lit("UNKNOWN")).alias("license"),
    )
