"""Knowledge-base export: JSON-LD, Markdown and AsciiDoc of a document's chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, json_text, rtrim_ws, split_lines, trim_ws
from ..session import staged


def _left_pad(c: Column, width: int, fill: str) -> Column:
    """Pad on the left, never cut."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def section_sort_key(path: Column) -> Column:
    """Each part's first number (digits and dots) padded to 4 with zeros; parts without one padded with blanks."""

    def key(part: Column) -> Column:
        prefix = F.regexp_extract(part, r"^([^0-9]*)", 1)
        number = F.regexp_extract(part, r"^[^0-9]*([0-9][0-9.]*)", 1)
        suffix = F.regexp_extract(part, r"^[^0-9]*[0-9][0-9.]*(.*)$", 1)
        return F.when(number != "", F.concat(prefix, _left_pad(number, 4, "0"), suffix)).otherwise(_left_pad(part, 4, " "))

    return F.array_join(F.transform(F.split(path, " > "), key), " > ")


def _body(content: Column, level: Column) -> Column:
    rest = F.array_join(F.slice(split_lines(content), 2, F.greatest(F.size(split_lines(content)) - 1, F.lit(0))), "\n")
    return trim_ws(F.when(level > 0, rest).otherwise(content))


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """Add sort_key and place (1, 2, ...) within the source, by key and then by pos."""
    keyed = chunks.withColumn("sort_key", section_sort_key(F.col("section_path")))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("source_document").orderBy("sort_key", "pos")))


def _lines(*parts: Column) -> Column:
    """Arrays of lines, put together."""
    return F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))


def _some(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.array(*lines)).otherwise(F.array().cast("array<string>"))


def _head_and_lines(rows: DataFrame, head: Column) -> DataFrame:
    """source_document, place and line of a whole document, that of the head first; the lines of a chunk are one.

    The rows are staged: heads and ranges of lines read them again, and they are what costs.
    """
    rows = staged(rows.select("source_document", "place", F.array_join("out", "\n").alias("line")), "lines")
    heads = rows.groupBy("source_document").agg(F.count(F.lit(1)).alias("chunks")).select("source_document", F.lit(0).alias("place"), head.alias("line"))
    return heads.unionByName(rows)


def _joined(rows: DataFrame, head: Column) -> DataFrame:
    text = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "out"))), lambda r: r["out"])), "\n")
    grouped = rows.groupBy("source_document").agg(text.alias("body"), F.count(F.lit(1)).alias("chunks"))
    return grouped.select("source_document", F.concat(rtrim_ws(F.concat(head, F.lit("\n"), F.col("body"))), F.lit("\n")).alias("text"))


def _markdown(chunks: DataFrame) -> tuple[DataFrame, Column]:
    rows = ordered_chunks(chunks)
    last = F.coalesce(F.lag("heading_level").over(Window.partitionBy("source_document").orderBy("place")), F.lit(0))
    level, title, blank = F.col("heading_level"), F.substring_index("section_path", " > ", -1), F.lit("")
    body = _body(F.col("content"), level)
    out = _lines(
        _some((level == 1) & (last != 1), blank),
        _some(level > 0, F.concat(F.expr("repeat('#', least(greatest(heading_level, 1), 6))"), F.lit(" "), title), blank),
        _some(~is_blank(body), body, blank),
        F.flatten(F.transform("code_blocks", lambda b: F.array(F.lit("```text"), trim_ws(b), F.lit("```"), F.lit("")))),
        _some(F.col("overlap_next").isNotNull(), F.concat(F.lit("> _Continued: "), F.col("overlap_next"), F.lit("_")), blank),
        _some(level == 1, F.lit("---")),
        F.array(blank),
    )
    return rows.withColumn("out", out), F.concat(F.lit("# "), F.col("source_document"), F.lit("\n"))


def _asciidoc(chunks: DataFrame) -> tuple[DataFrame, Column]:
    rows, blank = ordered_chunks(chunks), F.lit("")
    level, title = F.col("heading_level"), F.substring_index("section_path", " > ", -1)
    body = _body(F.col("content"), level)
    out = _lines(
        _some(level > 0, F.concat(F.expr("repeat('=', least(greatest(heading_level, 1), 5))"), F.lit(" "), title), blank),
        _some(~is_blank(body), body, blank),
        F.flatten(F.transform("code_blocks", lambda b: F.array(F.lit("[source,text]"), F.lit("----"), trim_ws(b), F.lit("----"), F.lit("")))),
        _some(F.col("overlap_next").isNotNull(), F.lit("[TIP]"), F.concat(F.lit("Continued: "), F.col("overlap_next")), blank),
        F.array(F.lit("'''"), blank),
    )
    note = "Auto-generated by deployKnowledgeBase. Aggregated knowledge base from "
    head = F.concat(F.lit("= "), F.col("source_document"), F.lit(f"\n\n[NOTE]\n====\n{note}"), F.col("chunks").cast("string"), F.lit(" chunks.\n====\n"))
    return rows.withColumn("out", out), head


def markdown(chunks: DataFrame) -> DataFrame:
    """source_document and text: its chunks in section order as one Markdown document."""
    return _joined(*_markdown(chunks))


def asciidoc(chunks: DataFrame) -> DataFrame:
    """The same as one AsciiDoc document."""
    return _joined(*_asciidoc(chunks))


def lines(chunks: DataFrame, form: str) -> DataFrame:
    """source_document, place and line of the Markdown or AsciiDoc document of each source: joined by line breaks in order of place, and
    without white space at the end but one line break, they are its text.  For documents that are larger than a row may be.
    """
    rows, head = {"markdown": _markdown, "asciidoc": _asciidoc}[form](chunks)
    return _head_and_lines(rows, head)


def json_ld(chunks: DataFrame, namespace: str = "kb") -> DataFrame:
    """source_document and text: a JSON-LD graph with the chunks in their given order.

    Names are urn:<namespace>:<id> and urn:<namespace>:doc:<source>.  A missing overlap is the
    string "null", as consumers of the format expect.
    """
    node = F.struct(
        F.concat(F.lit(f"urn:{namespace}:"), F.col("id")).alias("@id"), F.lit("DocumentChunk").alias("@type"), F.col("id").alias("identifier"),
        F.concat(F.lit(f"urn:{namespace}:doc:"), F.col("source_document")).alias("isPartOf"), F.col("section_path").alias("sectionPath"), F.col("heading_level").alias("headingLevel"),
        F.col("content").alias("text"), F.col("code_blocks").alias("codeBlocks"), "entities", F.coalesce("overlap_next", F.lit("null")).alias("overlapNext"), "license",
    )
    context = F.struct(
        F.lit("https://schema.org/").alias("schema"), F.lit(f"urn:{namespace}:").alias(namespace),
        F.struct(F.lit("schema:isPartOf").alias("@id"), F.lit("@id").alias("@type")).alias("isPartOf"),
    )
    grouped = chunks.groupBy("source_document").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", node.alias("n")))), lambda r: r["n"]).alias("graph"))
    return grouped.select("source_document", json_text(F.struct(context.alias("@context"), F.col("graph").alias("@graph"))).alias("text"))


def export(chunks: DataFrame, form: str) -> DataFrame:
    """One of json-ld, markdown, asciidoc; no chunks give no output."""
    forms = {"json-ld": json_ld, "markdown": markdown, "asciidoc": asciidoc}
    if form not in forms:
        raise ValueError(f"unknown form {form}")
    return forms[form](chunks)
