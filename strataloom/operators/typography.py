"""Positioned lines to structured text: font styles, size thresholds, visual lines, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rtrim_ws, trim_ws

#: Words in font names that tell the style.
MONO = ("mono", "courier", "consolas", "menlo", "monaco", "typewriter", "source code", "fira code", "jetbrains")
BOLD = ("bold", "bd ", "heavy", "black")
ITALIC = ("italic", "oblique", "slanted", "it ")
#: Fixed value: lines at least so far apart belong to different visual lines.
GAP = 2.0
MONO_SIZE = 14.0
EMPTY = "= [Document vide]\n\n"


def _has(name: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | name.contains(word)
    return out


def font_style(name: Column) -> Column:
    """NORMAL, BOLD, ITALIC, BOLD_ITALIC or MONOSPACE by the font's name; null is NORMAL."""
    low = F.lower(F.coalesce(name, F.lit("")))
    bold, italic = _has(low, BOLD), _has(low, ITALIC)
    return F.when(_has(low, MONO), "MONOSPACE").when(bold & italic, "BOLD_ITALIC").when(bold, "BOLD").when(italic, "ITALIC").otherwise("NORMAL")


def is_mono(style: Column) -> Column:
    return style == "MONOSPACE"


def is_bold(style: Column) -> Column:
    return style.isin("BOLD", "BOLD_ITALIC")


def is_italic(style: Column) -> Column:
    return style.isin("ITALIC", "BOLD_ITALIC")


def size_statistics(lines: DataFrame) -> DataFrame:
    """doc and avg, max, min, range of the font sizes outside monospace; NaN without any."""
    size = F.when(~is_mono(F.col("style")), F.col("font_size").cast("double"))
    nan = F.lit(float("nan"))
    stats = lines.groupBy("doc").agg(*(F.coalesce(f(size), nan).alias(n) for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))))
    return stats.withColumn("range", F.col("max") - F.col("min"))


def book_thresholds() -> list[Column]:
    """h1 to h4 from max and range: shares of the range, or of the largest size where the range is small."""
    top, r = F.col("max"), F.col("range")
    rows = ((1, 0.05, 0.95), (2, 0.25, 0.75), (3, 0.5, 0.5), (4, 0.7, 0.35))
    return [F.when((r > k) & ~F.isnan(r), top - r * share).otherwise(top * alone).alias(f"h{k}") for k, share, alone in rows]


def plain_thresholds() -> list[Column]:
    """h1 to h3 of the shorter rules: nothing is a heading if sizes hardly differ."""
    return [F.when(F.col("range") <= 0.5, F.col("max") + 0.1).otherwise(F.col("max") * s).alias(f"h{k}") for k, s in ((1, 0.95), (2, 0.75), (3, 0.5))]


def plain_level(size: Column, style: Column) -> Column:
    """Heading level 1 to 3, 0 for text, by the shorter rules."""
    bold = is_bold(style)
    return (
        F.when((size >= F.col("h1")) & bold, 1).when(size >= F.col("h1"), 2).when((size >= F.col("h2")) & bold, 2).when(size >= F.col("h2"), 3)
        .when((size >= F.col("h3")) & bold, 3).otherwise(0)
    )


def visual_lines(lines: DataFrame, page_aware: bool = False) -> DataFrame:
    """Add grp: 1, 2, ... for runs of lines, by y, whose neighbours are less than GAP apart.

    Lines of all pages are sorted together unless ``page_aware``.
    """
    by = [*(["page"] if page_aware else []), "y", *(["page"] if not page_aware else []), "seq"]
    order = Window.partitionBy("doc").orderBy(*by)
    far = F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) >= GAP, F.lit(True))
    if page_aware:
        far = far | F.coalesce(F.col("page") != F.lag("page").over(order), F.lit(True))
    numbered = lines.withColumn("place", F.row_number().over(order)).withColumn("far", far)
    up = Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("grp", F.sum(F.col("far").cast("int")).over(up)).drop("far")


def text_groups(lines: DataFrame, page_aware: bool = False) -> DataFrame:
    """A row a visual line: its lines in order, whether all are monospace, and the neighbours' too."""
    grouped = visual_lines(lines, page_aware).groupBy("doc", "grp").agg(
        F.sort_array(F.collect_list(F.struct("place", "text", "font_size", "style"))).alias("rows"), F.bool_and(is_mono(F.col("style"))).alias("mono"),
        F.bool_and(is_bold(F.col("style")) | (F.col("style") == "NORMAL")).alias("strong"),
    )
    order = Window.partitionBy("doc").orderBy("grp")
    near = F.coalesce(F.lag("mono").over(order), F.lit(False)) | F.coalesce(F.lead("mono").over(order), F.lit(False))
    return grouped.withColumn("near_mono", near).withColumn("last", F.lead("grp").over(order).isNull())


def book_groups(lines: DataFrame, page_aware: bool = False) -> DataFrame:
    """Groups with their kind (code, inline, h1 to h4, text) and text.

    The first code run opens a listing that is never closed; ``opens`` marks it.
    """
    groups = text_groups(lines, page_aware).join(size_statistics(lines), "doc").select("*", *book_thresholds())
    first = F.element_at("rows", 1)["font_size"].cast("double")
    code = F.col("mono") & (first <= MONO_SIZE)
    size = first + F.when(F.col("strong"), 0.5).otherwise(0.0)
    title = ~F.col("mono") & (F.size("rows") <= 2)
    kind = F.when(code & (F.size("rows") == 1) & ~F.col("near_mono"), "inline").when(code, "code")
    for k in (1, 2, 3, 4):
        kind = kind.when(title & (size >= F.col(f"h{k}")), f"h{k}")
    joined = F.array_join(F.transform("rows", lambda r: trim_ws(r["text"])), " ")
    plain = trim_ws(F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["text"]), " "), r"\s+", " "))
    kinds = groups.withColumn("kind", kind.otherwise("text"))
    text = F.when(F.col("kind") == "code", F.array_join(F.transform("rows", lambda r: rtrim_ws(r["text"])), "\n")).when(F.col("kind") == "inline", trim_ws(F.element_at("rows", 1)["text"]))
    text = text.when(F.col("kind") == "text", plain).otherwise(F.regexp_replace(joined, "^(= )+", ""))
    codes = F.sum((F.col("kind") == "code").cast("int")).over(Window.partitionBy("doc").orderBy("grp"))
    return kinds.withColumn("out", text).withColumn("opens", (F.col("kind") == "code") & (codes == 1))


def book_asciidoc(docs: DataFrame, lines: DataFrame, page_aware: bool = False) -> DataFrame:
    """doc and text: positioned ``lines`` (doc, page, seq, text, font_size, style, y) of ``docs`` (doc) as AsciiDoc.

    A document without lines is marked as empty.
    """
    groups = book_groups(lines, page_aware)
    order = Window.partitionBy("doc").orderBy("grp")
    first = F.lag("grp").over(order).isNull()
    # whether the text so far ends with a blank line: headings do
    blank_before = F.coalesce(F.lag("kind").over(order).isin("h1", "h2", "h3", "h4"), F.lit(False))
    kind, out, nl = F.col("kind"), F.col("out"), F.lit("\n")
    marks = F.expr("repeat('=', cast(substring(kind, 2, 1) as int))")
    part = (
        F.when(kind == "inline", F.concat(F.lit("`"), out, F.lit("`")))
        .when(kind == "code", F.concat(F.when(F.col("opens"), F.lit("[source,text]\n----\n")).otherwise(F.lit("")), out, nl))
        .when(kind == "text", F.concat(F.when(first | blank_before, F.lit("")).otherwise(F.lit(" ")), out, F.when(F.col("last"), F.lit("")).otherwise(nl)))
        .otherwise(F.concat(F.when(first | blank_before, F.lit("")).otherwise(nl), marks, F.lit(" "), out, F.lit("\n\n")))
    )
    made = groups.withColumn("part", part).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("grp", "part"))), lambda r: r["part"]), "").alias("text"))
    return docs.select("doc").join(made, "doc", "left").select("doc", F.coalesce(F.concat(rtrim_ws(F.col("text")), nl), F.lit(EMPTY)).alias("text"))


def plain_asciidoc(docs: DataFrame, lines: DataFrame, title: str, note: str) -> DataFrame:
    """The same by the shorter rules: a header, then each line as heading, text or part of a closed listing."""
    order = Window.partitionBy("doc").orderBy("page", "seq")
    sized = size_statistics(lines)
    sized = sized.select("doc", *(F.when(F.isnan(c), 0.0).otherwise(F.col(c)).alias(c) for c in ("max", "range"))).select("doc", *plain_thresholds())
    rows = lines.join(sized, "doc").withColumn("mono", is_mono(F.col("style")))
    rows = rows.withColumn("level", plain_level(F.col("font_size").cast("double"), F.col("style")))
    starts = F.col("mono") & ~F.coalesce(F.lag("mono").over(order), F.lit(False))
    ends = F.col("mono") & ~F.coalesce(F.lead("mono").over(order), F.lit(False))
    marked = rows.withColumn("starts", starts).withColumn("ends", ends)
    some = lambda c, *x: F.when(c, F.array(*x)).otherwise(F.array().cast("array<string>"))
    blank = F.lit("")
    heading = F.concat(F.expr("repeat('=', level)"), F.lit(" "), F.col("text"))
    out = F.when(F.col("mono"), F.concat(some(F.col("starts"), F.lit("[source,text]"), F.lit("----")), F.array("text"), some(F.col("ends"), F.lit("----"), blank)))
    out = out.when(trim_ws(F.col("text")) == "", F.array().cast("array<string>")).when(F.col("level") > 0, F.array(blank, heading, blank)).otherwise(F.array("text"))
    made = marked.withColumn("out", out).groupBy("doc").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "seq", "out"))), lambda r: r["out"])), "\n").alias("text"))
    head = F.lit(f"= {title}\n\n[NOTE]\n====\n{note}\n====\n\n")
    return docs.select("doc").join(made, "doc", "left").select("doc", F.coalesce(F.concat(rtrim_ws(F.concat(head, F.col("text"))), F.lit("\n")), F.lit(EMPTY)).alias("text"))
