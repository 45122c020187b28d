"""AsciiDoc to Markdown: a state machine over lines, as windows.

Which lines are in code depends on the last marker before; how many blank lines
are pending depends on the lines since the last one that resets the count.  Both are
running windows over the lines of a document; each line then emits its own lines by the first
rule that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import after, before, rtrim_ws, split_lines, trim_ws

#: The blocks that become block quotes.
ADMONITIONS = ("[NOTE]", "[CAUTION]", "[WARNING]", "[TIP]", "[IMPORTANT]")
FULL, PLAIN = "full", "plain"


def _none() -> Column:
    return F.array().cast("array<string>")


def _lines(docs: DataFrame) -> DataFrame:
    each = docs.select("doc", F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("pos", "line")).withColumn("t", trim_ws(F.col("line")))
    raw = Window.partitionBy("doc").orderBy("pos")
    return each.withColumn("next", F.lead("t").over(raw)).where(~F.col("t").startswith("//"))


def classify(docs: DataFrame, rules: str = FULL, fenced: bool = False) -> DataFrame:
    """A row a line of ``docs`` (doc, text): its rule, whether it is in code, and the blanks pending before it.

    ``rules``: the full set, or the plain one (no titles, tables, images, links, lists; headings need
    white space).  As the format has long been read here, the ---- right after
    [source,...] ends the code at once, and the code is taken as text; with ``fenced`` that line opens it.
    """
    t = F.col("t")
    up = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.lag("t").over(Window.partitionBy("doc").orderBy("pos"))
    opener = (t == "----") & F.coalesce(previous.startswith("[source,"), F.lit(False)) if fenced else F.lit(False)
    marker = F.when(t.startswith("[source,"), True).when((t == "----") & ~opener, False)
    lines = _lines(docs).withColumn("opener", opener).withColumn("marker", marker)
    lines = lines.withColumn("in_code", F.coalesce(F.last("marker", ignorenulls=True).over(up), F.lit(False)))
    heading = t.startswith("=") if rules == FULL else t.rlike(r"^=+\s+.+$")
    if rules == FULL:
        admonition = F.lit(False)
        for name in ADMONITIONS:
            admonition = admonition | t.startswith(name)
    else:
        admonition = t.rlike(r"^\[\p{Lu}.*\]$")
    rule = (
        F.when(F.col("in_code") & (t == "----") & ~F.col("opener"), "code_end").when(F.col("in_code") & F.col("opener"), "skip").when(F.col("in_code"), "code")
        .when(t == "----", "skip").when(t.startswith("[source,"), "code_start").when(admonition, "admonition").when(t == "====", "example").when(heading, "heading")
    )
    if rules == FULL:
        rule = (
            rule.when(t.startswith(".Table") | (t.startswith(".") & F.coalesce(F.col("next").startswith("|==="), F.lit(False))), "table_title")
            .when(t.startswith("|==="), "table_edge").when(t.startswith("|"), "table_row").when(t == "", "blank").when(t.startswith("image:"), "image")
            .when(t.startswith("link:") | t.startswith("http"), "link").when(t.startswith("* ") | t.startswith("- ") | t.startswith("** "), "item")
            .when(t.startswith(".") & ~t.startswith(".."), "title")
        )
    rule = rule.when(t == "", "blank").otherwise("text")
    ruled = lines.withColumn("rule", rule)
    run = F.sum((F.col("rule") == "code_start").cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0))
    coded = ruled.withColumn("run", run)
    in_run = Window.partitionBy("doc", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.count(F.when(F.col("rule") == "code", F.lit(1))).over(in_run)  # code lines of the run so far
    language = F.first(F.when(F.col("rule") == "code_start", F.regexp_extract("t", r"\[source,(\w+)\]", 1)), ignorenulls=True).over(in_run)
    coded = coded.withColumn("held", held).withColumn("language", F.coalesce(F.nullif(language, F.lit("")), F.lit("text")))
    keeps = F.col("rule").isin("code", "skip", "code_start", "blank") | ((F.col("rule") == "code_end") & (F.col("held") == 0))
    counted = coded.withColumn("grp", F.coalesce(F.sum((~keeps).cast("int")).over(up), F.lit(0)))
    in_group = Window.partitionBy("doc", "grp").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("pending", F.coalesce(F.sum((F.col("rule") == "blank").cast("int")).over(in_group), F.lit(0)))


def _emitted(rules: str) -> Column:
    t, blank, rule = F.col("t"), F.lit(""), F.col("rule")
    some = F.when(F.col("pending") > 0, F.array(blank)).otherwise(_none())
    two = F.when(F.col("pending") >= 2, F.array(blank)).otherwise(_none())
    rest = lambda n: trim_ws(F.substring(t, n + 1, 1 << 30))
    bare = F.when(t.endswith("]"), F.regexp_extract(t, r"^\[?(.*)\]$", 1)).otherwise(t)
    label = F.concat(F.upper(F.left(bare, F.lit(1))), F.lower(F.substring(bare, 2, 1 << 30)))
    marks = F.length(F.regexp_extract(t, "^(=+)", 1))
    title = trim_ws(F.regexp_replace(t, "^=+", ""))
    inside = before(after(t, "["), "]")
    name = before(after(t, "link:"), "[")
    target = F.when(inside != "", inside).when(name != "", name).otherwise(t)
    cells = F.transform(F.slice(F.split(F.regexp_replace(t, r"(\|\s*)+$", ""), r"\|"), 2, 1 << 30), trim_ws)
    body = F.regexp_replace(t, r"pass:\[([^\]]*)\]", "$1") if rules == FULL else t
    item = F.when(t.startswith("*"), rest(1)).otherwise(rest(2))
    return (
        # code is emitted line by line, a fence before the first
        F.when((rule == "code") & (F.col("held") == 1), F.array(F.concat(F.lit("```"), F.col("language")), F.col("line"))).when(rule == "code", F.array("line"))
        .when((rule == "code_end") & (F.col("held") > 0), F.array(F.lit("```"), blank))
        .when(rule == "admonition", F.array(F.concat(F.lit("> **"), label, F.lit("**"))))
        .when(rule.isin("example", "table_edge"), F.array(blank))
        .when(rule == "heading", F.concat(some, F.array(F.concat(F.expr("repeat('#', least(length(regexp_extract(t, '^(=+)', 1)), 6))"), F.lit(" "), title), blank)))
        .when(rule == "table_title", F.array(blank, F.concat(F.lit("**"), rest(1), F.lit("**")), blank))
        .when(rule == "table_row", F.array(F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))))
        .when(rule == "image", F.array(F.concat(F.lit("!["), before(after(t, "image:"), "["), F.lit("]("), inside, F.lit(")")), blank))
        .when(rule == "link", F.array(F.concat(F.lit("["), F.when(name != "", name).otherwise(target), F.lit("]("), target, F.lit(")"))))
        .when(rule == "item", F.concat(some, F.array(F.concat(F.lit("- "), item))))
        .when(rule == "title", F.concat(some, F.array(F.concat(F.lit("- "), rest(1)))))
        .when(rule == "text", F.concat(two, F.array(body)))
        .otherwise(_none())
    )


def to_markdown(docs: DataFrame, rules: str = FULL, fenced: bool = False) -> DataFrame:
    """doc and text: ``docs`` (doc, text) as Markdown; a null or empty text gives one line break."""
    lines = classify(docs, rules, fenced).withColumn("out", _emitted(rules))
    # code still open at the end is closed
    tail = F.max(F.struct("pos", "rule"))
    grouped = lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "out"))).alias("o"), tail.alias("e"))
    end = F.when(F.col("e.rule") == "code", F.array(F.lit("```"))).otherwise(_none())
    text = F.array_join(F.concat(F.flatten(F.transform("o", lambda x: x["out"])), end), "\n")
    made = grouped.select("doc", F.concat(rtrim_ws(text), F.lit("\n")).alias("text"))
    return docs.select("doc").join(made, "doc", "left").select("doc", F.coalesce("text", F.lit("\n")).alias("text"))
