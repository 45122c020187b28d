"""An ontology from DDL text: contexts, aggregates and value objects over the foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_text, trim_ws
from ..session import staged

#: The patterns by which DDL is read, and the words that begin constraints and not columns.
TABLE = r"(?s)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*?)\)\s*;"
REFERENCE = r"(?i)(\w+)\s+\w+.*?REFERENCES\s+(\w+)\s*\(\w+\)(?:\s+ON\s+DELETE\s+CASCADE)?"
CASCADE = r"(?i)(\w+)\s+\w+.*?REFERENCES\s+(\w+)\s*\(\w+\)\s+ON\s+DELETE\s+CASCADE"
NOT_COLUMNS = ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK")


def tables(scripts: DataFrame) -> DataFrame:
    """A row a table of ``scripts`` (doc, sql): place of declaration, columns, references, cascades."""
    both = F.arrays_zip(F.regexp_extract_all("sql", F.lit(TABLE), F.lit(1)).alias("name"), F.regexp_extract_all("sql", F.lit(TABLE), F.lit(2)).alias("body"))
    each = scripts.select("doc", F.posexplode(both).alias("place", "t")).select("doc", "place", F.col("t.name").alias("name"), F.col("t.body").alias("body"))
    parts = F.transform(F.split("body", ",", -1), trim_ws)
    words = F.transform(F.filter(parts, lambda p: ~p.startswith("--")), lambda p: F.regexp_extract(p, r"^\s*(\w+)\s+", 1))
    columns = F.filter(words, lambda w: (w != "") & ~w.isin(*NOT_COLUMNS))
    refs = F.array_distinct(F.regexp_extract_all("body", F.lit(REFERENCE), F.lit(2)))
    return each.select("doc", "place", "name", columns.alias("columns"), refs.alias("refs"), F.regexp_extract_all("body", F.lit(CASCADE), F.lit(2)).alias("cascades"))


def _least_labels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The least place reachable from each vertex: labels spread along edges and jump ahead until nothing changes."""
    now = staged(vertices.select("doc", "name", F.col("place").alias("label")), "labels")
    while True:
        spread = edges.join(now.select(F.col("doc").alias("d"), F.col("name").alias("n"), "label"), (F.col("doc") == F.col("d")) & (F.col("b") == F.col("n"))).select("doc", F.col("a").alias("name"), "label")
        near = now.unionByName(spread).groupBy("doc", "name").agg(F.min("label").alias("label"))
        # a label names the vertex declared there, whose own label may already be smaller
        at = vertices.select(F.col("doc").alias("vd"), F.col("place").alias("vp"), F.col("name").alias("vn")).join(now.select(F.col("doc").alias("nd"), F.col("name").alias("nn"), F.col("label").alias("jump")), (F.col("vd") == F.col("nd")) & (F.col("vn") == F.col("nn"))).select("vd", "vp", "jump")
        new = staged(near.join(at, (F.col("doc") == F.col("vd")) & (F.col("label") == F.col("vp")), "left").select("doc", "name", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        old = now.select(F.col("doc").alias("od"), F.col("name").alias("on"), F.col("label").alias("ol"))
        moved = new.join(old, (F.col("doc") == F.col("od")) & (F.col("name") == F.col("on"))).where(F.col("label") != F.col("ol"))
        now = new
        if moved.isEmpty():
            return now


def contexts(scripts: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """doc, place, name and tables: the connected components of the foreign keys, in order of declaration.

    Tables that are only referred to belong to a component too.  All of a document's contexts have
    the title of ``titles`` (doc, title) if there is one, else bc_1, bc_2, ....
    """
    found = staged(tables(scripts), "tables")
    declared = found.groupBy("doc", "name").agg(F.min("place").alias("place"))
    edges = found.select("doc", F.col("name").alias("a"), F.explode("refs").alias("b"))
    edges = staged(edges.unionByName(edges.select("doc", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "references")
    only = edges.select("doc", F.col("a").alias("name")).distinct().join(declared, ["doc", "name"], "left_anti")
    # tables that aren't declared are placed behind all that are
    rest = only.withColumn("place", F.lit(1 << 20) + F.row_number().over(Window.partitionBy("doc").orderBy("name")))
    labels = _least_labels(staged(declared.unionByName(rest), "vertices"), edges)
    grouped = labels.groupBy("doc", "label").agg(F.sort_array(F.collect_set("name")).alias("tables"))
    numbered = grouped.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("label")))
    name = F.concat(F.lit("bc_"), F.col("place").cast("string"))
    if titles is None:
        return numbered.select("doc", "place", name.alias("name"), "tables")
    named = titles.select(F.col("doc").alias("td"), F.when(trim_ws(F.col("title")) != "", F.col("title")).alias("title"))
    return numbered.join(named, F.col("doc") == F.col("td"), "left").select("doc", "place", F.coalesce("title", name).alias("name"), "tables")


def aggregates(scripts: DataFrame) -> DataFrame:
    """doc, root and dependents: declared tables that others refer to with a cascading delete."""
    found = tables(scripts)
    edges = found.select("doc", "name", F.explode("cascades").alias("root")).where("name <> root")
    grouped = edges.groupBy("doc", "root").agg(F.sort_array(F.collect_set("name")).alias("dependents"))
    return grouped.join(found.select("doc", F.col("name").alias("root")).distinct(), ["doc", "root"], "left_semi")


def as_json(scripts: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """doc and text: each script's contexts, aggregates and value objects as one JSON object."""
    order = lambda rows: F.transform(F.sort_array(F.collect_list(rows)), lambda r: r["v"])
    bounded = contexts(scripts, titles).groupBy("doc").agg(order(F.struct("place", F.struct("name", "tables").alias("v"))).alias("boundedContexts"))
    roots = aggregates(scripts).groupBy("doc").agg(order(F.struct("root", F.struct(F.col("root").alias("rootTable"), F.col("dependents").alias("dependentTables")).alias("v"))).alias("aggregates"))
    places = tables(scripts).groupBy("doc", "name").agg(F.min("place").alias("place"))
    values = value_objects(scripts).join(places, ["doc", "name"]).groupBy("doc").agg(order(F.struct("place", F.struct(F.col("name").alias("table"), "columns").alias("v"))).alias("valueObjects"))
    every = scripts.select("doc").distinct().join(bounded, "doc", "left").join(roots, "doc", "left").join(values, "doc", "left")
    parts = [F.coalesce(c, F.array().cast(every.schema[c].dataType)).alias(c) for c in ("boundedContexts", "aggregates", "valueObjects")]
    return every.select("doc", json_text(F.struct(*parts)).alias("text"))


def value_objects(scripts: DataFrame) -> DataFrame:
    """doc, name and columns of the tables that refer to none."""
    found = tables(scripts)
    return found.join(found.where(F.size("refs") > 0).select("doc", "name"), ["doc", "name"], "left_anti").select("doc", "name", "columns")
