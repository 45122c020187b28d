"""Document trees: from AsciiDoc, from and to JSON, and flat as relational rows.

A tree is an adjacency table (doc, node_id, parent_id, ordinal, depth, level, title, text): Spark
has no recursive struct.  ``path`` is the zero-padded chain of ordinals, by which preorder is a sort.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import bound_batches, give_back
from ..functions.ordering import place_in_group
from ..functions.text import split_lines, trim_ws
from ..session import staged

NODES = "doc string, path string, parent string, ordinal int, depth int, level int, title string, type string, text string"


def from_asciidoc(docs: DataFrame) -> DataFrame:
    """Nodes of ``docs`` (doc, text): a node a heading under the last heading of lower level, a node a paragraph under its section."""
    each = docs.select("doc", F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("pos", "line")).withColumn("t", trim_ws(F.col("line")))
    level = F.length(F.regexp_extract("t", r"^(={1,6})\s+\S", 1))
    order = Window.partitionBy("doc").orderBy("pos")
    lines = each.withColumn("level", level).withColumn("blank", (F.col("t") == "") | F.col("t").startswith("//"))
    starts = (F.col("level") > 0) | (~F.col("blank") & F.coalesce(F.lag("blank").over(order) | (F.lag("level").over(order) > 0), F.lit(True)))
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    blocks = lines.withColumn("block", F.sum((starts & ~F.col("blank")).cast("int")).over(up)).where(~F.col("blank"))
    nodes = blocks.groupBy("doc", "block").agg(F.min("pos").alias("pos"), F.max("level").alias("level"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda r: r["t"]), "\n").alias("text"))
    by_block = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the last heading of each level says which one is the nearest of lower level
    last = [F.last(F.when(F.col("level") == k, F.col("block")), ignorenulls=True).over(by_block) for k in range(1, 7)]
    linked = nodes.withColumns({f"last{k}": c for k, c in enumerate(last, 1)})
    above = F.greatest(*(F.when((F.col("level") == 0) | (F.col("level") > k), F.col(f"last{k}")) for k in range(1, 7)))
    named = linked.withColumn("parent_block", above)
    ordinal = (F.row_number().over(Window.partitionBy("doc", "parent_block").orderBy("block")) - 1).cast("int")
    title = F.when(F.col("level") > 0, trim_ws(F.regexp_replace("text", r"^=+\s+", ""))).otherwise(F.lit(""))
    return named.select(
        "doc", F.col("block").alias("node_id"), F.col("parent_block").alias("parent_id"), ordinal.alias("ordinal"), F.when(F.col("level") > 0, F.col("level")).otherwise(-1).cast("int").alias("level"),
        title.alias("title"), F.when(F.col("level") == 0, "paragraph").alias("type"), F.when(F.col("level") == 0, F.col("text")).alias("text"),
    )


#: Levels of a tree that are taken apart by expressions; what lies deeper is walked text by text.
LEVELS = 16


def parse_json(text: str):
    """What json.loads gives, for nesting of any depth; ValueError for invalid text."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    decoder = json.JSONDecoder()
    decoder.scan_once = json.scanner.py_make_scanner(decoder)  # calls of Python functions take no room on the C stack
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 4 * len(text) + 1000))
    try:
        return decoder.decode(text)
    finally:
        sys.setrecursionlimit(limit)


def _walked(subtrees: DataFrame) -> DataFrame:
    """Nodes of ``subtrees`` (doc, parent, depth, json): lists of nodes below a node, or at the root; for those too deep or odd for expressions."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in NODES.split(", ")]
        string = lambda x: x if isinstance(x, str) else None
        number = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 1 << 31 else 0
        many = lambda x: x if isinstance(x, list) else []
        for batch in batches:
            rows = []
            for doc, above, level, text in zip(batch["doc"], batch["parent"], batch["depth"], batch["json"], strict=True):
                try:
                    roots = parse_json(text or "[]")
                except ValueError:
                    continue
                todo = [(node, above or "", i, level) for i, node in enumerate(many(roots))][::-1]
                while todo:
                    node, parent, i, depth = todo.pop()
                    if not isinstance(node, dict):
                        continue
                    path = f"{parent}/{i:09d}"
                    rows.append((doc, path, parent or None, i, depth, number(node.get("level")), string(node.get("title")) or "", string(node.get("type")), string(node.get("text"))))
                    todo += [(c, path, j, depth + 1) for j, c in enumerate(many(node.get("children")))][::-1]
            yield pd.DataFrame(rows, columns=columns)
        give_back()

    bound_batches(subtrees.sparkSession)
    return subtrees.select("doc", "parent", "depth", "json").mapInPandas(walk, NODES)


def _typed(name: str, kind: str, as_: str) -> Column:
    """A node's value if it is of the kind that variants give it."""
    value = F.try_variant_get("node", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == kind, F.try_variant_get("node", f"$.{name}", as_))


def from_json(docs: DataFrame) -> DataFrame:
    """Nodes of ``docs`` (doc, json): each a list of nested {title, level, type, text, children}.

    Each text becomes a variant and its nodes' children are exploded level by level; a level is staged, so a huge
    tree's nodes are many tasks' work.  Texts nested more deeply than variants may be (1000 brackets), and what lies more than
    LEVELS levels deep, are walked text by text instead.  An invalid or missing text gives no nodes.  What isn't an object is no
    node; a level that isn't an integer is 0, and a title, type or text that isn't a string is missing.
    """
    texts = docs.select(F.col("doc").cast("string").alias("doc"), "json", F.try_parse_json("json").alias("v"))
    none = F.lit(None).cast("string")
    lists = texts.select("doc", none.alias("parent"), F.lit(0).alias("depth"), F.col("v").alias("list"))
    levels = []
    for depth in range(LEVELS):
        each = lists.lateralJoin(lists.sparkSession.tvf.variant_explode_outer(F.col("list").outer()))
        # of a list the keys are null; an object's fields are no nodes
        nodes = each.where("key is null and pos is not null").select("doc", "parent", F.col("pos").cast("int").alias("ordinal"), F.col("value").alias("node"))
        nodes = nodes.where(F.try_variant_get("node", "$", "map<string,variant>").isNotNull())
        path = F.concat(F.coalesce("parent", F.lit("")), F.lit("/"), F.lpad(F.col("ordinal").cast("string"), 9, "0"))
        level = _typed("level", "BIGINT", "bigint")
        rows = nodes.select(
            "doc", path.alias("path"), "parent", "ordinal", F.lit(depth).alias("depth"), F.when(F.abs(level) < 1 << 31, level).otherwise(0).cast("int").alias("level"), F.coalesce(_typed("title", "STRING", "string"), F.lit("")).alias("title"),
            _typed("type", "STRING", "string").alias("type"), _typed("text", "STRING", "string").alias("text"), F.try_variant_get("node", "$.children", "variant").alias("list"),
        )
        now = staged(rows, "tree-level")
        levels.append(now.drop("list"))
        lists = now.where("list is not null").select("doc", F.col("path").alias("parent"), F.lit(depth + 1).alias("depth"), "list")
        if lists.isEmpty():
            break
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    odd = texts.where("v is null and json is not null").select("doc", none.alias("parent"), F.lit(0).alias("depth"), "json")
    deep = lists.select("doc", "parent", "depth", F.to_json("list").alias("json")).unionByName(odd)
    return out if deep.isEmpty() else out.unionByName(_walked(deep))


def with_paths(nodes: DataFrame) -> DataFrame:
    """Add path to nodes with node_id, parent_id and ordinal, by doubling pointers.

    Each round joins every unfinished node with its ancestor's ancestor until none is left, so a tree of depth d takes
    log2(d) rounds.  A node whose parent isn't there is a root; a node on or below a cycle
    of parents has no root and gets a null path.
    """
    part = F.lpad(F.col("ordinal").cast("string"), 9, "0")
    now = staged(nodes.select("doc", "node_id", F.col("parent_id").alias("up"), F.concat(F.lit("/"), part).alias("path")), "paths")
    for _ in range(now.count().bit_length() + 1):  # more rounds than any path needs
        if now.where(F.col("up").isNotNull()).isEmpty():
            break
        above = now.select(F.col("doc").alias("d"), F.col("node_id").alias("n"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        joined = now.join(above, (F.col("doc") == F.col("d")) & (F.col("up") == F.col("n")), "left")
        now = staged(joined.select("doc", "node_id", F.col("up2").alias("up"), F.concat(F.coalesce("path2", F.lit("")), "path").alias("path")), "paths")
    return nodes.join(now.select("doc", "node_id", F.when(F.col("up").isNull(), F.col("path")).alias("path")), ["doc", "node_id"])


def is_paragraph(kind: Column, text: Column) -> Column:
    return F.coalesce(kind == "paragraph", F.lit(False)) | text.isNotNull()


def relational(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """book, documents and paragraphs of nodes (doc, path, parent, ordinal, level, title, type, text).

    Documents are numbered in preorder, by ranges, so one huge tree isn't one task's work; a paragraph at the root counts as a
    document of level -1.  The book's title is the first root's with a level above 0, else unknown.
    """
    marked = nodes.withColumn("paragraph", is_paragraph(F.col("type"), F.col("text"))).withColumn("level", F.when(F.col("paragraph"), -1).otherwise(F.col("level")))
    sections = marked.where(~F.col("paragraph") | F.col("parent").isNull())
    numbered = place_in_group(sections, "doc", ["path"], "id").withColumn("id", (F.col("id") + 1).cast("int"))
    ids = numbered.select(F.col("doc").alias("d"), F.col("path").alias("p"), F.col("id").alias("above"))
    documents = numbered.join(ids, (F.col("doc") == F.col("d")) & (F.col("parent") == F.col("p")), "left")
    documents = documents.select("doc", "id", "title", "level", F.col("above").alias("parent_id"), F.col("ordinal").alias("sort_order"))
    inner = marked.where(F.col("paragraph") & F.col("parent").isNotNull()).join(ids, (F.col("doc") == F.col("d")) & (F.col("parent") == F.col("p")))
    paragraphs = place_in_group(inner, "doc", ["path"], "id").withColumn("id", (F.col("id") + 1).cast("int")).select("doc", "id", F.col("above").alias("doc_id"), "text", (F.col("ordinal") + 1).alias("position"))
    first = F.min_by("title", F.when((F.col("level") > 0) & F.col("parent").isNull(), F.col("path")))
    book = marked.groupBy("doc").agg(F.coalesce(first, F.lit("unknown")).alias("title")).select("doc", F.lit(1).alias("id"), "title")
    return book, documents, paragraphs


def quoted(c: Column) -> Column:
    """A SQL string's inside: quotes doubled, then back slashes."""
    return F.replace(F.replace(c, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\"))


#: The tables of the script, and what it ends with.
DDL = (
    "CREATE TABLE IF NOT EXISTS book (\n    id BIGSERIAL PRIMARY KEY,\n    title TEXT NOT NULL,\n    created_at TIMESTAMP DEFAULT NOW()\n);",
    "CREATE TABLE IF NOT EXISTS documents (\n    id BIGSERIAL PRIMARY KEY,\n    book_id BIGINT REFERENCES book(id) ON DELETE CASCADE,\n    title TEXT NOT NULL,\n    level INTEGER NOT NULL,\n    parent_id BIGINT REFERENCES documents(id) ON DELETE CASCADE,\n    sort_order INTEGER NOT NULL\n);",
    "CREATE TABLE IF NOT EXISTS paragraphs (\n    id BIGSERIAL PRIMARY KEY,\n    doc_id BIGINT REFERENCES documents(id) ON DELETE CASCADE,\n    text TEXT NOT NULL,\n    position INTEGER NOT NULL\n);",
)


SCRIPT_END = ("SELECT setval('book_id_seq', (SELECT COALESCE(MAX(id), 1) FROM book));", "SELECT setval('documents_id_seq', (SELECT COALESCE(MAX(id), 1) FROM documents));", "COMMIT;")


def script_rows(nodes: DataFrame) -> DataFrame:
    """doc, part, id and line: the inserts of the script, in order by part and id."""
    book, documents, paragraphs = relational(nodes)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    return (
        book.select("doc", F.lit(1).alias("part"), "id", F.concat(F.lit("INSERT INTO book (id, title) VALUES (1, '"), quoted(F.col("title")), F.lit("');")).alias("line"))
        .unionByName(documents.select("doc", F.lit(2).alias("part"), "id", F.concat(F.lit("INSERT INTO documents (id, book_id, title, level, parent_id, sort_order) VALUES ("), number("id"), F.lit(", 1, '"), quoted(F.col("title")), F.lit("', "), number("level"), F.lit(", "), number("parent_id"), F.lit(", "), number("sort_order"), F.lit(");")).alias("line")))
        .unionByName(paragraphs.select("doc", F.lit(3).alias("part"), "id", F.concat(F.lit("INSERT INTO paragraphs (doc_id, text, position) VALUES ("), number("doc_id"), F.lit(", '"), quoted(F.coalesce("text", F.lit(""))), F.lit("', "), number("position"), F.lit(");")).alias("line")))
    )


def sql_script(nodes: DataFrame) -> DataFrame:
    """doc and text: the tables and their rows as one transaction."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("part", "id", "line"))), lambda r: r["line"])
    grouped = script_rows(nodes).groupBy("doc").agg(lines.alias("rows"))
    script = F.concat(F.array(F.lit("BEGIN;"), *(F.lit(x) for x in DDL)), "rows", F.array(*(F.lit(x) for x in SCRIPT_END)))
    return grouped.select("doc", F.concat(F.array_join(script, "\n"), F.lit("\n")).alias("text"))


def script_lines(nodes: DataFrame) -> DataFrame:
    """doc, place and line of the whole script: what sql_script joins into one text, for scripts that are larger than a row may be."""
    inserts = staged(script_rows(nodes), "script-rows")
    frame = [(0, i, x) for i, x in enumerate(("BEGIN;", *DDL))] + [(4, i, x) for i, x in enumerate(SCRIPT_END)]
    around = inserts.select("doc").distinct().select("doc", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(i).alias("id"), F.lit(x).alias("line")) for p, i, x in frame))).alias("f")).select("doc", "f.*")
    placed = place_in_group(inserts.unionByName(around), "doc", ["part", "id"], "place")
    return placed.select("doc", "place", "line")
