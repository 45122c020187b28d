"""Small cases with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataloom.functions import ordering
from strataloom.operators import asciidoc, chunking, context, enrich, html, ingest, knowledge_base, licences, ocr, ontology, pipeline, profiles, trees, typography


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("font", "style"),
    [("Courier", "MONOSPACE"), ("CourierNew-Bold", "MONOSPACE"), ("DejaVuMono", "MONOSPACE"), ("JetBrains Mono", "MONOSPACE"), ("Helvetica-Bold", "BOLD"), ("Inter-Black", "BOLD"), ("DIN bd Regular", "BOLD"),
     ("DIN-bd-Regular", "NORMAL"), ("Times-Italic", "ITALIC"), ("Slanted", "ITALIC"), ("Helvetica it Regular", "ITALIC"), ("Helvetica-BoldItalic", "BOLD_ITALIC"), ("Times-BoldOblique", "BOLD_ITALIC"), ("Helvetica", "NORMAL"), ("", "NORMAL")],
)
def test_font_style(spark, font, style):
    assert one(spark, typography.font_style(F.col("f")), f=font) == style


@pytest.mark.parametrize(
    ("text", "zone"),
    [("Apache License 2.0", "OSS"), ("see APACHE-2.0", "OSS"), ("Creative  Commons", "OSS"), ("CC-BY 4.0", "OSS"), ("CC0", "OSS"), ("acc0unt", "UNKNOWN"), ("© me", "CSS"), ("Copyright", "CSS"), ("All rights reserved", "CSS"),
     ("Apache License 2.0 copyright", "OSS"), ("", "UNKNOWN"), ("  ", "UNKNOWN"), ("plain", "UNKNOWN")],
)
def test_licence(spark, text, zone):
    assert one(spark, licences.detect(F.col("t")), t=text) == zone


def test_thresholds(spark):
    row = spark.createDataFrame([(20.0, 10.0), (12.0, 0.5)], "max double, range double").select(*typography.book_thresholds()).collect()
    assert [round(x, 6) for x in row[0]] == [19.5, 17.5, 15.0, 13.0]
    assert [round(x, 6) for x in row[1]] == [11.4, 9.0, 6.0, 4.2]


MARKDOWN = "lost\n# P\nFirst one. Second one! Third.\n## A\ntext\n```py\nx = 1  \n\ny\n```\n## B\n### b1\n\nEnd. More. Rest.\n```\nopen"


def test_chunks(spark):
    docs = spark.createDataFrame([("d", MARKDOWN, "L"), ("none", "a\nb", None), ("blank", " \n ", None), ("null", None, "L")], "source_document string, text string, license string")
    rows = {(r.source_document, r.pos): r for r in chunking.chunk_documents(docs).collect()}
    assert [rows["d", k].section_path for k in (1, 2, 3, 4)] == ["P", "P > A", "P > B", "P > A > B > b1"]
    assert rows["d", 1].content == "# P\nFirst one. Second one! Third." and rows["d", 2].code_blocks == ["x = 1  \n\ny"]
    assert rows["d", 1].overlap_next == "text x = 1 y" or rows["d", 1].overlap_next.startswith("text")
    assert rows["d", 4].code_blocks == [] and rows["d", 4].overlap_next is None and rows["d", 3].overlap_next == "End. More."
    assert rows["none", 0].heading_level == 0 and rows["none", 0].section_path == "none" and rows["none", 0].license == "UNKNOWN"
    assert all(r.id.startswith("chk-") and len(r.id) == 20 for r in rows.values()) and not any(s in ("blank", "null") for s, _ in rows)
    strict = {r.pos: r.section_path for r in chunking.chunk_documents(docs, strict_ancestors=True).collect() if r.source_document == "d"}
    assert strict[4] == "P > B > b1"


def test_markdown_rules(spark):
    text = "= T\n\n\npara\n[source,java]\n----\nint x;\n----\nimage:a.png[Alt]\nlink:x[http://y]\n|===\n|a |b\n|===\n// gone\n* one\n** two\n.Step\n[NOTE]\n====\nbody\n===="
    docs = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "doc string, text string")
    out = {r.doc: r.text for r in asciidoc.to_markdown(docs).collect()}
    assert out["d"] == "# T\n\n\npara\nint x;\n![a.png](Alt)\n\n[x](http://y)\n\n| a | b |\n\n- one\n- * two\n- Step\n> **Note**\n\nbody\n"
    assert out["e"] == out["n"] == "\n"
    fenced = {r.doc: r.text for r in asciidoc.to_markdown(docs, fenced=True).collect()}
    assert "```java\nint x;\n```" in fenced["d"]


def test_book(spark):
    rows = [("d", 1, 1, "Title", 20.0, "BOLD", 10.0), ("d", 1, 2, "Body text", 11.0, "ITALIC", 30.0), ("d", 1, 3, "code()", 10.0, "MONOSPACE", 50.0), ("d", 1, 4, "more()", 10.0, "MONOSPACE", 60.0)]
    lines = spark.createDataFrame(rows, "doc string, page int, seq int, text string, font_size float, style string, y float")
    docs = spark.createDataFrame([("d",), ("e",)], "doc string")
    out = {r.doc: r.text for r in typography.book_asciidoc(docs, lines).collect()}
    assert out["e"] == typography.EMPTY and out["d"] == "= Title\n\nBody text\n[source,text]\n----\ncode()\nmore()\n"
    plain = {r.doc: r.text for r in pipeline.lines_to_asciidoc(docs, lines).collect()}
    assert plain["d"].endswith("= Title\n\nBody text\n[source,text]\n----\ncode()\nmore()\n----\n")
    chunks = pipeline.asciidoc_to_chunks(spark.createDataFrame([("d", plain["d"] + "\nApache-2.0")], "doc string, text string")).collect()
    assert {c.route for c in chunks} == {"OSS"}


def test_html():
    page = "<html><body><h2>A &amp; B</h2><p>x <b>y</b> <a href='u'>v</a><br>z<p>open<ul><li>one<li><i>two</i></ul><pre> c </pre><blockquote><p>q</p></blockquote><script>no</script></body>"
    assert html.asciidoc(page) == "== A & B\nx *y* v[u] +\nz\nopen\n\n* one\n* _two_\n\n[source,text]\n----\nc\n----\n[NOTE]\n==== q\n"
    assert html.asciidoc("") == "= [EPUB vide]\n\n" == html.asciidoc("<p>x", plain=True)


def test_tree(spark):
    text = '[{"title":"Book","level":1,"children":[{"title":"C1","level":2,"children":[{"type":"paragraph","text":"it\'s \\\\"}]},{"title":"C2","level":2}]},{"type":"paragraph","text":"root"}]'
    nodes = trees.from_json(spark.createDataFrame([("d", text), ("bad", "{"), ("empty", None)], "doc string, json string"))
    book, documents, paragraphs = trees.relational(nodes)
    assert [tuple(r) for r in book.collect()] == [("d", 1, "Book")]
    assert sorted(tuple(r)[1:] for r in documents.collect()) == [(1, "Book", 1, None, 0), (2, "C1", 2, 1, 0), (3, "C2", 2, 1, 1), (4, "", -1, None, 1)]
    assert [tuple(r)[2:] for r in paragraphs.collect()] == [(2, "it's \\", 1)]
    script = trees.sql_script(nodes).first().text
    assert "VALUES (2, 'it''s \\\\', 1);" in script and script.endswith("COMMIT;\n")
    deep = spark.createDataFrame([("d", i, i - 1 if i else None, 0) for i in range(20)], "doc string, node_id int, parent_id int, ordinal int")
    assert {r.node_id: r.path.count("/") for r in trees.with_paths(deep).collect()} == {i: i + 1 for i in range(20)}
    rows = trees.from_asciidoc(spark.createDataFrame([("d", "= T\n\nfirst\nline\n\n== S\nnext")], "doc string, text string")).orderBy("node_id").collect()
    assert [(r.level, r.title, r.text, r.parent_id) for r in rows] == [(1, "T", None, None), (-1, "", "first\nline", 1), (2, "S", None, 1), (-1, "", "next", 3)]


def test_ontology(spark):
    ddl = "".join(trees.DDL) + "CREATE TABLE audit (id INT, PRIMARY KEY (id));"
    scripts = spark.createDataFrame([("d", ddl), ("e", "")], "doc string, sql string")
    assert [(r.name, r.tables) for r in ontology.contexts(scripts).orderBy("place").collect()] == [("bc_1", ["book", "documents", "paragraphs"]), ("bc_2", ["audit"])]
    titles = spark.createDataFrame([("d", "Named")], "doc string, title string")
    assert {r.name for r in ontology.contexts(scripts, titles).collect()} == {"Named"}
    assert sorted((r.root, r.dependents) for r in ontology.aggregates(scripts).collect()) == [("book", ["documents"]), ("documents", ["paragraphs"])]
    assert {r.name: r.columns for r in ontology.value_objects(scripts).collect()} == {"book": ["id", "title", "created_at"], "audit": ["id"]}


def test_enrich(spark):
    nodes = spark.createDataFrame([(1, "Architecture", "Introduced by Eric Evans"), (2, " ", "x")], "node_id int, title string, text string")
    chunks = spark.createDataFrame([("c1", "Chapter 1 > architecture ", 1), ("c2", "Chapter 1 > Testing", 2)], "id string, section_path string, pos int")
    graph = spark.createDataFrame([("n2", "ARCHITECTURE"), ("n1", "Architecture"), ("n3", "other")], "id string, label string")
    first, second = enrich.enrich(nodes, chunks, graph).orderBy("node_id").collect()
    assert (first.chunk_ids, first.graph_ids, first.density, first.entities) == (["c1"], ["n1", "n2"], 0.5, ["Architecture Introduced", "Eric Evans"])
    assert (second.chunk_ids, second.graph_ids, second.density) == ([], [], 0.0)
    assert enrich.enrich(nodes, chunks.limit(0), graph).first().density == 0.0
    text = enrich.graph_section(enrich.enrich(nodes, chunks, graph).withColumn("g", F.lit(1)), "g", "node_id").first().text
    assert text == "Architecture\n- n1\n- n2"


def test_sort_key(spark):
    assert one(spark, knowledge_base.section_sort_key(F.col("p")), p="Chapter 2 > ab > 12345") == "Chapter 0002 >   ab > 12345"


def test_exports(spark):
    schema = "id string, source_document string, pos int, section_path string, heading_level int, content string, code_blocks array<string>, entities array<string>, overlap_next string, license string"
    chunks = spark.createDataFrame([("c2", "d", 2, "B 2", 1, "# B 2\nbody", ["x"], [], None, "L"), ("c1", "d", 1, "B 1", 1, "# B 1\n\none", [], [], "Next.", "L")], schema)
    assert knowledge_base.markdown(chunks).first().text == "# d\n\n\n# B 1\n\none\n\n> _Continued: Next._\n\n---\n\n# B 2\n\nbody\n\n```text\nx\n```\n\n---\n"
    assert knowledge_base.asciidoc(chunks).first().text.count("'''") == 2
    assert '"overlapNext":"null"' in knowledge_base.json_ld(chunks).first().text
    assert knowledge_base.export(chunks.limit(0), "markdown").count() == 0


def test_context(spark):
    results = spark.createDataFrame([(1, "t" * 600, "P", 1, "d", 0.91234)], "chunk_id long, chunk_text string, section_path string, heading_level int, source_document string, similarity double")
    assert len(context.entries(results, "s").first().chunk_text) == 500
    assert context.docs_section(results.withColumn("q", F.lit(1)), "q").first().text.startswith("[d / P] (similarity=0.912)\ntt")
    assert '"count":1' in context.composite_json(results, "q", 10, "s").first().text
    assert len(context.docs_section(results.withColumn("q", F.lit(1)), "q", total=1000).first().text) == 350


def test_ocr(spark):
    class Reader:
        def __init__(self, name, texts):
            self.name, self.texts = name, texts

        def process(self, content, mime, language):
            if content == b"boom":
                raise ValueError
            return self.texts.get(bytes(content), ""), 0.9

    pages = spark.createDataFrame([("p1", bytearray(b"a"), "image/png", "fr"), ("p2", bytearray(b"b"), "image/png", "fr"), ("p3", bytearray(b"boom"), "image/png", "fr")], "page_id string, content binary, mime string, language string")
    chain = [Reader("first", {b"a": "A"}), Reader("second", {b"b": "B"})]
    best = {r.page_id: (r.text, r.model) for r in ocr.first_success(ocr.run_engines(pages, chain)).collect()}
    assert best == {"p1": ("A", "first"), "p2": ("B", "second"), "p3": ("", "pipeline")}
    hashed = pages.select("page_id", ocr.content_hash(F.col("content")).alias("source_hash"))
    cache = hashed.where("page_id = 'p1'").withColumn("text", F.lit("old")).unionByName(spark.createDataFrame([("p2", "stale", "no")], "page_id string, source_hash string, text string"))
    assert sorted(r.page_id for r in ocr.cache_misses(hashed, cache).collect()) == ["p2", "p3"]
    fresh = spark.createDataFrame([("p2", "h", "B")], "page_id string, source_hash string, text string")
    assert {r.page_id: r.text for r in ocr.with_cache(hashed, cache, fresh).collect()} == {"p1": "old", "p2": "B", "p3": ""}
    assert {r.page_id: r.text for r in ocr.updated_cache(cache, fresh).collect()} == {"p1": "old", "p2": "B"}
    numbered = ocr.numbered_pages(spark.createDataFrame([("b", "x", "t"), ("b", "a", " ")], "book string, page_id string, text string"))
    assert {r.file_name: r.body for r in numbered.collect()} == {"001-a.adoc": ocr.EMPTY_PAGE, "002-x.adoc": "t"}
    assert ocr.book_text(numbered).first().text == f"= OCR Book\n\n== Page 1\n\n{ocr.EMPTY_PAGE}\n\n== Page 2\n\nt\n"
    assert one(spark, ocr.mime_type(F.col("p")), p="x.JPEG") == "image/jpeg" and one(spark, ocr.language_code(F.col("p")), p="French") == "fra" and one(spark, ocr.language_code(F.col("p")), p="Polski") == "pol"
    assert one(spark, ocr.response_text(F.col("p")), p='{"message":{"content":"hi"}}') == "hi" and one(spark, ocr.response_text(F.col("p")), p='{"response":"yo"}') == "yo"


def test_profiles(spark):
    from strataloom.functions.embedding import hashed_embedding

    schema = "learner_id string, formation_id string, completed_modules array<string>, current_module string, progression_pct double, comprehension_score double, weak_points array<string>, last_interaction_at string, annotations map<string,string>"
    store = profiles.ProfileStore(spark, hashed_embedding)
    store.save(spark.createDataFrame([("l", "f", ["m"], "m2", 10.0, 0.5, ["joins"], None, {"k": "note"}), ("l", "g", [], None, 0.0, 0.0, [], None, {})], schema))
    store.save(spark.createDataFrame([("l", "f", ["m", "n"], None, 20.0, 0.6, [], None, {})], schema))
    row = store.load("l", "f").first()
    assert row.progression_pct == 20.0 and row.completed_modules == ["m", "n"] and row.current_module is None and len(row.embedding) == 384
    assert store.load("l", "g").first().embedding is None and store.load("x", "f").count() == 0
    assert row.created_at <= row.updated_at


def test_trees_of_any_depth(spark, tmp_path):
    text = '{"title":"t","level":2,"children":['
    deep = f"[{text * 5000}{']}' * 5000}]"
    odd = '[1, "x", null, {"title": 3, "level": "two", "children": {"a": 1}}, {"children": [[], {"text": "in", "type": "paragraph"}]}]'
    docs = spark.createDataFrame([("deep", deep), ("odd", odd), ("bad", deep[:-3]), ("worse", deep[:-2] + ",}]")], "doc string, json string")
    counts = {r.doc: (r["count"], r.depth) for r in trees.from_json(docs).groupBy("doc").agg(F.count("*").alias("count"), F.max("depth").alias("depth")).collect()}
    assert counts == {"deep": (5000, 4999), "odd": (3, 1)}
    chain = spark.createDataFrame([("d", i, i - 1 if i else None, 0) for i in range(100)] + [("c", 1, 2, 0), ("c", 2, 1, 0), ("c", 3, 2, 0), ("c", 4, 9, 0)], "doc string, node_id int, parent_id int, ordinal int")
    found = {(r.doc, r.node_id): r.path for r in trees.with_paths(chain).collect()}
    assert all(found["d", i].count("/") == i + 1 for i in range(100))
    assert [found["c", i] for i in (1, 2, 3, 4)] == [None, None, None, "/000000000"]
    assert trees.with_paths(chain.limit(0)).count() == 0


def test_json_of_any_depth():
    for text in ('{"a": [1, 2.5e3, true, null, "q\\"\\\\"], "b": {}}', "[]", '"x"', "3"):
        assert trees.parse_json(text) == json.loads(text)
    deep = trees.parse_json("[" * 200_000 + '{"a": [1, {}], "b": "]"}' + "]" * 200_000)
    for _ in range(200_000):
        (deep,) = deep
    assert deep == {"a": [1, {}], "b": "]"}
    nested = "[" * 200_000
    for bad in (nested, nested + "]" * 199_999, nested + "1 2" + "]" * 200_000, nested + "]" * 200_000 + "]", nested + "{1:2}" + "]" * 200_000, nested + "{,}" + "]" * 200_000, nested + "[1,]" + "]" * 200_000):
        with pytest.raises(ValueError):
            trees.parse_json(bad)


def plain_paths(heads, strict):
    """Paths of (level, title) by the rules as said."""
    out = []
    for i, (level, title) in enumerate(heads):
        start = max((j for j in range(i + 1) if heads[j][0] == 1), default=0)
        above = [h for h in heads[start:i] if h[0] < level]
        if strict:
            kept = []
            for h in above[::-1]:
                if not kept or h[0] < kept[0][0]:
                    kept.insert(0, h)
            above = kept
        out.append(" > ".join([t for _, t in above] + [title]))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_paths_of_any_headings(spark, strict):
    rng = random.Random(5)
    docs = [[(rng.choice([1, 2, 2, 3, 3, 4, 5, 6]), f"t{rng.randrange(30)}") for _ in range(rng.randrange(1, 40))] for _ in range(40)]
    rows = [(f"d{k}", "\n".join(f"{'#' * n} {t}\nbody" for n, t in heads), None) for k, heads in enumerate(docs)]
    found = chunking.sections(spark.createDataFrame(rows, "source_document string, text string, license string"), strict)
    got = {}
    for r in found.orderBy("source_document", "sec").collect():
        got.setdefault(r.source_document, []).append(r.path)
    assert got == {f"d{k}": plain_paths(heads, strict) for k, heads in enumerate(docs)}


def test_code_of_many_blocks(spark):
    text = "# T\n" + "".join(f"```py\nx{i}\n\ny \n```\ntext {i}\n" for i in range(300)) + "```\nopen"
    row = chunking.sections(spark.createDataFrame([("d", text, None)], "source_document string, text string, license string")).first()
    assert row.code_blocks == [f"x{i}\n\ny" for i in range(300)] and row.lines[-1] == "open"


def test_order_is_split(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"s{i}", i) for i in range(3000)], "source_document string, pos int").repartition(5)
    found = ingest.with_chunk_index(rows).collect()
    places = {}
    for r in sorted(found, key=lambda r: r.pos):
        assert r.chunk_index == places.get(r.source_document, 0)
        places[r.source_document] = r.chunk_index + 1
    assert ordering.numbered(rows.limit(0), ["pos"], "n").count() == 0


def test_profiles_open_again(spark, tmp_path):
    path = str(tmp_path / "p")
    row = ("l", "f", ["m"], "m2", 10.0, 0.5, ["joins"], None, {"k": "note"})
    schema = ", ".join(profiles.SCHEMA.split(", ")[:9])
    profiles.ProfileStore(spark, path=path).save(spark.createDataFrame([row], schema))
    (tmp_path / "p/v2").mkdir(parents=True)  # a write that was broken off
    store = profiles.ProfileStore(spark, path=path)
    assert store.table.version == 1 and store.load("l", "f").first().progression_pct == 10.0
    store.save(spark.createDataFrame([(*row[:4], 20.0, *row[5:])], schema))
    assert profiles.ProfileStore(spark, path=path).load("l", "f").first().progression_pct == 20.0
