"""Readers, sinks and streaming over small files."""

import json
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions.embedding import hashed_embedding, hashed_vector
from strataloom.operators import enrich, ocr
from strataloom.operators.chunking import chunk_documents
from strataloom.sources import readers, sinks
from strataloom.sources.versions import VersionedTable
from strataloom.streaming.ingest import ingest_folder


def test_texts_and_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/book.md").write_text("# A\nSome text.\n## B\nmore")
    docs = readers.read_texts(spark, str(tmp_path / "in"), "L")
    assert docs.first().source_document == "book"
    (tmp_path / "c.json").write_text(sinks.chunks_json(chunk_documents(docs)).first().text)
    back = readers.read_chunks(spark, str(tmp_path / "c.json")).collect()
    assert [c.section_path for c in back] == ["A", "A > B"] and back[1].overlap_next is None
    (tmp_path / "d.json").write_text('[{"id":"x","sourceDocument":"s","sectionPath":"p","headingLevel":1,"content":"c","other":1}]')
    assert readers.read_chunks(spark, str(tmp_path / "d.json")).first().license == "UNKNOWN"


def test_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes":[{"id":"1","label":"L","type":"t"}],"extra":0}')
    (tmp_path / "bad.json").write_text("{nodes")
    assert [r.id for r in readers.read_graph(spark, str(tmp_path / "g.json")).collect()] == ["1"]
    assert readers.read_graph(spark, str(tmp_path / "bad.json")).count() == 0 == readers.read_graph(spark, str(tmp_path / "missing.json")).count()


def test_binary_sources(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert sorted(r.page_id for r in readers.read_images(spark, str(tmp_path)).collect()) == ["a", "b"]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/x.pdf").write_bytes(b"one|two")
    lines = readers.read_positioned_lines(spark, str(tmp_path / "pdf"), lambda c: [(1, i, t, "Helvetica", 11.0, 20.0 * i) for i, t in enumerate([*c.decode().split("|"), " "])])
    assert sorted(r.text for r in lines.collect()) == ["one", "two"]
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<rootfiles><rootfile full-path="O/p.opf"/></rootfiles>')
        z.writestr("O/p.opf", '<manifest><item id="i" href="t.xhtml"/></manifest><spine><itemref idref="i"/></spine>')
        z.writestr("O/t.xhtml", "<html><body><h1>T</h1><p>x</p></body></html>")
    (tmp_path / "e").mkdir()
    (tmp_path / "b.epub").rename(tmp_path / "e/b.epub")
    (tmp_path / "e/broken.epub").write_bytes(b"no zip")
    assert {r.source_document: r.text for r in readers.read_epubs(spark, str(tmp_path / "e")).collect()} == {"b": "= T\nx\n", "broken": "= [EPUB vide]\n\n"}
    kinds = spark.createDataFrame([("x.PDF",), ("y.epub",)], "p string").select(readers.dispatch(F.col("p"))).collect()
    assert [k[0] for k in kinds] == ["pdf", "epub"]
    with pytest.raises(Exception, match="unsupported format"):
        spark.createDataFrame([("x.doc",)], "p string").select(readers.dispatch(F.col("p"))).collect()


def test_cache_and_profiles(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/p1.ocr-cache.json").write_text(json.dumps({"sourceHash": "h", "result": {"structuredText": "t", "confidence": 0.9, "metadata": {"a": "b"}}}))
    (tmp_path / "cache/p2.ocr-cache.json").write_text("corrupt")
    assert [tuple(r) for r in readers.read_ocr_cache(spark, str(tmp_path / "cache")).collect()] == [("p1", "h", "t", 0.9, None)]
    (tmp_path / "p.json").write_text('{"learnerId":"l","formationId":"f","weakPoints":["w"],"annotations":{"k":"v"}}')
    row = readers.read_profiles(spark, str(tmp_path / "p.json")).first()
    assert row.weak_points == ["w"] and row.progression_pct == 0.0 and row.annotations == {"k": "v"}


def test_store_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Machine learning\nModels learn from data.\n# French cuisine\nButter and cream.")
    store = sinks.ChunkStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_folder(spark, str(tmp_path / "in"), store, hashed_embedding, str(tmp_path / "ck")).awaitTermination()
        (tmp_path / "in/b.md").write_text("# Neural networks\nLayers of neurons learn.")
    assert store.table("documents").count() == 2 and sorted(r.id for r in store.table("chunks").collect()) == [1, 2, 3]
    best = store.search(hashed_vector("butter cream cuisine"), 2).collect()
    assert best[0].section_path == "French cuisine" and best[0].source_document == "a" and len(best) == 2
    assert store.search([], 2).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("OSS", "x"), ("CSS", "y"), ("UNKNOWN", "z")], "zone string, text string")
    sinks.write_routed(rows, str(tmp_path / "routed"))
    assert sorted(p.name for p in (tmp_path / "routed").glob("route=*")) == ["route=OSS", "route=office"]
    sinks.write_texts(rows, str(tmp_path / "t"), by="zone")
    assert spark.read.text(str(tmp_path / "t/name=OSS")).first().value == "x"
    sinks.write_metadata(spark, str(tmp_path / "m"), "kind", 3)
    assert '"sessions": 3' in "\n".join(r.value for r in spark.read.text(str(tmp_path / "m")).collect())


def test_whole_files(spark, tmp_path):
    from strataloom.operators import pipeline

    def parse_runs(content):
        """A stand-in for a parser: a run a line, page|number|font|sizes|y|text."""
        rows = [line.split("|", 5) for line in content.decode().splitlines()]
        return [(int(page), int(n), text, font, [float(x) for x in sizes.split(",")], float(y)) for page, n, font, sizes, y, text in rows]

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(b"1|1|Helvetica-Bold|20|10|Title\n1|2|Helvetica|10|30|Body, Apache-2.0\n1|3|Helvetica|10|30|same line")
    (tmp_path / "in/b.pdf").write_bytes(b"1|1|F|1|1| ")
    (tmp_path / "in/c.epub").write_bytes(b"no archive")
    found = pipeline.auto_detect(readers.read_files(spark, str(tmp_path / "in")), parse_runs, "MIT")
    rows = {r.name: r for r in found.collect()}
    assert rows["a.PDF"].route == "OSS" and rows["a.PDF"].license == "MIT" and "\n= Title\n\nBody, Apache-2.0\nsame line\n" in rows["a.PDF"].text
    assert rows["b.pdf"].text == "= [Document vide]\n\n" and rows["c.epub"].text == "= [EPUB vide]\n\n" and rows["c.epub"].route == "office"
    assert {r.source_document for r in pipeline.chunks_of(found).collect()} >= {"a.PDF"}
    pipeline.write(found, str(tmp_path / "out"), routed=True)
    assert sorted(str(p.relative_to(tmp_path / "out/texts")) for p in (tmp_path / "out/texts").rglob("*.adoc")) == ["OSS/a.adoc", "office/b.adoc", "office/c.adoc"] and (tmp_path / "out/metadata").exists()
    (tmp_path / "in/d.doc").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported format"):
        pipeline.auto_detect(readers.read_files(spark, str(tmp_path / "in")), parse_runs).collect()
    broken = spark.createDataFrame([("x.pdf", bytearray(b"1|x")), ("y.pdf", bytearray(b"1|1|F|10|10|Copyright"))], "path string, content binary")
    assert {r.path: r.zone for r in readers.licences_of(broken, parse_runs).collect()} == {"x.pdf": "UNKNOWN", "y.pdf": "CSS"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "config.json").write_text('{"provider":"p","model":"m","temperature":0.5}')
    row = readers.read_ocr_config(spark, str(tmp_path / "config.json")).first()
    assert (row.provider, row.maxTokens, row.temperature, row.endpoint, row.extra) == ("p", 4096, 0.5, None, {})
    (tmp_path / "request.json").write_text('{"imageData":"aGk=","format":"image/png","language":"fr"}')
    assert tuple(readers.read_ocr_requests(spark, str(tmp_path / "request.json")).first()) == (bytearray(b"hi"), "image/png", "fr", None)
    (tmp_path / "result.json").write_text('{"structuredText":"t","confidence":0.9,"language":"fr","sourceFormat":"image/png","generatedAt":"now","model":"m"}')
    row = readers.read_ocr_results(spark, str(tmp_path / "result.json")).first()
    assert row.structuredText == "t" and row.metadata == {}


def test_enriched_json_goes_round(spark):
    nodes = spark.createDataFrame([(0, "Architecture", 1, "by Eric Evans"), (1, "Other", 2, None)], "n int, title string, level int, text string")
    chunks = spark.createDataFrame([("c2", "d", "A > Architecture", 2, "body", "L", 2), ("c1", "d", "architecture", 1, "first", "L", 1)], "id string, source_document string, section_path string, heading_level int, content string, license string, pos int")
    graph = spark.createDataFrame([("g", "ARCHITECTURE")], "id string, label string")
    enriched = enrich.enrich(nodes, chunks, graph)
    text = enrich.as_json(enriched, chunks, "n")
    assert '"ragChunks":[{"id":"c1"' in text.first().text
    back = readers.enriched_nodes(text.unionByName(spark.createDataFrame([("broken",), (None,)], "text string"))).orderBy("ordinal").collect()
    assert [tuple(r) for r in back] == [(0, "Architecture", 1, ["c1", "c2"], ["g"], 1.0, ["Architecture", "Eric Evans"]), (1, "Other", 2, [], [], 0.0, ["Other"])]
    assert tuple(enrich.summary(enriched).first()) == (2, 2, 1) and tuple(enrich.summary(enriched.limit(0)).first()) == (0, 0, 0)


def test_engines(spark):
    class Client:
        def chat(self, config, prompt, images):
            assert prompt.endswith("Language: fr") and images == ["data:image/png;base64,aGk="] and config["maxTokens"] == 4096
            return " text "

    assert ocr.ChatEngine(Client()).process(b"hi", "image/png", "fr") == ("text", 0.9) and ocr.ChatEngine(Client()).process(b"", "image/png", "fr") == ("", 0.0)
    assert ocr.CommandEngine(("cat",)).process(b"page", "image/png", "fr") == ("page", 0.7)
    assert ocr.CommandEngine(("no-such-program",)).process(b"page", "image/png", "fr") == ("", 0.0) and ocr.CommandEngine(("false",)).process(b"page", "image/png", "fr") == ("", 0.0)


def test_collection_is_read_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Engine:
        name = "e"

        def process(self, content, mime, language):
            (calls / f"{content.decode()}-{len(list(calls.iterdir()))}").touch()
            return ("", 0.0) if content == b"bad" else (content.decode().upper(), 0.9)

    images = spark.createDataFrame([("b", "p2", bytearray(b"x"), "image/png"), ("b", "p1", bytearray(b"bad"), "image/png"), ("c", "p1", bytearray(b"y"), "image/png")], "book string, page_id string, content binary, mime string").coalesce(1)
    table = VersionedTable(spark, str(tmp_path / "cache"), ocr.CACHE)
    for turn in range(2):  # failures are cached too
        pages, cache = ocr.collect(images, table.read(), [Engine()])
        rows = sorted(tuple(r) for r in pages.collect())
        table.write(cache)
        assert [r[:5] for r in rows] == [("b", "p1", 1, "001-p1.adoc", ocr.EMPTY_PAGE), ("b", "p2", 2, "002-p2.adoc", "X"), ("c", "p1", 1, "001-p1.adoc", "Y")] and {r[5] for r in rows} == {bool(turn)}
        assert len(list(calls.iterdir())) == 3
    books = spark.createDataFrame([("b",), ("empty",)], "book string")
    assert {r.book: r.text for r in ocr.book_text(pages, "book", books).collect()}["empty"] == "= [Empty OCR]\n\nNo images found in empty.\n"


def test_a_batch_is_stored_once(spark, tmp_path):
    store = sinks.ChunkStore(spark, str(tmp_path / "store"))
    chunks = chunk_documents(spark.createDataFrame([("d", "# A\nx\n# B\ny", None)], "source_document string, text string, license string"))
    store.add(chunks, hashed_embedding, "one")
    store.add(chunks, hashed_embedding, "one")
    assert store.table("documents").count() == 1 and store.table("chunks").count() == 2
    (tmp_path / "store/chunks/batch-two").mkdir()  # a write that was broken off
    store.add(chunks, hashed_embedding, "two")
    store.add(chunks, hashed_embedding)
    assert [r.id for r in store.table("documents").orderBy("id").collect()] == [1, 2, 3] and [r.id for r in store.table("chunks").orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]


def test_embedding_is_that_of_a_plain_version(spark):
    def plain(text):
        out = np.zeros(384)
        for word in (text or "").lower().split():
            marked = f"^{word}$"
            for gram in [marked] + [marked[i : i + 3] for i in range(len(marked) - 2)]:
                h = zlib.crc32(gram.encode())
                out[h % 384] += 1 if h >> 31 else -1
        return out / max(np.sqrt(out @ out), 1e-300)

    texts = [None, "", "a", "The cat the CAT", "é 日本 x" * 50, "word " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", hashed_embedding(F.col("t")).alias("v")).collect()
    assert len(rows) == 6 and all(np.allclose(r.v, plain(texts[r.i]), atol=1e-6) for r in rows)
