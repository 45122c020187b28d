"""Files of their own names, keyed tables and the OCR cache on disk."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from strataloom.operators import ocr, pipeline, profiles
from strataloom.sources import named_files, readers, sinks
from strataloom.sources.keyed import Conflict, KeyedTable


def test_named_files(spark, tmp_path):
    rows = [("a.adoc", "one\r\ntwo\n", "OSS"), ("é b+c%20#d.adoc", "日本\n\nx", "OSS"), ("a.adoc", "other", "office"), ("empty.adoc", None, "office")]
    docs = spark.createDataFrame(rows, "file_name string, text string, route string").repartition(3)
    path = str(tmp_path / "out")
    for _ in range(2):  # the second replaces the first
        named_files.write_files(docs, path, folder="route")
        assert {r.name: r.text for r in named_files.read_files(spark, path).collect()} == {"OSS/a.adoc": "one\r\ntwo\n", "OSS/é b+c%20#d.adoc": "日本\n\nx", "office/a.adoc": "other"}
    assert (tmp_path / "out/office/empty.adoc").read_bytes() == b""  # Spark's readers pass over empty files
    assert (tmp_path / "out/OSS/a.adoc").read_bytes() == b"one\r\ntwo\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["OSS", "_SUCCESS", "office"]
    with pytest.raises(ValueError, match="one name"):
        named_files.write_files(docs, path)
    for bad in ("../x", "/x", "", "a//b", ".hidden", None):
        with pytest.raises(Exception, match="no name for a file"):
            named_files.write_files(spark.createDataFrame([(bad, "x")], "file_name string, text string"), path)
    assert (tmp_path / "out/office/a.adoc").read_text() == "other" and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    named_files.write_files(docs.limit(0), path)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["_SUCCESS"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    named_files.write_files(spark.createDataFrame([("kept", "x")], "file_name string, text string"), path)
    many = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), "id").alias("file_name"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken off"))).otherwise(F.lit("t")).alias("text"))
    with pytest.raises(Exception, match="broken off"):
        named_files.write_files(many, path)
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and (tmp_path / "out/kept").exists()


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "k string, n int, v string", ["k", "n"], 8)
    assert table.read().count() == 0 and table.lookup("a", 1).count() == 0
    rows = spark.range(200).select(F.concat(F.lit("key"), F.col("id") % 50).alias("k"), F.col("id").cast("int").alias("n"), F.lit("old").alias("v"))
    assert table.replace(rows) == list(range(8))
    before = dict(table.folders)
    one = spark.createDataFrame([("key7", 7, "new")], "k string, n int, v string")
    (touched,) = table.replace(one)
    assert {b for b in before if table.folders[b] != before[b]} == {touched}  # one bucket is written anew
    assert [r.v for r in table.lookup("key7", 7).collect()] == ["new"] and table.read().count() == 200
    files = table.lookup("key7", 7).inputFiles()
    assert files and all(f"__bucket={touched}/" in f for f in files)  # and one is read
    many = table.lookups(spark.createDataFrame([("key7", 7), ("key8", 8), ("none", 1), (None, None)], "k string, n int"))
    assert sorted((r.k, r.v) for r in many.collect()) == [("key7", "new"), ("key8", "old")]
    table.replace(spark.createDataFrame([(None, None, "null")], "k string, n int, v string"))
    table.replace(spark.createDataFrame([(None, None, "again")], "k string, n int, v string"))
    assert [r.v for r in table.lookup(None, None).collect()] == ["again"]
    other, late = KeyedTable(spark, path, "k string, n int, v string", ["k", "n"]), KeyedTable(spark, path, "k string, n int, v string", ["k", "n"])
    assert other.buckets == 8 and other.read().count() == 201
    other.replace(one)
    with pytest.raises(Conflict):
        late.replace(one)
    late.refresh()
    late.rebucket(3)
    assert late.replace(one) and late.read().count() == 201 and late.buckets == 3
    late.vacuum()
    assert KeyedTable(spark, path, "k string, n int, v string", ["k", "n"]).read().count() == 201
    assert len(list((tmp_path / "t/manifests").glob("v*.json"))) == 1
    assert table.replace(rows.limit(0)) == []


def test_profiles_touch_their_buckets(spark):
    schema = "learner_id string, formation_id string, completed_modules array<string>, current_module string, progression_pct double, comprehension_score double, weak_points array<string>, last_interaction_at string, annotations map<string,string>"
    store = profiles.ProfileStore(spark, buckets=32)
    rows = [(f"l{i}", "f", [], "m", float(i), 0.0, [], "", {}) for i in range(100)]
    store.save(spark.createDataFrame(rows, schema))
    assert len(store.save(spark.createDataFrame([("l5", "f", [], "later", 1.0, 0.0, [], "", {})], schema))) == 1
    row = store.load("l5", "f").first()
    assert row.current_module == "later" and row.created_at < row.updated_at and store.table.read().count() == 100
    assert store.load_all(spark.createDataFrame([("l5", "f"), ("l6", "f"), ("l6", "g")], "learner_id string, formation_id string")).count() == 2


def counting(*given):
    class Counting:
        name = "counting"

        def __init__(self, calls):
            self.calls = calls

        def process(self, content, mime, language):
            self.calls.add(1)
            return ("", 0.0) if content == b"blank" else (content.decode(), 0.6)

    return Counting(*given)


def test_ocr_cache_on_disk(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    pages = [("b", "p1", b"one"), ("b", "p2", b"blank"), ("c", "p1", b"three")]
    images = lambda rows: spark.createDataFrame([(b, p, bytearray(c), "image/png") for b, p, c in rows], "book string, page_id string, content binary, mime string")
    store = ocr.OcrCache(spark, str(tmp_path / "cache"), 4)
    first = {(r.book, r.page_id): (r.body, r.hit) for r in ocr.collect_with(store, images(pages), [counting(calls)]).collect()}
    assert first == {("b", "p1"): ("one", False), ("b", "p2"): (ocr.EMPTY_PAGE, False), ("c", "p1"): ("three", False)} and calls.value == 3
    again = ocr.collect_with(ocr.OcrCache(spark, str(tmp_path / "cache")), images(pages), [counting(calls)]).collect()
    assert all(r.hit for r in again) and calls.value == 3  # failures are cached too
    pages[0] = ("b", "p1", b"changed")
    changed = ocr.collect_with(store, images(pages), [counting(calls)]).collect()
    assert {r.page_id: r.hit for r in changed if r.book == "b"} == {"p1": False, "p2": True} and calls.value == 4
    # and as a file a page
    sinks.write_ocr_cache(store.table.read(), str(tmp_path / "files"))
    (tmp_path / "files/b/p9.ocr-cache.json").write_text("corrupt")
    entries = readers.read_ocr_cache(spark, str(tmp_path / "files"))
    assert {(r.page_id, r.text, r.confidence, r.model) for r in entries.collect()} == {("b/p1", "changed", 0.6, "counting"), ("b/p2", "", 0.0, "pipeline"), ("c/p1", "three", 0.6, "counting")}
    found, _ = ocr.collect(images(pages), entries, [counting(calls)])
    assert all(r.hit for r in found.collect()) and calls.value == 4


def test_pages_and_routed_documents(spark, tmp_path):
    pages = ocr.numbered_pages(spark.createDataFrame([("bk", "p2", "two"), ("bk", "p10", " ")], "book string, page_id string, text string"))
    sinks.write_pages(pages, str(tmp_path / "pages"))
    assert {r.name: r.text for r in named_files.read_files(spark, str(tmp_path / "pages")).collect()} == {"bk/001-p10.adoc": ocr.EMPTY_PAGE, "bk/002-p2.adoc": "two"}
    texts = spark.createDataFrame([("x.adoc", "OSS", "= A\n\nb\n"), ("x.adoc", "office", "= C\n")], "file_name string, route string, text string")
    pipeline.write(texts, str(tmp_path / "routed"), routed=True)
    assert (tmp_path / "routed/texts/OSS/x.adoc").read_text() == "= A\n\nb\n" and (tmp_path / "routed/texts/office/x.adoc").exists()


def slow(*given):
    class Slow:
        name = "slow"

        def process(self, content, mime, language):
            if content == b"hangs":
                time.sleep(60)
            time.sleep(0.2)
            return content.decode(), 0.5

    return Slow(*given)


def flaky(*given):
    class Flaky:
        """Fails at every first try of a page."""

        name = "flaky"

        def __init__(self):
            self.seen = set()

        def process(self, content, mime, language):
            if content not in self.seen:
                self.seen.add(content)
                raise RuntimeError("try again")
            return content.decode(), 0.5

    return Flaky(*given)


def test_calls_in_flight_deadlines_and_retries(spark):
    rows = [(f"p{i:02d}", bytearray(b"hangs" if i == 9 else b"t%d" % i), "image/png", "fr") for i in range(64)]
    pages = spark.createDataFrame(rows, "page_id string, content binary, mime string, language string").coalesce(1)
    took = {}
    for n in (1, 8):
        some = pages.where("page_id <> 'p09'") if n == 1 else pages
        began = time.perf_counter()
        found = ocr.run_engines(some, [slow()], ocr.Calls(in_flight=n, seconds=2.0)).collect()
        took[n] = time.perf_counter() - began
        assert [r.page_id for r in found] == [r[0] for r in rows if n == 8 or r[0] != "p09"]
        assert all((r.text, r.confidence) == (("", 0.0) if r.page_id == "p09" else (f"t{int(r.page_id[1:])}", 0.5)) for r in found)
    assert took[8] < took[1] / 2.5
    for retries, text in ((0, ""), (1, "t1")):
        found = ocr.run_engines(pages.where("page_id = 'p01'"), [flaky()], ocr.Calls(retries=retries, wait=0.01)).collect()
        assert [r.text for r in found] == [text]


def test_many_small_files_make_few_tasks(spark, tmp_path):
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    for path, n in ((few, 40), (many, 1500)):
        rows = spark.range(n).select(F.format_string("p%d.json", "id").alias("file_name"), F.format_string('{"learnerId": "l%d", "progressionPct": 2.5}', "id").alias("text"))
        named_files.write_files(rows, path)
    for read in (named_files.read_files, readers.read_texts, readers.read_profiles, readers.read_ocr_config):
        assert read(spark, many).rdd.getNumPartitions() == read(spark, few).rdd.getNumPartitions()
        assert read(spark, many).count() == 1500
    assert {r.learner_id for r in readers.read_profiles(spark, many).collect()} == {f"l{i}" for i in range(1500)}


def test_json_files_of_objects_and_arrays(spark, tmp_path):
    for name, text in (("one", '{"model": "a", "maxTokens": 1}'), ("two", '[{"model": "b"}, {"model": "c"}]'), ("broken", '{"model": '), ("empty", "")):
        (tmp_path / f"{name}.json").write_text(text)
    found = readers.read_ocr_config(spark, str(tmp_path))
    assert sorted((r.model or "", r.maxTokens) for r in found.collect()) == [("", 4096), ("a", 1), ("b", 4096), ("c", 4096)]


def test_engines_share_a_few_threads(spark):
    class Named:
        name = "named"

        def process(self, content, mime, language):
            import threading

            return threading.current_thread().name, 0.5

    pages = spark.range(300).coalesce(1).select(F.col("id").cast("string").alias("page_id"), F.lit(b"x").alias("content"), F.lit("image/png").alias("mime"), F.lit("fr").alias("language"))
    found = ocr.run_engines(pages, [Named()], ocr.Calls(in_flight=4, seconds=30.0)).collect()
    assert [int(r.page_id) for r in found] == list(range(300)) and len({r.text for r in found}) <= 4


def test_a_late_call_goes_on_to_the_next_engine(spark):
    class Stuck:
        name = "stuck"

        def process(self, content, mime, language):
            time.sleep(3 if content == b"1" else 0)
            return "done", 0.5

    class Last:
        name = "last"

        def process(self, content, mime, language):
            return "last", 0.4

    pages = spark.createDataFrame([(str(i), bytearray(str(i).encode()), "image/png", "fr") for i in range(6)], "page_id string, content binary, mime string, language string").coalesce(1)
    found = ocr.run_engines(pages, [Stuck(), Last()], ocr.Calls(in_flight=2, seconds=0.3, retries=1, wait=0.01)).collect()
    assert [(r.page_id, r.model, r.text) for r in found] == [("0", "stuck", "done"), ("1", "stuck", ""), ("1", "last", "last"), *((str(i), "stuck", "done") for i in range(2, 6))]


def test_contents_of_files_are_never_broadcast(spark, tmp_path):
    from strataloom.plans import stores
    from strataloom.sources import parts

    def planned(df):
        found = df.collect()
        return found, df._jdf.queryExecution().executedPlan().toString()  # with what was decided while it ran

    path = str(tmp_path / "out")
    texts = spark.range(60).select(F.format_string("f%02d", "id").alias("name"), F.when(F.col("id") % 10 == 0, "").otherwise(F.repeat(F.col("id").cast("string"), 300_000)).alias("text"))
    named_files.write_files(texts, path, "name")  # 28 MB, of which Spark knows the names alone
    found, plan = planned(texts.select("name").join(named_files.read_files(spark, path), "name", "left").select("name", F.length("text").alias("n")))
    assert "Broadcast" not in plan and {r.name: r.n for r in found} == {f"f{i:02d}": len(str(i)) * 300_000 if i % 10 else None for i in range(60)}
    parts.write_parts(spark.createDataFrame([("d", i, "x" * 50) for i in range(100)], "doc string, place int, line string"), str(tmp_path / "parts"), chars=1000)
    found, plan = planned(parts.read_parts(spark, str(tmp_path / "parts")))
    assert "Broadcast" not in plan and "".join(r.text for r in sorted(found, key=lambda r: r.part)) == ("x" * 50 + "\n") * 100
    docs = [(1, "Apache License 2.0"), (2, None), (3, ""), (4, "© é"), (1_000_000, "plain\r\n")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found, plan = planned(stores.routed_files(spark, str(tmp_path)))
    assert "Broadcast" not in plan and {r.name: r.text_md5 for r in found} == {
        f"{'OSS' if n == 1 else 'office'}/{n:06d}.adoc": hashlib.md5((t or "").encode()).hexdigest() for n, t in docs
    }
