"""Queries that write to a store or to files in the shared folder and read back what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import automata
from ..functions.text import rtrim_ws, split_lines
from ..operators import chunking, knowledge_base, licences, ocr, pipeline, pivots, profiles, trees
from ..session import fresh_path
from ..sources import named_files, parts, readers, sinks
from .composites import _OCR_SQL, EchoClient, LowerEngine, _files, _images
from .composites import ORACLE_SQL as FILES_SQL
from .generated import ORACLE_SQL as GENERATED_SQL
from .graphs import _flat
from .inputs import CONVERSATION_SQL, conversation_markdown, table
from .knowledge import _ZONE
from .knowledge import ORACLE_SQL as KNOWLEDGE_SQL


def ocr_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR pages as files of their names below their books."""
    images, cache = _images(spark, sf_dir)
    path = fresh_path(spark, "pages")
    sinks.write_pages(ocr.collect(images, cache, [ocr.ChatEngine(EchoClient()), LowerEngine()])[0], path)
    return named_files.read_files(spark, path)


def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their names below the folder that their licence routes them to."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(licences.route(licences.detect(F.col("text"))).alias("route"), F.format_string("%06d.adoc", "doc_id").alias("file_name"), "text")
    path = fresh_path(spark, "routed")
    named_files.write_files(rows, path, folder="route")
    made = rows.select(F.concat_ws("/", "route", "file_name").alias("name"))
    found = named_files.read_files(spark, path).select("name", F.md5("text").alias("found"))  # hashed where a file is read, so no text is shuffled
    return made.join(found, "name", "left").select("name", F.coalesce("found", F.md5(F.lit(""))).alias("text_md5"))


def pipeline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF and EPUB files to AsciiDoc files below their route."""
    path = fresh_path(spark, "piped")
    pipeline.write(pipeline.auto_detect(_files(spark, sf_dir), fallback_zone="CSS"), path, routed=True)
    return named_files.read_files(spark, f"{path}/texts").select("name", F.length("text").alias("chars"))


def ocr_collect_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages collected into a cache on disk, and again after every third image has changed."""
    images, _ = _images(spark, sf_dir)
    store = ocr.OcrCache(spark, fresh_path(spark, "ocr-cache"), 16)
    engines = [ocr.ChatEngine(EchoClient()), LowerEngine()]
    ocr.collect_with(store, images, engines)
    changed = F.element_at(F.split("page_id", "-"), -1).cast("bigint") % 3 == 0
    later = images.withColumn("content", F.when(changed, F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content")))
    return ocr.collect_with(store, later, engines)


def ocr_cache_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache as a file a page, read back."""
    _, cache = _images(spark, sf_dir)
    path = fresh_path(spark, "cache-files")
    sinks.write_ocr_cache(cache, path)
    return readers.read_ocr_cache(spark, path)


def _profiles(spark: SparkSession, sf_dir: str) -> profiles.ProfileStore:
    """A profile a user and kind of event, saved twice: from every third event, then from the others."""
    store = profiles.ProfileStore(spark, buckets=16)
    events = table(spark, sf_dir, "events")
    for some in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        last = events.where(some).groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))
        store.save(last.select(
            F.col("user_id").cast("string").alias("learner_id"), F.col("event_type").alias("formation_id"), F.array(F.col("last").cast("string")).alias("completed_modules"), F.col("last").cast("string").alias("current_module"),
            F.col("n").cast("double").alias("progression_pct"), F.lit(0.0).alias("comprehension_score"), F.array().cast("array<string>").alias("weak_points"), F.lit("").alias("last_interaction_at"), F.create_map().cast("map<string,string>").alias("annotations"),
        ))
    return store


_PROFILE = ("learner_id", "formation_id", "current_module", "progression_pct")


def profile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).table.read().select(*_PROFILE, (F.col("created_at") < F.col("updated_at")).alias("updated"))


def profile_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles of some users, from the buckets of their keys."""
    store = _profiles(spark, sf_dir)
    wanted = table(spark, sf_dir, "events").where("user_id % 7 = 0").select(F.col("user_id").cast("string").alias("learner_id"), F.col("event_type").alias("formation_id"))
    return store.load_all(wanted).select(*_PROFILE)


def chunk_store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks added to a store in two batches, and the nearest ones to a vector; vectors are counts of letters."""
    store = sinks.ChunkStore(spark, fresh_path(spark, "chunks"))
    embed = lambda text: F.array(*(F.regexp_count(text, F.lit(c)).cast("float") for c in "aeiou"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_document"), F.lit("all").alias("section_path"), F.lit(1).alias("heading_level"), F.col("text").alias("content"), F.lit("MIT").alias("license"), F.col("doc_id").alias("pos"), "doc_id",
    )
    for k in (0, 1):
        store.add(docs.where(F.col("doc_id") % 2 == k).drop("doc_id"), embed, f"part-{k}")
    store.add(docs.drop("doc_id"), embed, "part-1")  # there already
    found = store.search([1.0, 5.0, 1.0, 1.0, 1.0], 25)
    return found.select("source_document", "section_path", F.round("similarity", 9).alias("similarity"))


def pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth one, by an index with pivots."""
    vectors = table(spark, sf_dir, "embeddings")
    index = pivots.build(vectors, fresh_path(spark, "pivots"), "vec_id", "embedding", 16)
    found = pivots.nearest(index, vectors.where("vec_id % 20 = 0").select("vec_id", F.col("embedding").alias("vector")), 10, "vec_id")
    return found.select("vec_id", "place", F.col("id").alias("other"), F.round("similarity", 7).alias("similarity"))


def _joined_parts(spark: SparkSession, lines: DataFrame, doc: str) -> DataFrame:
    """Documents written in parts of some 2,000 characters, put together again."""
    path = fresh_path(spark, "parts")
    parts.write_parts(lines, path, doc, chars=2000)
    rows = parts.read_parts(spark, path).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda r: r["text"]), "").alias("text"))
    return rows.select("doc", F.md5(F.concat(rtrim_ws(F.col("text")), F.lit("\n"))).alias("text_md5"))


def book_sql_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_parts(spark, trees.script_lines(_flat(spark, sf_dir)), "doc")


def kb_markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_parts(spark, knowledge_base.lines(chunking.chunk_documents(conversation_markdown(spark, sf_dir)), "markdown"), "source_document")


def fence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each line of the conversations' documents begins inside a code fence, by a scan over ranges of lines."""
    docs = conversation_markdown(spark, sf_dir)
    lines = docs.select("source_document", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    heading = F.col("line").rlike(chunking.HEADING)
    symbol = F.when(heading, 2).when(F.ltrim("line").startswith("```"), 1).otherwise(0)
    found = automata.states(lines, ["source_document"], ["pos"], symbol, automata.FENCES, "state")
    return found.select("source_document", "pos", F.col("state").alias("inside"))


QUERIES = {
    "pivot_topk": pivot_topk,
    "book_sql_parts": book_sql_parts,
    "kb_markdown_parts": kb_markdown_parts,
    "fence_states": fence_states,
    "ocr_page_files": ocr_page_files,
    "routed_files": routed_files,
    "pipeline_files": pipeline_files,
    "ocr_collect_again": ocr_collect_again,
    "ocr_cache_files": ocr_cache_files,
    "profile_store": profile_store,
    "profile_store_lookup": profile_store_lookup,
    "chunk_store_search": chunk_store_search,
}

_PROFILE_SQL = """WITH e AS (SELECT user_id::VARCHAR AS learner_id, event_type AS formation_id, event_id % 3 <> 0 AS later, max(event_id) AS last, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY learner_id, formation_id ORDER BY later DESC) AS k, count(*) OVER (PARTITION BY learner_id, formation_id) AS saves FROM e)
"""

_AGAIN = "CASE WHEN k % 3 = 0 THEN p_name || '!' ELSE p_name END"

ORACLE_SQL = {
    "pivot_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id, v.vec_id AS other, round(list_cosine_similarity(q.e, v.e), 12) AS sim FROM v q, v WHERE q.vec_id % 20 = 0)
SELECT vec_id, place, other, round(sim, 7) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other)::INT AS place FROM s) WHERE place <= 10""",
    "book_sql_parts": f"SELECT doc, md5(text) AS text_md5 FROM ({GENERATED_SQL['book_sql']})",
    "kb_markdown_parts": f"SELECT source_document AS doc, text_md5 FROM ({KNOWLEDGE_SQL['kb_markdown']})",
    "fence_states": f"WITH {CONVERSATION_SQL} SELECT source_document, pos::INT AS pos, CASE WHEN h THEN coalesce(lag(run) OVER (PARTITION BY source_document ORDER BY pos), 0) % 2 ELSE (run - fence::INT) % 2 END::INT AS inside FROM runs",
    "ocr_page_files": _OCR_SQL + "SELECT book || '/' || file_name AS name, body AS text FROM pages",
    "routed_files": f"SELECT CASE WHEN {_ZONE} = 'OSS' THEN 'OSS/' ELSE 'office/' END || printf('%06d.adoc', doc_id) AS name, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "pipeline_files": f"SELECT route || '/' || file_name AS name, length(text)::INT AS chars FROM ({FILES_SQL['files_to_asciidoc']})",
    "ocr_collect_again": f"""WITH p AS (SELECT p_partkey AS k, p_brand AS book, 'scan-' || p_partkey AS page_id, {_AGAIN.replace("k %", "p_partkey %")} AS content FROM part),
t AS (SELECT *, CASE WHEN length(content) % 5 <> 0 AND length(content) % 3 <> 0 THEN '= ' || content WHEN length(content) % 2 = 1 THEN lower(content) ELSE '' END AS text, row_number() OVER (PARTITION BY book ORDER BY page_id) AS page_number FROM p)
SELECT book, page_id, page_number, printf('%03d', page_number) || '-' || page_id || '.adoc' AS file_name, CASE WHEN text = '' THEN '[page vide ou OCR échec]' ELSE text END AS body, k % 3 <> 0 AS hit FROM t""",
    "ocr_cache_files": """SELECT p_brand || '/scan-' || p_partkey AS page_id, sha256(CASE WHEN p_partkey % 3 = 0 THEN 'old' ELSE p_name END) AS source_hash, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'cached ' || p_name END AS text,
0.5::DOUBLE AS confidence, 'old' AS model FROM part WHERE p_partkey % 2 = 0""",
    "profile_store": _PROFILE_SQL + "SELECT learner_id, formation_id, last::VARCHAR AS current_module, n::DOUBLE AS progression_pct, saves = 2 AS updated FROM p WHERE k = 1",
    "profile_store_lookup": _PROFILE_SQL + "SELECT learner_id, formation_id, last::VARCHAR AS current_module, n::DOUBLE AS progression_pct FROM p WHERE k = 1 AND learner_id::BIGINT % 7 = 0",
    "chunk_store_search": """WITH v AS (SELECT doc_id, [(length(text) - length(replace(text, c, '')))::DOUBLE FOR c IN ['a', 'e', 'i', 'o', 'u']] AS e FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_inner_product(e, [1.0, 5.0, 1.0, 1.0, 1.0]) / nullif(sqrt(list_inner_product(e, e)) * sqrt(29.0), 0) AS sim FROM v)
SELECT 'doc-' || doc_id AS source_document, 'all' AS section_path, round(sim, 9) AS similarity FROM s ORDER BY sim DESC NULLS LAST, doc_id % 2, doc_id LIMIT 25""",
}
