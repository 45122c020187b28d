"""Queries of HTML, trees, ontologies, enrichment, contexts, OCR and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import hashed_embedding as embed_text
from ..operators import context, enrich, html, ocr, ontology, profiles, trees, vectors
from .inputs import table
from .structure import SUPPLIER_ADOC


def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(html.heading_texts(F.col("html"), 1)).alias("n", "heading"))


def _html(plain: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return html.to_asciidoc(table(spark, sf_dir, "pages"), "page_id", "html", plain)

    return query


def _world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations below them, and suppliers as paragraphs of their nations."""
    region = table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("key"), F.lit(1).alias("level"),
        F.col("r_name").alias("title"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("text"),
    )
    nation = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_nationkey"), F.lit(2), F.col("n_name"), F.lit(None).cast("string"), F.lit(None).cast("string")
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("int"), F.lit(0), F.lit(""), F.lit("paragraph"), F.col("s_name")
    )
    every = region.union(nation).union(supplier).withColumn("doc", F.lit("world"))
    from pyspark.sql import Window

    ordinal = (F.row_number().over(Window.partitionBy("doc", "parent_id").orderBy("key")) - 1).cast("int")
    return every.withColumn("ordinal", ordinal)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trees.with_paths(_world(spark, sf_dir))
    return nodes.withColumn("parent", F.when(F.col("parent_id").isNotNull(), F.regexp_extract("path", "^(.*)/[^/]*$", 1)))


def ldd_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("node_id", "path", "level", "title")


def book_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.relational(_flat(spark, sf_dir))[1].select(F.col("id").cast("bigint").alias("id"), "title", "level", F.col("parent_id").cast("bigint").alias("parent_id"), "sort_order")


def book_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.relational(_flat(spark, sf_dir))[2].select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "position")


def book_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.sql_script(_flat(spark, sf_dir))


def adoc_to_ldd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.expr(SUPPLIER_ADOC).alias("text"))
    return trees.from_asciidoc(docs)


#: A region's table, its nations', every other one with a cascading delete, and one of notes a nation.
_REGION_DDL = """concat('CREATE TABLE region_', r_regionkey, ' (id INT, r_name TEXT, PRIMARY KEY (id));', chr(10), array_join(transform(nations, n ->
  concat('CREATE TABLE IF NOT EXISTS nation_', n.n_nationkey, ' (', chr(10), 'n_id INT,', chr(10), 'r_id INT REFERENCES region_', r_regionkey, '(id)', if(n.n_nationkey % 2 = 0, ' ON DELETE CASCADE', ''), ',', chr(10), 'n_name TEXT);',
  chr(10), 'CREATE TABLE note_', n.n_nationkey, ' (note_id INT, body TEXT);')), chr(10)))"""


def _ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script a region."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    joined = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select(F.col("r_name").alias("doc"), F.expr(_REGION_DDL).alias("sql"))


def ontology_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.contexts(_ddl(spark, sf_dir)).select("doc", "name", F.array_join("tables", ",").alias("tables"))


def ontology_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.aggregates(_ddl(spark, sf_dir)).select("doc", "root", F.array_join("dependents", ",").alias("dependents"))


def ontology_value_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.value_objects(_ddl(spark, sf_dir)).select("doc", "name", F.array_join("columns", ",").alias("columns"))


def ontology_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.as_json(_ddl(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").alias("node_id"), "n_regionkey", F.col("n_name").alias("title"), F.concat(F.lit("Known as "), F.initcap("n_name")).alias("text"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    chunks = customers.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("World > "), F.lower("n_name"), F.lit(" ")).alias("section_path"), F.col("c_custkey").alias("pos"))
    graph = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("id"), F.upper("n_name").alias("label"))
    return enrich.enrich(nodes, chunks, graph)


def enrich_ldd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _enriched(spark, sf_dir)
    return rows.select("node_id", F.size("chunk_ids").alias("chunks"), F.array_join("graph_ids", ",").alias("graph_ids"), F.round("density", 9).alias("density"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = enrich.entities(F.lit(""), F.col("text"))
    return docs.select("doc_id", F.size(found).alias("entities"), F.md5(F.array_join(F.sort_array(found), "|")).alias("entities_md5"))


def graphify_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.graph_section(_enriched(spark, sf_dir), "n_regionkey", "node_id")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_ = table(spark, sf_dir, "embeddings")
    query = vectors_.where("vec_id = 0").select(F.col("embedding").alias("query"))
    best = vectors.top_k(vectors_, query, 10, "vec_id").select("vec_id", F.col("label").alias("heading_level"), F.round("similarity", 6).alias("similarity"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    joined = F.broadcast(best).join(docs, F.col("vec_id") == F.col("doc_id"))
    return joined.select(F.col("vec_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.concat(F.lit("Corpus > "), "lang").alias("section_path"), "heading_level", F.col("source").alias("source_document"), "similarity")


def composite_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.entries(_results(spark, sf_dir), "store").select("chunk_id", F.md5("chunk_text").alias("text_md5"), F.length("chunk_text").alias("chars"), "section_path", "source_document", "similarity")


def composite_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = context.docs_section(_results(spark, sf_dir).withColumn("query", F.lit("q0")), "query")
    return section.select("query", F.md5("text").alias("text_md5"), F.length("text").alias("chars"), "results")


def composite_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    return context.composite_json(results, "q0", 10, "store").withColumn("form", F.lit("plain")).unionByName(context.typed_json(results, "q0", 10, "store").withColumn("form", F.lit("typed")))


def ocr_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    engine = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    text = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("text "), F.col("event_id").cast("string")))
    results = events.select((F.col("event_id") % 300).alias("page_id"), engine.alias("engine"), text.alias("text"), F.round(F.col("value") - 20, 3).alias("confidence"), F.col("event_type").alias("model"))
    return ocr.first_success(results)


def ocr_cache_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pages = part.select(F.col("p_partkey").alias("page_id"), ocr.content_hash(F.col("p_name").cast("binary")).alias("source_hash"))
    old = F.when(F.col("p_partkey") % 3 == 0, F.lit("old")).otherwise(F.col("p_name"))
    cache = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("page_id"), ocr.content_hash(old.cast("binary")).alias("source_hash"))
    return ocr.cache_misses(pages, cache)


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pages = part.select("p_brand", F.concat(F.lit("scan-"), F.col("p_partkey").cast("string")).alias("page_id"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_name")).alias("text"))
    return ocr.numbered_pages(pages, "p_brand").select("p_brand", F.col("page_number").cast("bigint").alias("page_number"), "file_name", "body")


def ocr_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pages = part.select("p_brand", F.concat(F.lit("scan-"), F.col("p_partkey").cast("string")).alias("page_id"), F.col("p_name").alias("text"))
    return ocr.book_text(ocr.numbered_pages(pages, "p_brand"), "p_brand")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seen"), F.col("event_id").alias("created"), F.round("value", 4).alias("score"))
    return events.where("seen % 3 = 0"), events.where("seen % 3 <> 0")


def profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _stored(spark, sf_dir)
    return profiles.upsert(stored, new, ["user_id", "event_type"], "seen", "created")


def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_upsert(spark, sf_dir).where((F.col("user_id") == 7) & (F.col("event_type") == "click"))


def profile_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    weak = F.when(F.col("n_nationkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("n_name", F.lit("basics")))
    notes = F.when(F.col("n_nationkey") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")))
    return nation.select("n_nationkey", profiles.text_to_embed(weak, notes).alias("text"))


def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", embed_text(F.col("text")).alias("embedding"))


QUERIES = {
    "html_headings": html_headings,
    "html_to_adoc": _html(False),
    "html_to_adoc_plain": _html(True),
    "ldd_flatten": ldd_flatten,
    "book_documents": book_documents,
    "book_paragraphs": book_paragraphs,
    "book_sql": book_sql,
    "adoc_to_ldd": adoc_to_ldd,
    "ontology_contexts": ontology_contexts,
    "ontology_aggregates": ontology_aggregates,
    "ontology_value_objects": ontology_value_objects,
    "ontology_json": ontology_json,
    "enrich_ldd": enrich_ldd,
    "entities": entities,
    "graphify_section": graphify_section,
    "composite_entries": composite_entries,
    "composite_docs": composite_docs,
    "composite_json": composite_json,
    "ocr_cascade": ocr_cascade,
    "ocr_cache_delta": ocr_cache_delta,
    "ocr_pages": ocr_pages,
    "ocr_book": ocr_book,
    "profile_upsert": profile_upsert,
    "profile_lookup": profile_lookup,
    "profile_embed_text": profile_embed_text,
    "hashed_embedding": hashed_embedding,
}

PATHS_SQL = """WITH r AS (SELECT 'r' || r_regionkey AS node_id, r_regionkey, r_name, '/' || lpad((row_number() OVER (ORDER BY r_regionkey) - 1)::VARCHAR, 9, '0') AS path, row_number() OVER (ORDER BY r_regionkey) - 1 AS o FROM region),
n AS (SELECT 'n' || n_nationkey AS node_id, n_nationkey, n_name, r.node_id AS up, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS o, r.path || '/' || lpad((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::VARCHAR, 9, '0') AS path FROM nation JOIN r ON n_regionkey = r_regionkey),
s AS (SELECT 's' || s_suppkey AS node_id, s_name, n.node_id AS up, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS o, n.path || '/' || lpad((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::VARCHAR, 9, '0') AS path FROM supplier JOIN n ON s_nationkey = n_nationkey),
d AS (SELECT row_number() OVER (ORDER BY path) AS id, * FROM (SELECT node_id, r_name AS title, 1 AS level, NULL AS up, o, path FROM r UNION ALL SELECT node_id, n_name, 2, up, o, path FROM n))
"""
_ENRICHED = """WITH c AS (SELECT n_nationkey AS k, count(*) AS chunks FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey), t AS (SELECT count(*) AS total FROM customer)
SELECT n_nationkey AS node_id, coalesce(chunks, 0)::INT AS chunks, CASE WHEN n_nationkey % 2 = 0 THEN 'g' || n_nationkey ELSE '' END AS graph_ids, round(coalesce(coalesce(chunks, 0) / total, 0.0), 9) AS density FROM nation LEFT JOIN c ON k = n_nationkey CROSS JOIN t"""
RESULTS_SQL = """WITH best AS (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 10),
res AS (SELECT vec_id AS chunk_id, text, 'Corpus > ' || lang AS section_path, source AS source_document, similarity FROM best JOIN documents ON vec_id = doc_id)
"""

ORACLE_SQL = {
    "html_headings": "SELECT page_id, unnest(range(0, len(h)))::INT AS n, unnest(h) AS heading FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)",
    "ldd_flatten": PATHS_SQL + "SELECT node_id, path, 1 AS level, r_name AS title FROM r UNION ALL SELECT node_id, path, 2, n_name FROM n UNION ALL SELECT node_id, path, 0, '' FROM s",
    "book_documents": PATHS_SQL + "SELECT d.id, d.title, d.level, p.id AS parent_id, d.o::INT AS sort_order FROM d LEFT JOIN d p ON d.up = p.node_id",
    "book_paragraphs": PATHS_SQL + "SELECT d.id AS doc_id, s_name AS text, (s.o + 1)::INT AS position FROM s JOIN d ON s.up = d.node_id",
    "enrich_ldd": _ENRICHED,
    "entities": r"""SELECT doc_id, len(e)::INT AS entities, md5(array_to_string(list_sort(e), '|')) AS entities_md5 FROM (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*\b')) AS e FROM documents)""",
    "graphify_section": "SELECT n_regionkey, coalesce(rtrim(string_agg(n_name || chr(10) || '- g' || n_nationkey || chr(10), chr(10) || chr(10) ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0), chr(10)), '') AS text FROM nation GROUP BY n_regionkey",
    "composite_entries": RESULTS_SQL + "SELECT chunk_id, md5(left(text, 500)) AS text_md5, length(left(text, 500))::INT AS chars, section_path, source_document, similarity FROM res",
    "composite_docs": RESULTS_SQL + """, t AS (SELECT left(string_agg('[' || source_document || ' / ' || section_path || '] (similarity=' || printf('%.3f', similarity) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY similarity DESC, chunk_id), 2800) AS text, count(*) AS results FROM res)
SELECT 'q0' AS query, md5(text) AS text_md5, length(text)::INT AS chars, results FROM t WHERE results > 0""",
    "ocr_cascade": """WITH e AS (SELECT event_id % 300 AS page_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS engine, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'text ' || event_id END AS text, round(value - 20, 3) AS confidence, event_type AS model FROM events),
g AS (SELECT page_id, min({'engine': engine, 'text': text, 'confidence': confidence, 'model': model}) FILTER (text <> '' AND confidence > 0) AS b FROM e GROUP BY page_id)
SELECT page_id, coalesce(b.text, '') AS text, coalesce(b.confidence, 0.0) AS confidence, coalesce(b.model, 'pipeline') AS model FROM g""",
    "ocr_cache_delta": "SELECT p_partkey AS page_id, sha256(p_name) AS source_hash FROM part WHERE p_partkey % 2 <> 0 OR (p_partkey % 3 = 0 AND p_name <> 'old')",
    "ocr_pages": """SELECT p_brand, n AS page_number, printf('%03d', n) || '-' || page_id || '.adoc' AS file_name, body FROM (SELECT p_brand, 'scan-' || p_partkey AS page_id, row_number() OVER (PARTITION BY p_brand ORDER BY 'scan-' || p_partkey) AS n,
CASE WHEN p_partkey % 5 = 0 OR trim(p_name) = '' THEN '[page vide ou OCR échec]' ELSE p_name END AS body FROM part)""",
    "ocr_book": """SELECT p_brand, '= OCR Book' || chr(10) || chr(10) || string_agg('== Page ' || n || chr(10) || chr(10) || body || chr(10), chr(10) ORDER BY n) AS text FROM
(SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY 'scan-' || p_partkey) AS n, p_name AS body FROM part) GROUP BY p_brand""",
    "profile_upsert": """SELECT user_id, event_type, seen, created, score FROM (SELECT user_id, event_type, event_id AS seen, round(value, 4) AS score, min(event_id) OVER (PARTITION BY user_id, event_type) AS created,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 3 <> 0) DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "profile_lookup": """SELECT user_id, event_type, seen, created, score FROM (SELECT user_id, event_type, event_id AS seen, round(value, 4) AS score, min(event_id) OVER (PARTITION BY user_id, event_type) AS created,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 3 <> 0) DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND user_id = 7 AND event_type = 'click'""",
    "profile_embed_text": "SELECT n_nationkey, concat_ws(' ', CASE WHEN n_nationkey % 4 <> 0 THEN n_name || ' basics' END, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey::VARCHAR END) AS text FROM nation",
}
