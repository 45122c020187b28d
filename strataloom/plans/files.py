"""Queries that write derived files of each format and read them back through the library's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, enrich, ontology
from ..session import fresh_path
from ..sources import readers, sinks
from ..sources.named_files import write_files
from .inputs import CONVERSATION_SQL, conversation_markdown, table
from .knowledge import ORACLE_SQL as KNOWLEDGE_SQL
from .knowledge import _document_chunks, retrieve_join_docs


def _written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """The folder of ``rows`` (file_name, text) as files."""
    path = fresh_path(spark, name)
    write_files(rows, path)
    return path


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = conversation_markdown(spark, sf_dir)
    path = _written(spark, docs.select(F.concat("source_document", F.lit(".md")).alias("file_name"), "text"), "markdown")
    return readers.read_texts(spark, path, "MIT").select("source_document", F.md5("text").alias("text_md5"), "license")


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = conversation_markdown(spark, sf_dir)
    path = _written(spark, docs.select(F.concat("source_document", F.lit(".adoc")).alias("file_name"), "text"), "lines")
    return readers.read_lines(spark, path).select("source_document", "pos", "line")


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as a JSON array a document, read back."""
    texts = sinks.chunks_json(chunking.chunk_documents(conversation_markdown(spark, sf_dir)))
    path = _written(spark, texts.select(F.concat("source_document", F.lit(".json")).alias("file_name"), "text"), "chunks-json")
    return readers.read_chunks(spark, path).select("source_document", "section_path", "heading_level", F.md5("content").alias("content_md5"), F.size("code_blocks").alias("code_blocks"), "license")


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table scripts of the customers' nations, read back and taken apart."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    sql = F.concat(F.lit("CREATE TABLE n"), "c_nationkey", F.lit(" (id INT, up INT REFERENCES n"), "c_nationkey", F.lit("(id) ON DELETE CASCADE, of INT REFERENCES root(id) ON DELETE CASCADE);\nCREATE TABLE root (id INT, n"), "n", F.lit(" INT);\n"))
    path = _written(spark, customers.select(F.format_string("nation-%d.sql", "c_nationkey").alias("file_name"), sql.alias("text")), "scripts")
    scripts = readers.read_scripts(spark, path)
    found = ontology.aggregates(scripts).select("doc", "root", F.array_join("dependents", ",").alias("dependents"))  # a table that refers to itself is no dependent of its own
    return found.join(scripts.select(F.col("doc").alias("d"), F.length("sql").alias("chars")), F.col("doc") == F.col("d")).drop("d")


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph file a kind of part, one of them broken."""
    part = table(spark, sf_dir, "part")
    node = F.struct(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.lit("part").alias("type"), F.col("p_brand").alias("community"), F.lit(1).alias("other"))
    graphs = part.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(node).alias("nodes"))).alias("text"))
    broken = F.when(F.col("p_brand") == "Brand#11", F.left("text", F.lit(40))).otherwise(F.col("text"))
    path = _written(spark, graphs.select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(".json")).alias("file_name"), broken.alias("text")), "graphs")
    return readers.read_graph(spark, path)


_SUFFIXES = ("png", "JPG", "txt", "jpeg", "tif", "TIFF", "bmp", "gif", "md")


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    suffix = F.element_at(F.array(*(F.lit(s) for s in _SUFFIXES)), (F.col("p_partkey") % len(_SUFFIXES)).cast("int") + 1)
    path = _written(spark, part.select(F.concat(F.format_string("scan-%d.", "p_partkey"), suffix).alias("file_name"), F.col("p_name").alias("text")), "images")
    return readers.read_images(spark, path).select("page_id", "mime", "source_hash", F.octet_length("content").alias("bytes"))


def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    some = lambda c, k: F.when(F.col("c_custkey") % k != 0, c)
    profile = F.struct(
        F.col("c_name").alias("learnerId"), F.lit("f").alias("formationId"), some(F.array(F.lit("a"), F.col("c_mktsegment")), 3).alias("completedModules"), F.col("c_mktsegment").alias("currentModule"),
        some(F.col("c_nationkey").cast("double") / 4, 2).alias("progressionPct"), some(F.create_map(F.lit("k"), F.col("c_mktsegment")), 5).alias("annotations"),
    )
    path = _written(spark, customer.select(F.format_string("p%d.json", "c_custkey").alias("file_name"), F.to_json(profile).alias("text")), "profiles-json")
    rows = readers.read_profiles(spark, path)
    return rows.select("learner_id", "formation_id", F.array_join("completed_modules", ",").alias("completed_modules"), "current_module", "progression_pct", "comprehension_score", F.size("weak_points").alias("weak_points"), F.element_at("annotations", "k").alias("annotation"))


def enriched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations enriched with chunks and graph nodes, some with blank titles, as one JSON array and back."""
    nation = table(spark, sf_dir, "nation")
    title = F.when(F.col("n_nationkey") % 4 == 0, "  ").otherwise(F.col("n_name"))
    nodes = nation.select(F.col("n_nationkey").alias("node_id"), title.alias("title"), F.lit(2).alias("level"), F.lit("").alias("text"))
    chunks = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("All > "), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.lower("n_name"))).alias("section_path"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("content"), F.lit("s").alias("source_document"),
    )
    graph = nation.where("n_nationkey % 2 = 1").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    text = enrich.as_json(enrich.enrich(nodes, chunks, graph), chunks, "node_id").select(F.lit("enriched.json").alias("file_name"), "text")
    path = _written(spark, text, "enriched")
    rows = readers.enriched_nodes(readers.read_texts(spark, path))
    return rows.select("ordinal", "title", "level", F.size("chunk_ids").alias("chunks"), F.array_join("graph_ids", ",").alias("graph_ids"), F.round("density", 9).alias("density"), F.array_join("entities", ",").alias("entities"))


def ocr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, results and settings of OCR as JSON files, a third of the parts each."""
    part = table(spark, sf_dir, "part")
    kind, name = F.col("p_partkey") % 3, F.format_string("%d.json", "p_partkey")
    request = F.struct(F.regexp_replace(F.base64(F.col("p_name").cast("binary")), r"\s", "").alias("imageData"), F.lit("image/png").alias("format"), F.lit("fr").alias("language"))
    result = F.struct(F.col("p_name").alias("structuredText"), F.lit(0.5).alias("confidence"), F.lit("fr").alias("language"), F.col("p_brand").alias("model"), F.lit("x").alias("unknown"))
    config = F.struct(F.lit("p").alias("provider"), F.col("p_name").alias("model"), F.when(F.col("p_partkey") % 2 == 0, 7).alias("maxTokens"))
    paths = [_written(spark, part.where(kind == k).select(name.alias("file_name"), F.to_json(x).alias("text")), "ocr-json") for k, x in enumerate((request, result, config))]
    rows = [
        readers.read_ocr_requests(spark, paths[0]).select(F.lit("request").alias("kind"), F.decode("content", "UTF-8").alias("name"), F.concat_ws(",", "mime", "language", F.coalesce("prompt", F.lit("none"))).alias("rest")),
        readers.read_ocr_results(spark, paths[1]).select(F.lit("result").alias("kind"), F.col("structuredText").alias("name"), F.concat_ws(",", "language", "model", F.size("metadata")).alias("rest")),
        readers.read_ocr_config(spark, paths[2]).select(F.lit("config").alias("kind"), F.col("model").alias("name"), F.concat_ws(",", "provider", "maxTokens", F.size("extra")).alias("rest")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def retrieval_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "retrieval")
    sinks.write_json(retrieve_join_docs(spark, sf_dir), path)
    return spark.read.schema("chunk_id bigint, source_document string, similarity double").json(path)


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a chunk store after one batch."""
    store = sinks.ChunkStore(spark, fresh_path(spark, "store"))
    rows = _document_chunks(spark, sf_dir).withColumns({"section_path": F.lit("s"), "heading_level": F.lit(1), "content": F.lit("c")})
    store.add(rows, lambda text: F.array(F.length(text).cast("float")))
    return store.table("documents")


def store_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its chunks table: ids go on through the documents in order."""
    store = sinks.ChunkStore(spark, fresh_path(spark, "store"))
    rows = _document_chunks(spark, sf_dir).withColumns({"section_path": F.concat(F.lit("s"), F.col("pos").cast("string")), "heading_level": F.lit(1), "content": F.lit("c")})
    store.add(rows, lambda text: F.array(F.length(text).cast("float")))
    return store.table("chunks").select("id", "document_id", "chunk_index", "section_path", F.element_at("embedding", 1).cast("double").alias("embedding"))


def metadata_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar of a run over all documents; its time is checked by its form."""
    path = fresh_path(spark, "metadata")
    sinks.write_metadata(spark, path, "pipeline", table(spark, sf_dir, "documents").count(), model="onnx-local", dependencies=("queens",))
    text = spark.read.text(path, wholetext=True)
    read = text.select(F.from_json("value", "source string, type string, sessions bigint, generatedAt string, model string, version string, dependencies array<string>").alias("m")).select("m.*")
    return read.select("source", "type", "sessions", "model", "version", F.array_join("dependencies", ",").alias("dependencies"), F.col("generatedAt").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d").alias("timed"))


QUERIES = {
    "markdown_files": markdown_files,
    "line_files": line_files,
    "chunk_files": chunk_files,
    "script_files": script_files,
    "graph_files": graph_files,
    "image_files": image_files,
    "profile_files": profile_files,
    "enriched_files": enriched_files,
    "ocr_files": ocr_files,
    "retrieval_json": retrieval_json,
    "store_documents": store_documents,
    "store_chunks": store_chunks,
    "metadata_file": metadata_file,
}

_SUFFIX_SQL = f"[{', '.join(repr(s) for s in _SUFFIXES)}][(p_partkey % {len(_SUFFIXES)})::INT + 1]"

ORACLE_SQL = {
    "markdown_files": f"WITH {CONVERSATION_SQL} SELECT source_document, md5(text) AS text_md5, 'MIT' AS license FROM docs",
    "line_files": f"WITH {CONVERSATION_SQL} SELECT source_document, pos::INT AS pos, line FROM raw",
    "script_files": """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey)
SELECT 'nation-' || k AS doc, 'root' AS root, 'n' || k AS dependents, length('CREATE TABLE n' || k || ' (id INT, up INT REFERENCES n' || k || '(id) ON DELETE CASCADE, of INT REFERENCES root(id) ON DELETE CASCADE);' || chr(10) || 'CREATE TABLE root (id INT, n' || n || ' INT);' || chr(10))::INT AS chars FROM c""",
    "graph_files": "SELECT 'g' || p_partkey AS id, p_name AS label, 'part' AS type, p_brand AS community FROM part WHERE p_brand <> 'Brand#11'",
    "image_files": f"""SELECT 'scan-' || p_partkey AS page_id, CASE lower({_SUFFIX_SQL}) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'bmp' THEN 'image/bmp' WHEN 'gif' THEN 'image/gif' ELSE 'image/tiff' END AS mime,
sha256(p_name) AS source_hash, strlen(p_name)::INT AS bytes FROM part WHERE {_SUFFIX_SQL} NOT IN ('txt', 'md')""",
    "profile_files": """SELECT c_name AS learner_id, 'f' AS formation_id, CASE WHEN c_custkey % 3 <> 0 THEN 'a,' || c_mktsegment ELSE '' END AS completed_modules, c_mktsegment AS current_module, CASE WHEN c_custkey % 2 <> 0 THEN c_nationkey::DOUBLE / 4 ELSE 0 END::DOUBLE AS progression_pct,
0.0::DOUBLE AS comprehension_score, 0 AS weak_points, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS annotation FROM customer""",
    "enriched_files": r"""WITH t AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN '  ' ELSE n_name END AS title FROM nation),
c AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY s_nationkey)
SELECT (row_number() OVER (ORDER BY k) - 1)::INT AS ordinal, title, 2 AS level, coalesce(n, 0)::INT AS chunks, CASE WHEN k % 2 = 1 AND k % 4 <> 0 THEN 'g' || k ELSE '' END AS graph_ids, round(coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM supplier), 9) AS density,
array_to_string(list_distinct(regexp_extract_all(title, '\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*\b')), ',') AS entities FROM t LEFT JOIN c USING (k)""",
    "ocr_files": """SELECT 'request' AS kind, p_name AS name, 'image/png,fr,none' AS rest FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'result', p_name, 'fr,' || p_brand || ',0' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT 'config', p_name, 'p,' || CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE 4096 END || ',0' FROM part WHERE p_partkey % 3 = 2""",
    "chunk_files": f"""WITH {CONVERSATION_SQL}, blocks AS (SELECT source_document, sec, (max(run) // 2)::INT AS code_blocks FROM runs GROUP BY ALL)
SELECT source_document, path AS section_path, level AS heading_level, md5(content) AS content_md5, code_blocks, 'Apache-2.0' AS license FROM contents JOIN blocks USING (source_document, sec) WHERE content <> ''""",
    "retrieval_json": KNOWLEDGE_SQL["retrieve_join_docs"],
    "store_documents": KNOWLEDGE_SQL["ingest_documents"],
    "store_chunks": """WITH d AS (SELECT *, min(doc_id) OVER (PARTITION BY source) AS first_pos FROM documents)
SELECT row_number() OVER (ORDER BY first_pos, source, doc_id)::BIGINT AS id, dense_rank() OVER (ORDER BY first_pos, source)::BIGINT AS document_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS chunk_index, 's' || doc_id AS section_path, 1.0::DOUBLE AS embedding FROM d""",
    "metadata_file": "SELECT 'engine' AS source, 'pipeline' AS type, count(*)::BIGINT AS sessions, 'onnx-local' AS model, '0.1.0' AS version, 'queens' AS dependencies, true AS timed FROM documents",
}
