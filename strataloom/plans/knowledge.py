"""Queries of retrieval, ingest, chunking, licences and knowledge-base export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import hashed_embedding
from ..operators import chunking, ingest, knowledge_base, licences, vectors
from .inputs import CONVERSATION_SQL, conversation_markdown, table

TOP_K = 10


def _query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query"))


def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vectors.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), TOP_K, "vec_id")
    return best.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def retrieve_join_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("document_id"), "embedding")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_document"))
    found = vectors.retrieve(chunks, documents, _query_vector(spark, sf_dir), TOP_K)
    return found.select(F.col("id").alias("chunk_id"), "source_document", F.round("similarity", 6).alias("similarity"))


def _document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("source_document"), F.col("doc_id").alias("pos"), F.col("lang").alias("license"))


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.document_rows(_document_chunks(spark, sf_dir)).select("id", "source_document", "chunk_count", "license")


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.with_chunk_index(_document_chunks(spark, sf_dir)).select("source_document", F.col("pos").alias("doc_id"), "chunk_index")


def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_documents(conversation_markdown(spark, sf_dir))
    return ingest.ingest(chunks, hashed_embedding)[1].select("document_id", "chunk_index", "section_path", "heading_level", F.size("embedding").alias("dimension"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(conversation_markdown(spark, sf_dir))


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_documents(conversation_markdown(spark, sf_dir))
    return chunks.select("source_document", "pos", "heading_level", F.md5("content").alias("content_md5"), F.length("content").alias("content_chars"))


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.summary(chunking.chunk_documents(conversation_markdown(spark, sf_dir)))


def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("source_document", F.col("sec").alias("pos"), "title", "path")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(conversation_markdown(spark, sf_dir)).select("id", "source_document", "pos", "license")


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("source_document", F.col("sec").alias("pos"), F.col("overlap").alias("overlap_next"))


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).where(F.size("code_blocks") > 0).select("source_document", F.col("sec").alias("pos"), F.size("code_blocks").alias("blocks"), F.array_join("code_blocks", "\n").alias("code"))


def licence_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", licences.detect(F.col("text")).alias("zone"))


def licence_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = licences.effective_zone(licences.detect(F.col("text")), F.when(F.col("source") == "src0", "OSS").otherwise("UNKNOWN"))
    zoned = table(spark, sf_dir, "documents").select(zone.alias("zone"))
    named = zoned.select("zone", licences.licence_name(F.col("zone")).alias("license"), licences.route(F.col("zone")).alias("route"))
    return named.groupBy("zone", "license", "route").agg(F.count(F.lit(1)).alias("documents"))


def licence_zone_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("page_id") % 3 == 0, "\\foundry\\public\\").when(F.col("page_id") % 3 == 1, "/foundry/private/").otherwise("/else/")
    path = F.concat(F.lit("/w"), folder, F.col("url"))
    zone = licences.zone_of_path(path)
    return table(spark, sf_dir, "pages").select("page_id", zone.alias("zone"), licences.licence_name(zone).alias("license"))


def kb_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws(" > ", "n_name", F.concat(F.lit("Chapter "), (F.col("c_custkey") % 120).cast("string"), F.lit(".2 end")), "c_name")
    joined = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", knowledge_base.section_sort_key(path).alias("sort_key"))


def kb_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_documents(conversation_markdown(spark, sf_dir))
    return knowledge_base.ordered_chunks(chunks).select("source_document", "pos", F.col("place").cast("bigint").alias("place"), "sort_key")


def _export(form: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = knowledge_base.export(chunking.chunk_documents(conversation_markdown(spark, sf_dir)), form)
        return text.select("source_document", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))

    return query


QUERIES = {
    "retrieve_topk": retrieve_topk,
    "retrieve_join_docs": retrieve_join_docs,
    "ingest_documents": ingest_documents,
    "ingest_chunks": ingest_chunks,
    "chunk_index": chunk_index,
    "chunk_summary": chunk_summary,
    "chunk_sections": chunk_sections,
    "section_paths": section_paths,
    "chunk_ids": chunk_ids,
    "chunk_overlap": chunk_overlap,
    "code_blocks": code_blocks,
    "licence_detect": licence_detect,
    "licence_route": licence_route,
    "licence_zone_path": licence_zone_path,
    "kb_sort_key": kb_sort_key,
    "kb_order": kb_order,
    "kb_markdown": _export("markdown"),
    "kb_asciidoc": _export("asciidoc"),
    "kb_jsonld": _export("json-ld"),
}

_ZONE = r"""CASE WHEN text IS NULL OR trim(text) = '' THEN 'UNKNOWN'
WHEN regexp_matches(text, '(?i)apache\s+license\s+2\.0|apache-2\.0|creative\s+commons|cc-by|(^|[^A-Za-z0-9_])cc0($|[^A-Za-z0-9_])') THEN 'OSS'
WHEN regexp_matches(text, '(?i)©|copyright|all\s+rights\s+reserved') THEN 'CSS' ELSE 'UNKNOWN' END"""
_NAME = "CASE zone WHEN 'OSS' THEN 'Apache-2.0' WHEN 'CSS' THEN 'PROPRIETARY' ELSE 'UNKNOWN' END"
_KEY = r"""array_to_string(list_transform(string_split({path}, ' > '), lambda p: CASE WHEN regexp_matches(p, '[0-9]')
THEN regexp_extract(p, '^([^0-9]*)', 1) || CASE WHEN length(regexp_extract(p, '^[^0-9]*([0-9][0-9.]*)', 1)) >= 4 THEN regexp_extract(p, '^[^0-9]*([0-9][0-9.]*)', 1)
  ELSE lpad(regexp_extract(p, '^[^0-9]*([0-9][0-9.]*)', 1), 4, '0') END || regexp_extract(p, '^[^0-9]*[0-9][0-9.]*(.*)$', 1)
ELSE CASE WHEN length(p) >= 4 THEN p ELSE lpad(p, 4, ' ') END END), ' > ')"""
_TOP = "SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where} ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 10"
_BODY = r"regexp_replace(CASE WHEN contains(content, chr(10)) THEN substr(content, instr(content, chr(10)) + 1) ELSE '' END, '^\s+|\s+$', '', 'g')"
CHUNKS_SQL = f"""WITH {CONVERSATION_SQL},
fenced AS (SELECT source_document, sec, run, array_to_string(list(line ORDER BY pos) FILTER (NOT fence), chr(10)) AS block FROM trimmed WHERE NOT h GROUP BY source_document, sec, run),
ends AS (SELECT source_document, sec, max(run) AS most FROM trimmed GROUP BY source_document, sec),
blocks AS (SELECT f.source_document, f.sec, list(regexp_replace(coalesce(block, ''), '\\s+$', '') ORDER BY run) AS bs FROM fenced f JOIN ends e ON e.source_document = f.source_document AND e.sec = f.sec
  WHERE run % 2 = 1 AND run < most GROUP BY f.source_document, f.sec),
said AS (SELECT *, list_slice(string_split(regexp_replace(array_to_string(list_slice(nxt, 1, 3), ' '), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), 1, 2) AS two
  FROM (SELECT *, lead(raw_texts) OVER (PARTITION BY source_document ORDER BY sec) AS nxt FROM
    (SELECT p.*, coalesce((SELECT list(line ORDER BY pos) FROM trimmed t WHERE t.source_document = p.source_document AND t.sec = p.sec AND NOT h AND t <> '' AND t.t <> '' AND t.t NOT LIKE '#%' AND t.t NOT LIKE '```%'), []) AS raw_texts FROM contents p))),
chunks AS (SELECT s.*, nullif(trim(array_to_string(two, ' ')), '') AS overlap_next, coalesce(b.bs, []) AS bs, {_KEY.format(path="path")} AS sort_key
  FROM said s LEFT JOIN blocks b ON b.source_document = s.source_document AND b.sec = s.sec),
placed AS (SELECT *, row_number() OVER (PARTITION BY source_document ORDER BY sort_key, sec) AS place, {_BODY} AS rest, string_split(path, ' > ')[-1] AS name FROM chunks),
levelled AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY source_document ORDER BY place), 0) AS last FROM placed)
""".replace("AND t <> '' AND t.t <> ''", "AND t.t <> ''")

ORACLE_SQL = {
    "retrieve_topk": _TOP.format(where="e.embedding IS NOT NULL"),
    "retrieve_join_docs": f"SELECT vec_id AS chunk_id, d.source AS source_document, similarity FROM ({_TOP.format(where='e.embedding IS NOT NULL')}) t JOIN documents d ON d.doc_id = t.vec_id",
    "ingest_documents": """SELECT row_number() OVER (ORDER BY first_pos, source_document)::BIGINT AS id, source_document, chunk_count, license FROM
(SELECT source AS source_document, count(*)::INT AS chunk_count, first(lang ORDER BY doc_id) AS license, min(doc_id) AS first_pos FROM documents GROUP BY source)""",
    "chunk_index": "SELECT source AS source_document, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS chunk_index FROM documents",
    "chunk_sections": f"WITH {CONVERSATION_SQL} SELECT source_document, sec AS pos, level AS heading_level, md5(content) AS content_md5, length(content)::INT AS content_chars FROM contents WHERE content <> ''",
    "section_paths": f"WITH {CONVERSATION_SQL} SELECT source_document, sec AS pos, title, path FROM paths",
    "chunk_ids": f"WITH {CONVERSATION_SQL} SELECT 'chk-' || substr(sha256(source_document || ':' || path), 1, 16) AS id, source_document, sec AS pos, 'Apache-2.0' AS license FROM contents WHERE content <> ''",
    "chunk_overlap": CHUNKS_SQL + "SELECT source_document, sec AS pos, overlap_next FROM chunks",
    "code_blocks": CHUNKS_SQL + "SELECT source_document, sec AS pos, len(bs)::INT AS blocks, array_to_string(bs, chr(10)) AS code FROM chunks WHERE len(bs) > 0",
    "licence_detect": f"SELECT doc_id, {_ZONE} AS zone FROM documents",
    "licence_route": f"""WITH z AS (SELECT CASE WHEN {_ZONE} = 'UNKNOWN' THEN CASE WHEN source = 'src0' THEN 'OSS' ELSE 'UNKNOWN' END ELSE {_ZONE} END AS zone FROM documents)
SELECT zone, {_NAME} AS license, CASE WHEN zone = 'OSS' THEN 'OSS' ELSE 'office' END AS route, count(*) AS documents FROM z GROUP BY zone""",
    "licence_zone_path": f"SELECT page_id, zone, {_NAME} AS license FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'OSS' WHEN 1 THEN 'CSS' ELSE 'UNKNOWN' END AS zone FROM pages)",
    "kb_sort_key": "SELECT c_custkey, " + _KEY.format(path="path") + " AS sort_key FROM (SELECT c_custkey, n_name || ' > Chapter ' || (c_custkey % 120) || '.2 end > ' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "kb_order": CHUNKS_SQL + "SELECT source_document, sec AS pos, place, sort_key FROM placed",
    "kb_markdown": CHUNKS_SQL + """, texts AS (SELECT source_document, place,
  CASE WHEN level = 1 AND last <> 1 THEN chr(10) ELSE '' END || repeat('#', level) || ' ' || name || chr(10) || chr(10) || CASE WHEN rest <> '' THEN rest || chr(10) || chr(10) ELSE '' END
  || coalesce(array_to_string(list_transform(bs, lambda b: '```text' || chr(10) || regexp_replace(b, '^\\s+|\\s+$', '', 'g') || chr(10) || '```' || chr(10) || chr(10)), ''), '')
  || CASE WHEN overlap_next IS NOT NULL THEN '> _Continued: ' || overlap_next || '_' || chr(10) || chr(10) ELSE '' END || CASE WHEN level = 1 THEN '---' || chr(10) ELSE '' END || chr(10) AS part FROM levelled),
whole AS (SELECT source_document, regexp_replace('# ' || source_document || chr(10) || chr(10) || string_agg(part, '' ORDER BY place), '\\s+$', '') || chr(10) AS text FROM texts GROUP BY source_document)
SELECT source_document, md5(text) AS text_md5, length(text)::INT AS chars FROM whole""",
    "kb_asciidoc": CHUNKS_SQL + """, texts AS (SELECT source_document, place, repeat('=', least(level, 5)) || ' ' || name || chr(10) || chr(10) || CASE WHEN rest <> '' THEN rest || chr(10) || chr(10) ELSE '' END
  || coalesce(array_to_string(list_transform(bs, lambda b: '[source,text]' || chr(10) || '----' || chr(10) || regexp_replace(b, '^\\s+|\\s+$', '', 'g') || chr(10) || '----' || chr(10) || chr(10)), ''), '')
  || CASE WHEN overlap_next IS NOT NULL THEN '[TIP]' || chr(10) || 'Continued: ' || overlap_next || chr(10) || chr(10) ELSE '' END || '''''''' || chr(10) || chr(10) AS part FROM levelled),
whole AS (SELECT source_document, regexp_replace('= ' || source_document || chr(10) || chr(10) || '[NOTE]' || chr(10) || '====' || chr(10) || 'Auto-generated by deployKnowledgeBase. Aggregated knowledge base from ' || count(*) || ' chunks.' || chr(10) || '====' || chr(10) || chr(10)
  || string_agg(part, '' ORDER BY place), '\\s+$', '') || chr(10) AS text FROM texts GROUP BY source_document)
SELECT source_document, md5(text) AS text_md5, length(text)::INT AS chars FROM whole""",
}
