"""DuckDB SQL of whole generated texts: scripts, JSON, AsciiDoc and Markdown."""

from __future__ import annotations

from ..operators import trees
from .graphs import PATHS_SQL, RESULTS_SQL
from .inputs import CONVERSATION_SQL
from .knowledge import CHUNKS_SQL
from .structure import EMIT_SQL, KINDS_SQL, MACHINE_SQL, STYLED_SQL, SUPPLIER_ADOC

#: Scripts of regions: a region's table, its nations' that refer to it, and one of notes a nation.
ONTOLOGY_SQL = """WITH n AS (SELECT r_name AS doc, r_regionkey AS r, n_nationkey AS k, 'nation_' || n_nationkey AS t, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM region JOIN nation ON n_regionkey = r_regionkey),
contexts AS (SELECT doc, 'bc_1' AS name, string_agg(t, ',' ORDER BY t) AS tables, 1 AS place FROM (SELECT doc, t FROM n UNION ALL SELECT DISTINCT doc, 'region_' || r FROM n) GROUP BY doc
  UNION ALL SELECT doc, 'bc_' || (i + 1), 'note_' || k, i + 1 FROM n),
roots AS (SELECT doc, 'region_' || r AS root, string_agg(t, ',' ORDER BY t) AS dependents FROM n WHERE k % 2 = 0 GROUP BY doc, r),
vals AS (SELECT DISTINCT doc, 'region_' || r AS name, 'id,r_name' AS columns, 0 AS place FROM n UNION ALL SELECT doc, 'note_' || k, 'note_id,body', i FROM n)
"""
_HEAD = "\n".join(["BEGIN;", *trees.DDL, ""]).replace("'", "''")
_TAIL = "\n".join(["", *trees.SCRIPT_END, ""]).replace("'", "''")

# With fences: the ---- right behind [source,x] opens the code.
_FENCED = MACHINE_SQL.replace(
    "vis AS (SELECT *, CASE WHEN t LIKE '[source,%' THEN 1 WHEN t = '----' THEN 0 END AS marker FROM nexts WHERE t NOT LIKE '//%')",
    "seen AS (SELECT *, t = '----' AND coalesce(lag(t) OVER (PARTITION BY doc ORDER BY pos) LIKE '[source,%', false) AS opener FROM nexts WHERE t NOT LIKE '//%'),\n"
    "vis AS (SELECT *, CASE WHEN t LIKE '[source,%' THEN 1 WHEN t = '----' AND NOT opener THEN 0 END AS marker FROM seen)",
).replace("CASE WHEN in_code AND t = '----' THEN 'code_end' WHEN in_code THEN 'code'", "CASE WHEN in_code AND t = '----' AND NOT opener THEN 'code_end' WHEN in_code AND opener THEN 'skip' WHEN in_code THEN 'code'")
# The shorter rules.
_SHORT = (
    MACHINE_SQL[: MACHINE_SQL.index(r"  WHEN regexp_matches(t, '^\[(NOTE")]
    + r"""  WHEN regexp_matches(t, '^\[\p{Lu}.*\]$') THEN 'admonition' WHEN t = '====' THEN 'example' WHEN regexp_matches(t, '^=+\s+.+$') THEN 'heading' WHEN t = '' THEN 'blank' ELSE 'text' END AS rule FROM state),
"""
    + MACHINE_SQL[MACHINE_SQL.index("coded AS (") :]
)
_BOOK = r""", texted AS (SELECT doc, grp, string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ' ORDER BY y, page, seq) AS joined, trim(regexp_replace(string_agg(text, ' ' ORDER BY y, page, seq), '\s+', ' ', 'g')) AS plain,
  string_agg(rtrim(text), chr(10) ORDER BY y, page, seq) AS code FROM grouped GROUP BY doc, grp),
parts AS (SELECT k.doc, k.grp, kind, joined, plain, code, lag(k.grp) OVER w IS NULL AS is_first, lead(k.grp) OVER w IS NULL AS is_last, coalesce(lag(kind) OVER w IN ('h1', 'h2', 'h3', 'h4'), false) AS blank,
  sum((kind = 'code')::INT) OVER w AS codes FROM kinds k JOIN texted t ON t.doc = k.doc AND t.grp = k.grp WINDOW w AS (PARTITION BY k.doc ORDER BY k.grp)),
made AS (SELECT doc, grp, CASE WHEN kind = 'inline' THEN '`' || trim(joined) || '`' WHEN kind = 'code' THEN CASE WHEN codes = 1 THEN '[source,text]' || chr(10) || '----' || chr(10) ELSE '' END || code || chr(10)
  WHEN kind = 'text' THEN CASE WHEN is_first OR blank THEN '' ELSE ' ' END || plain || CASE WHEN is_last THEN '' ELSE chr(10) END
  ELSE CASE WHEN is_first OR blank THEN '' ELSE chr(10) END || repeat('=', substr(kind, 2)::INT) || ' ' || regexp_replace(joined, '^(= )+', '') || chr(10) || chr(10) END AS part FROM parts)
SELECT doc, regexp_replace(string_agg(part, '' ORDER BY grp), '\s+$', '') || chr(10) AS text FROM made GROUP BY doc"""

ORACLE_SQL = {
    "ontology_contexts": ONTOLOGY_SQL + "SELECT doc, name, tables FROM contexts",
    "ontology_aggregates": ONTOLOGY_SQL + "SELECT doc, root, dependents FROM roots",
    "ontology_value_objects": ONTOLOGY_SQL + "SELECT doc, name, columns FROM vals",
    "ontology_json": ONTOLOGY_SQL + """SELECT r_name AS doc, '{"boundedContexts":[' || (SELECT string_agg('{"name":"' || name || '","tables":["' || replace(tables, ',', '","') || '"]}', ',' ORDER BY place) FROM contexts c WHERE c.doc = r_name)
|| '],"aggregates":[' || coalesce((SELECT string_agg('{"rootTable":"' || root || '","dependentTables":["' || replace(dependents, ',', '","') || '"]}', ',') FROM roots r WHERE r.doc = r_name), '')
|| '],"valueObjects":[' || (SELECT string_agg('{"table":"' || name || '","columns":["' || replace(columns, ',', '","') || '"]}', ',' ORDER BY place) FROM vals v WHERE v.doc = r_name) || ']}' AS text
FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""",
    "book_sql": PATHS_SQL + f""", lines AS (SELECT 1 AS part, 1 AS id, 'INSERT INTO book (id, title) VALUES (1, ' || chr(39) || replace(first(r_name ORDER BY path), chr(39), chr(39) || chr(39)) || chr(39) || ');' AS line FROM r
UNION ALL SELECT 2, d.id, 'INSERT INTO documents (id, book_id, title, level, parent_id, sort_order) VALUES (' || d.id || ', 1, ' || chr(39) || replace(d.title, chr(39), chr(39) || chr(39)) || chr(39) || ', ' || d.level || ', ' || coalesce(p.id::VARCHAR, 'NULL') || ', ' || d.o || ');' FROM d LEFT JOIN d p ON d.up = p.node_id
UNION ALL SELECT 3, row_number() OVER (ORDER BY s.path), 'INSERT INTO paragraphs (doc_id, text, position) VALUES (' || d.id || ', ' || chr(39) || replace(s_name, chr(39), chr(39) || chr(39)) || chr(39) || ', ' || (s.o + 1) || ');' FROM s JOIN d ON s.up = d.node_id)
SELECT 'world' AS doc, '{_HEAD}' || string_agg(line, chr(10) ORDER BY part, id) || '{_TAIL}' AS text FROM lines""",
    "adoc_to_ldd": rf"""WITH raw AS (SELECT doc, unnest(range(0, len(l)))::INT AS pos, trim(unnest(l)) AS t FROM (SELECT s_suppkey AS doc, string_split({SUPPLIER_ADOC}, chr(10)) AS l FROM supplier)),
lines AS (SELECT *, length(regexp_extract(t, '^(={{1,6}})\s+\S', 1)) AS level, t = '' OR t LIKE '//%' AS blank FROM raw),
starts AS (SELECT *, (level > 0 OR (NOT blank AND coalesce(lag(blank) OVER w OR lag(level) OVER w > 0, true))) AND NOT blank AS opens FROM lines WINDOW w AS (PARTITION BY doc ORDER BY pos)),
blocks AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY pos) AS block FROM starts),
nodes AS (SELECT doc, block, max(level) AS level, string_agg(t, chr(10) ORDER BY pos) AS text FROM blocks WHERE NOT blank GROUP BY doc, block),
linked AS (SELECT n.*, (SELECT max(h.block) FROM nodes h WHERE h.doc = n.doc AND h.block < n.block AND h.level > 0 AND (n.level = 0 OR h.level < n.level)) AS up FROM nodes n)
SELECT doc, block::BIGINT AS node_id, up::BIGINT AS parent_id, (row_number() OVER (PARTITION BY doc, up ORDER BY block) - 1)::INT AS ordinal, (CASE WHEN level > 0 THEN level ELSE -1 END)::INT AS level,
CASE WHEN level > 0 THEN trim(regexp_replace(text, '^=+\s+', '')) ELSE '' END AS title, CASE WHEN level = 0 THEN 'paragraph' END AS type, CASE WHEN level = 0 THEN text END AS text FROM linked""",
    "composite_json": RESULTS_SQL + """, cut AS (SELECT *, left(text, 500) AS chunk_text, (SELECT label FROM embeddings WHERE vec_id = chunk_id) AS heading_level FROM res),
plain AS (SELECT '{"source":"store","query":"q0","topK":10,"entries":[' || coalesce(string_agg('{"source":"store","chunkId":' || chunk_id || ',"chunkText":' || to_json(chunk_text)::VARCHAR || ',"sectionPath":' || to_json(section_path)::VARCHAR
  || ',"headingLevel":' || heading_level || ',"sourceDocument":' || to_json(source_document)::VARCHAR || ',"similarity":' || similarity || '}', ',' ORDER BY similarity DESC, chunk_id), '') || '],"count":' || count(*) || '}' AS text FROM cut),
t AS (SELECT left(string_agg('[' || source_document || ' / ' || section_path || '] (similarity=' || printf('%.3f', similarity) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY similarity DESC, chunk_id), 2800) AS text, count(*) AS results FROM res)
SELECT text, 'plain' AS form FROM plain UNION ALL SELECT '{"source":"store","query":"q0","topK":10,"docsSection":' || to_json(text)::VARCHAR || ',"budget":{"totalTokenBudget":8000,"eager":0.4,"rag":0.3,"graphify":0.2,"docs":0.1},"count":' || results || '}', 'typed' FROM t WHERE results > 0""",
    "adoc_to_markdown_fenced": _FENCED + EMIT_SQL,
    "adoc_to_markdown_plain": _SHORT + EMIT_SQL.replace(r"regexp_replace(t, 'pass:\[([^\]]*)\]', '\1', 'g')", "t"),
    "book_asciidoc": f"WITH {STYLED_SQL}, kinds AS ({KINDS_SQL})" + _BOOK,
    "plain_asciidoc": rf"""WITH {STYLED_SQL}, p AS (SELECT doc, CASE WHEN r <= 0.5 THEN m + 0.1 ELSE m * 0.95 END AS h1, CASE WHEN r <= 0.5 THEN m + 0.1 ELSE m * 0.75 END AS h2, CASE WHEN r <= 0.5 THEN m + 0.1 ELSE m * 0.5 END AS h3
  FROM (SELECT doc, CASE WHEN isnan(max) THEN 0 ELSE max END AS m, CASE WHEN isnan(range) THEN 0 ELSE range END AS r FROM thresholds)),
rows AS (SELECT styled.doc, page, seq, text, style = 'MONOSPACE' AS mono, coalesce(lag(style = 'MONOSPACE') OVER w, false) AS was, coalesce(lead(style = 'MONOSPACE') OVER w, false) AS will,
  CASE WHEN font_size::DOUBLE >= h1 AND style IN ('BOLD', 'BOLD_ITALIC') THEN 1 WHEN font_size::DOUBLE >= h1 THEN 2 WHEN font_size::DOUBLE >= h2 AND style IN ('BOLD', 'BOLD_ITALIC') THEN 2 WHEN font_size::DOUBLE >= h2 THEN 3
  WHEN font_size::DOUBLE >= h3 AND style IN ('BOLD', 'BOLD_ITALIC') THEN 3 ELSE 0 END AS level FROM styled JOIN p ON styled.doc = p.doc WINDOW w AS (PARTITION BY styled.doc ORDER BY page, seq)),
parts AS (SELECT doc, page, seq, CASE WHEN mono THEN CASE WHEN NOT was THEN '[source,text]' || chr(10) || '----' || chr(10) ELSE '' END || text || CASE WHEN NOT will THEN chr(10) || '----' || chr(10) ELSE '' END
  WHEN level > 0 THEN chr(10) || repeat('=', level) || ' ' || text || chr(10) ELSE text END AS part FROM rows)
SELECT doc, regexp_replace('= Structure' || chr(10) || chr(10) || '[NOTE]' || chr(10) || '====' || chr(10) || 'Generated.' || chr(10) || '====' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY page, seq), '\s+$', '') || chr(10) AS text FROM parts GROUP BY doc""",
    "ingest_chunks": f"""WITH {CONVERSATION_SQL}, kept AS (SELECT * FROM contents WHERE content <> ''),
ids AS (SELECT source_document, row_number() OVER (ORDER BY min(sec), source_document) AS id FROM kept GROUP BY source_document)
SELECT id AS document_id, (row_number() OVER (PARTITION BY k.source_document ORDER BY sec) - 1)::INT AS chunk_index, path AS section_path, level AS heading_level, 384 AS dimension FROM kept k JOIN ids ON ids.source_document = k.source_document""",
    "chunk_summary": rf"WITH {CONVERSATION_SQL} SELECT source_document, count(*) AS chunks, sum(len(string_split_regex(content, '\r\n|\n|\r')))::BIGINT AS lines FROM contents WHERE content <> '' GROUP BY source_document",
    "kb_jsonld": CHUNKS_SQL + """, ids AS (SELECT *, 'chk-' || substr(sha256(source_document || ':' || path), 1, 16) AS id FROM chunks WHERE content <> '')
SELECT source_document, md5(text) AS text_md5, length(text)::INT AS chars FROM (SELECT source_document, '{"@context":{"schema":"https://schema.org/","kb":"urn:kb:","isPartOf":{"@id":"schema:isPartOf","@type":"@id"}},"@graph":['
|| string_agg('{"@id":"urn:kb:' || id || '","@type":"DocumentChunk","identifier":"' || id || '","isPartOf":"urn:kb:doc:' || source_document || '","sectionPath":' || to_json(path)::VARCHAR || ',"headingLevel":' || level || ',"text":' || to_json(content)::VARCHAR
  || ',"codeBlocks":' || to_json(bs)::VARCHAR || ',"entities":[],"overlapNext":' || to_json(coalesce(overlap_next, 'null'))::VARCHAR || ',"license":"Apache-2.0"}', ',' ORDER BY sec) || ']}' AS text FROM ids GROUP BY source_document)""",
}
