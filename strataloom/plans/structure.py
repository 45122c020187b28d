"""Queries of AsciiDoc conversion and typography over documents derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asciidoc, typography
from .inputs import table

#: One AsciiDoc document a supplier; the same expression in Spark and in the oracle.
SUPPLIER_ADOC = """concat_ws(chr(10), concat('= Supplier ', s_name), '', '// hidden', concat('Intro for ', s_name, ' of nation ', cast(s_nationkey as string)), '', '',
'Second part pass:[x1]', '[NOTE]', '====', 'Mind the balance', '====', '.Table of keys', '|===', concat('|key | ', cast(s_suppkey as string), ' |'), '|===', '',
'* item one', '** item two', '', '- item three', '.Step', 'image:logo.png[Logo]', 'link:site[http://a.example]', 'http://b.example[B]', 'http://c.example', '[TIP] look',
'[source,sql]', case when s_suppkey % 2 = 0 then '----' else 'SELECT 0' end, concat('SELECT ', cast(s_suppkey as string)), '----', '', '', 'After code', '== Heading', '=======  Deep', '..not a step', '[WARNING]', 'End.',
case when s_suppkey % 3 = 0 then concat('[source,text]', chr(10), 'open code') else 'Last line' end)"""


def _adoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.expr(SUPPLIER_ADOC).alias("text"))


def adoc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asciidoc.classify(_adoc(spark, sf_dir)).select("doc", "pos", "rule", "in_code", F.col("pending").cast("bigint").alias("pending"))


def _markdown(rules: str, fenced: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return asciidoc.to_markdown(_adoc(spark, sf_dir), rules, fenced)

    return query


FONTS = ("Courier", "DejaVuMono", "Helvetica-Bold", "Times-BoldOblique", "Times-Italic", "Helvetica", "DIN bd Regular", "Helvetica it Regular", "Inter-Black", "JetBrains Mono Bold", "Slanted")
_FONT = "element_at(array({}), cast(p_partkey % {} as int) + 1)".format(", ".join(f"'{f}'" for f in FONTS), len(FONTS))
_FONT_SQL = "([{}])[(p_partkey % {})::INT + 1]".format(", ".join(f"'{f}'" for f in FONTS), len(FONTS))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        (F.col("p_partkey") % 20).alias("doc"), (F.col("p_partkey") % 3).cast("int").alias("page"), F.col("p_partkey").cast("int").alias("seq"), F.col("p_name").alias("text"),
        typography.font_style(F.expr(_FONT)).alias("style"), F.col("p_size").cast("float").alias("font_size"), ((F.col("p_partkey") * 7 % 101) * 0.75).cast("float").alias("y"),
    )


def font_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = typography.font_style(F.expr(_FONT))
    return table(spark, sf_dir, "part").select("p_partkey", style.alias("style"), typography.is_mono(style).alias("mono"), typography.is_bold(style).alias("bold"), typography.is_italic(style).alias("italic"))


def header_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = typography.size_statistics(_lines(spark, sf_dir))
    return sizes.select("doc", *(F.round(c, 6).alias(n) for n, c in zip(("avg", "max", "range"), (F.col("avg"), F.col("max"), F.col("range")), strict=True)), *(F.round(c, 6).alias(f"h{k}") for k, c in enumerate(typography.book_thresholds(), 1)))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    sized = typography.size_statistics(lines).select("doc", *typography.plain_thresholds())
    return lines.join(sized, "doc").select("seq", typography.plain_level(F.col("font_size").cast("double"), F.col("style")).alias("level"))


def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = typography.text_groups(_lines(spark, sf_dir))
    return groups.select("doc", F.col("grp").cast("bigint").alias("grp"), F.size("rows").cast("bigint").alias("lines"), "mono", "near_mono")


def book_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typography.book_groups(_lines(spark, sf_dir)).select("doc", F.col("grp").cast("bigint").alias("grp"), "kind")


def book_asciidoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return typography.book_asciidoc(lines.select("doc").distinct(), lines)


def plain_asciidoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return typography.plain_asciidoc(lines.select("doc").distinct(), lines, "Structure", "Generated.")


QUERIES = {
    "adoc_lines": adoc_lines,
    "adoc_to_markdown": _markdown(asciidoc.FULL, False),
    "adoc_to_markdown_fenced": _markdown(asciidoc.FULL, True),
    "adoc_to_markdown_plain": _markdown(asciidoc.PLAIN, False),
    "font_style": font_style,
    "header_thresholds": header_thresholds,
    "heading_levels": heading_levels,
    "visual_lines": visual_lines,
    "book_groups": book_groups,
    "book_asciidoc": book_asciidoc,
    "plain_asciidoc": plain_asciidoc,
}

_STYLE = """CASE WHEN regexp_matches(f, 'mono|courier|consolas|menlo|monaco|typewriter|source code|fira code|jetbrains') THEN 'MONOSPACE'
WHEN regexp_matches(f, 'bold|bd |heavy|black') AND regexp_matches(f, 'italic|oblique|slanted|it ') THEN 'BOLD_ITALIC' WHEN regexp_matches(f, 'bold|bd |heavy|black') THEN 'BOLD'
WHEN regexp_matches(f, 'italic|oblique|slanted|it ') THEN 'ITALIC' ELSE 'NORMAL' END"""
STYLED_SQL = f"""styled AS (SELECT *, {_STYLE} AS style FROM (SELECT p_partkey, p_partkey % 20 AS doc, (p_partkey % 3)::INT AS page, p_partkey::INT AS seq, p_name AS text, p_size::FLOAT AS font_size,
((p_partkey * 7 % 101) * 0.75)::FLOAT AS y, lower({_FONT_SQL}) AS f FROM part)),
stats AS (SELECT doc, coalesce(avg(font_size::DOUBLE) FILTER (style <> 'MONOSPACE'), 'nan'::DOUBLE) AS avg, coalesce(max(font_size::DOUBLE) FILTER (style <> 'MONOSPACE'), 'nan'::DOUBLE) AS max,
  coalesce(min(font_size::DOUBLE) FILTER (style <> 'MONOSPACE'), 'nan'::DOUBLE) AS min FROM styled GROUP BY doc),
thresholds AS (SELECT *, max - min AS range FROM stats),
limits AS (SELECT *, {{}} FROM thresholds),
gaps AS (SELECT *, coalesce(abs(y - lag(y) OVER (PARTITION BY doc ORDER BY y, page, seq)) >= 2.0, true) AS far FROM styled),
grouped AS (SELECT *, sum(far::INT) OVER (PARTITION BY doc ORDER BY y, page, seq) AS grp FROM gaps),
groups AS (SELECT doc, grp::BIGINT AS grp, count(*) AS lines, bool_and(style = 'MONOSPACE') AS mono, bool_and(style IN ('BOLD', 'BOLD_ITALIC', 'NORMAL')) AS strong, first(font_size::DOUBLE ORDER BY y, page, seq) AS size FROM grouped GROUP BY doc, grp),
near AS (SELECT *, coalesce(lag(mono) OVER w, false) OR coalesce(lead(mono) OVER w, false) AS near_mono FROM groups WINDOW w AS (PARTITION BY doc ORDER BY grp))""".format(
    ", ".join(f"CASE WHEN range > {k} AND NOT isnan(range) THEN max - range * {a} ELSE max * {b} END AS h{k}" for k, a, b in ((1, 0.05, 0.95), (2, 0.25, 0.75), (3, 0.5, 0.5), (4, 0.7, 0.35)))
)

MACHINE_SQL = r"""WITH docs AS (SELECT s_suppkey AS doc, string_split(%s, chr(10)) AS l FROM supplier),
raw AS (SELECT doc, unnest(range(0, len(l)))::INT AS pos, unnest(l) AS line FROM docs),
nexts AS (SELECT *, trim(line) AS t, lead(trim(line)) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM raw),
vis AS (SELECT *, CASE WHEN t LIKE '[source,%%' THEN 1 WHEN t = '----' THEN 0 END AS marker FROM nexts WHERE t NOT LIKE '//%%'),
state AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS in_code FROM vis),
ruled AS (SELECT *, CASE WHEN in_code AND t = '----' THEN 'code_end' WHEN in_code THEN 'code' WHEN t = '----' THEN 'skip' WHEN t LIKE '[source,%%' THEN 'code_start'
  WHEN regexp_matches(t, '^\[(NOTE|CAUTION|WARNING|TIP|IMPORTANT)\]') THEN 'admonition' WHEN t = '====' THEN 'example' WHEN t LIKE '=%%' THEN 'heading'
  WHEN t LIKE '.Table%%' OR (t LIKE '.%%' AND coalesce(nxt LIKE '|===%%', false)) THEN 'table_title' WHEN t LIKE '|===%%' THEN 'table_edge' WHEN t LIKE '|%%' THEN 'table_row' WHEN t = '' THEN 'blank'
  WHEN t LIKE 'image:%%' THEN 'image' WHEN t LIKE 'link:%%' OR t LIKE 'http%%' THEN 'link' WHEN t LIKE '* %%' OR t LIKE '- %%' OR t LIKE '** %%' THEN 'item' WHEN t LIKE '.%%' AND t NOT LIKE '..%%' THEN 'title' ELSE 'text' END AS rule FROM state),
coded AS (SELECT *, sum((rule = 'code_start')::INT) OVER (PARTITION BY doc ORDER BY pos) AS run FROM ruled),
held AS (SELECT *, count(*) FILTER (rule = 'code') OVER (PARTITION BY doc, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n,
  string_agg(line, chr(10) ORDER BY pos) FILTER (rule = 'code') OVER (PARTITION BY doc, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code,
  first_value(regexp_extract(t, '\[source,(\w+)\]', 1)) OVER (PARTITION BY doc, run ORDER BY pos) AS lang FROM coded),
grps AS (SELECT *, coalesce(sum((NOT (rule IN ('code', 'skip', 'code_start', 'blank') OR (rule = 'code_end' AND n = 0)))::INT) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM held),
pend AS (SELECT *, coalesce(sum((rule = 'blank')::INT) OVER (PARTITION BY doc, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pending FROM grps)
""" % SUPPLIER_ADOC  # noqa: UP031

EMIT_SQL = r""", emitted AS (SELECT *, CASE rule WHEN 'code_end' THEN CASE WHEN n > 0 THEN '```' || lang || chr(10) || code || chr(10) || '```' || chr(10) || chr(10) ELSE '' END
  WHEN 'admonition' THEN '> **' || CASE WHEN t LIKE '%]' THEN upper(substr(t, 2, 1)) || lower(substr(t, 3, length(t) - 3)) ELSE lower(t) END || '**' || chr(10)
  WHEN 'example' THEN chr(10) WHEN 'table_edge' THEN chr(10)
  WHEN 'heading' THEN CASE WHEN pending > 0 THEN chr(10) ELSE '' END || repeat('#', least(length(regexp_extract(t, '^=+')), 6)) || ' ' || trim(regexp_replace(t, '^=+', '')) || chr(10) || chr(10)
  WHEN 'table_title' THEN chr(10) || '**' || trim(substr(t, 2)) || '**' || chr(10) || chr(10)
  WHEN 'table_row' THEN '| ' || array_to_string(list_transform(string_split(regexp_replace(t, '(\|\s*)+$', ''), '|')[2:], lambda c: trim(c)), ' | ') || ' |' || chr(10)
  WHEN 'image' THEN '![' || regexp_extract(t, '^image:([^\[]*)', 1) || '](' || regexp_extract(t, '\[([^\]]*)', 1) || ')' || chr(10) || chr(10)
  WHEN 'link' THEN '[' || coalesce(nullif(regexp_extract(replace(t, 'link:', ''), '^([^\[]*)', 1), ''), t) || '](' || coalesce(nullif(regexp_extract(t, '\[([^\]]*)', 1), ''), nullif(regexp_extract(replace(t, 'link:', ''), '^([^\[]*)', 1), ''), t) || ')' || chr(10)
  WHEN 'item' THEN CASE WHEN pending > 0 THEN chr(10) ELSE '' END || '- ' || trim(substr(t, CASE WHEN t LIKE '*%' THEN 2 ELSE 3 END)) || chr(10)
  WHEN 'title' THEN CASE WHEN pending > 0 THEN chr(10) ELSE '' END || '- ' || trim(substr(t, 2)) || chr(10)
  WHEN 'text' THEN CASE WHEN pending >= 2 THEN chr(10) ELSE '' END || regexp_replace(t, 'pass:\[([^\]]*)\]', '\1', 'g') || chr(10) ELSE '' END AS part FROM pend),
ends AS (SELECT doc, CASE WHEN last(rule ORDER BY pos) = 'code' THEN '```' || last(lang ORDER BY pos) || chr(10) || last(code ORDER BY pos) || chr(10) || '```' ELSE '' END AS tail FROM emitted GROUP BY doc),
texts AS (SELECT doc, string_agg(part, '' ORDER BY pos) AS body FROM emitted GROUP BY doc)
SELECT texts.doc, regexp_replace(body || tail, '\s+$', '') || chr(10) AS text FROM texts JOIN ends ON texts.doc = ends.doc"""

KINDS_SQL = """SELECT near.doc, grp, CASE WHEN mono AND size <= 14 AND lines = 1 AND NOT near_mono THEN 'inline' WHEN mono AND size <= 14 THEN 'code'
WHEN NOT mono AND lines <= 2 AND size + CASE WHEN strong THEN 0.5 ELSE 0 END >= h1 THEN 'h1' WHEN NOT mono AND lines <= 2 AND size + CASE WHEN strong THEN 0.5 ELSE 0 END >= h2 THEN 'h2'
WHEN NOT mono AND lines <= 2 AND size + CASE WHEN strong THEN 0.5 ELSE 0 END >= h3 THEN 'h3' WHEN NOT mono AND lines <= 2 AND size + CASE WHEN strong THEN 0.5 ELSE 0 END >= h4 THEN 'h4' ELSE 'text' END AS kind
FROM near JOIN limits ON near.doc = limits.doc"""

ORACLE_SQL = {
    "adoc_lines": MACHINE_SQL + "SELECT doc, pos, rule, in_code, pending FROM pend",
    "adoc_to_markdown": MACHINE_SQL + EMIT_SQL,
    "font_style": f"SELECT p_partkey, style, style = 'MONOSPACE' AS mono, style IN ('BOLD', 'BOLD_ITALIC') AS bold, style IN ('ITALIC', 'BOLD_ITALIC') AS italic FROM (SELECT p_partkey, {_STYLE} AS style FROM (SELECT p_partkey, lower({_FONT_SQL}) AS f FROM part))",
    "header_thresholds": f"WITH {STYLED_SQL} SELECT doc, round(avg, 6) AS avg, round(max, 6) AS max, round(range, 6) AS range, round(h1, 6) AS h1, round(h2, 6) AS h2, round(h3, 6) AS h3, round(h4, 6) AS h4 FROM limits",
    "heading_levels": f"""WITH {STYLED_SQL}, p AS (SELECT doc, CASE WHEN range <= 0.5 THEN max + 0.1 ELSE max * 0.95 END AS h1, CASE WHEN range <= 0.5 THEN max + 0.1 ELSE max * 0.75 END AS h2, CASE WHEN range <= 0.5 THEN max + 0.1 ELSE max * 0.5 END AS h3 FROM thresholds)
SELECT seq, CASE WHEN font_size::DOUBLE >= h1 AND style IN ('BOLD', 'BOLD_ITALIC') THEN 1 WHEN font_size::DOUBLE >= h1 THEN 2 WHEN font_size::DOUBLE >= h2 AND style IN ('BOLD', 'BOLD_ITALIC') THEN 2 WHEN font_size::DOUBLE >= h2 THEN 3
WHEN font_size::DOUBLE >= h3 AND style IN ('BOLD', 'BOLD_ITALIC') THEN 3 ELSE 0 END AS level FROM styled JOIN p ON styled.doc = p.doc""",
    "visual_lines": f"WITH {STYLED_SQL} SELECT doc, grp, lines, mono, near_mono FROM near",
    "book_groups": f"WITH {STYLED_SQL} {KINDS_SQL}",
}
