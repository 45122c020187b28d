"""Queries of whole ways: files to chunks, images to books, JSON in and out, and what OCR is asked and answers."""

from __future__ import annotations

import base64
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import licences, ocr, pipeline, profiles, trees
from ..session import spread, staged
from ..sources import readers
from .inputs import table


def _epub(title: str, text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        book.writestr("p.opf", '<package><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        book.writestr("a.xhtml", f"<html><body><h1>{title}</h1><p>{text}</p></body></html>")
    return out.getvalue()


def _pdf(pages: list[list[tuple[str, list[float], float, str]]], top: int = 800) -> bytes:
    """A PDF of lines (font, the first glyph's and the others' size, distance from the top, text), its content compressed."""
    fonts = sorted({line[0] for page in pages for line in page})
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[%s]/Count %d>>" % (b" ".join(b"%d 0 R" % (3 + len(fonts) + 2 * i) for i in range(len(pages))), len(pages))]
    objects += [b"<</Type/Font/Subtype/Type1/BaseFont/%s/Encoding/WinAnsiEncoding>>" % f.encode() for f in fonts]
    named = b"".join(b"/F%d %d 0 R" % (i, 3 + i) for i in range(len(fonts)))
    escaped = lambda text: text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    for page in pages:
        shown = b"\n".join(
            b"BT /F%d %g Tf 1 0 0 1 50 %g Tm (%s) Tj /F%d %g Tf (%s) Tj ET" % (fonts.index(f), sizes[0], top - y, escaped(text[:1]), fonts.index(f), sizes[-1], escaped(text[1:])) for f, sizes, y, text in page
        )
        body = zlib.compress(shown)
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 600 %d]/Resources<</Font<<%s>>>>/Contents %d 0 R>>" % (top, named, len(objects) + 2))
        objects.append(b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(body), body))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, x in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, x)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a supplier: every fourth an EPUB, the others PDF; a third each in a public, a private and another folder."""
    folder = F.when(F.col("s_suppkey") % 3 == 0, "/w/foundry/public/").when(F.col("s_suppkey") % 3 == 1, "/w/foundry/private/").otherwise("/w/else/")
    path = F.concat(folder, F.lit("sup-"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 4 == 0, ".EPUB").otherwise(".pdf"))
    mark = F.when(F.col("s_suppkey") % 5 == 0, "Apache-2.0").when(F.col("s_suppkey") % 5 == 1, "All rights reserved").otherwise("no mark")
    rows = table(spark, sf_dir, "supplier").select(path.alias("path"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), mark.alias("mark"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = []
            for path, name, nation, key, mark in zip(*(b[c] for c in ("path", "name", "nation", "key", "mark")), strict=True):
                first = [("Helvetica-Bold", [20, 12], 20, name), ("Helvetica", [9, 10], 40, f"Nation   {nation} "), ("Helvetica", [10], 50, " ")]
                second = [("Courier", [10], 20, f"key {key}"), ("Helvetica", [10], 70, mark)]
                content.append(_epub(name, mark) if path.lower().endswith(".epub") else _pdf([first, second]))
            yield pd.DataFrame({"path": b["path"], "content": content})

    return staged(spread(rows, "key").mapInPandas(build, "path string, content binary"), "made")


def files_to_asciidoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.auto_detect(_files(spark, sf_dir), fallback_zone="CSS").drop("path")


def files_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pipeline.chunks_of(pipeline.auto_detect(_files(spark, sf_dir)))
    return chunks.select("source_document", "pos", "section_path", "heading_level", "content", "license")


def pdf_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).where("lower(path) like '%.pdf'")
    return readers.raw_texts(files).withColumn("zone", licences.detect(F.col("text")))


def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).where("lower(path) like '%.pdf'")
    both = [readers.positioned_lines(files, None, plain).withColumn("plain", F.lit(plain)) for plain in (False, True)]
    return both[0].unionByName(both[1])


class EchoClient:
    """A chat client that answers with the image's bytes as text; it fails for some and is blank for others."""

    def chat(self, config, prompt: str, images) -> str:
        text = base64.b64decode(images[0].split(",", 1)[1]).decode()
        if len(text) % 5 == 0:
            raise RuntimeError("no answer")
        return f" = {text}\n" if len(text) % 3 else "  "


class LowerEngine:
    name = "lower"

    def process(self, content: bytes, mime: str, language: str) -> tuple[str, float]:
        text = content.decode()
        return (text.lower(), 0.7) if len(text) % 2 else ("", 0.0)


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A page a part, a book a brand; every other one is cached, a third of these with another image."""
    part = table(spark, sf_dir, "part")
    images = part.select(F.col("p_brand").alias("book"), F.concat(F.lit("scan-"), F.col("p_partkey").cast("string")).alias("page_id"), F.col("p_name").cast("binary").alias("content"), F.lit("image/png").alias("mime"))
    old = F.when(F.col("p_partkey") % 3 == 0, F.lit("old")).otherwise(F.col("p_name"))
    cache = part.where("p_partkey % 2 = 0").select(
        F.concat(F.col("p_brand"), F.lit("/scan-"), F.col("p_partkey").cast("string")).alias("page_id"), ocr.content_hash(old.cast("binary")).alias("source_hash"),
        F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("cached "), F.col("p_name"))).alias("text"), F.lit(0.5).alias("confidence"), F.lit("old").alias("model"),
    )
    return images, cache


def _collected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    images, cache = _images(spark, sf_dir)
    return ocr.collect(images, cache, [ocr.ChatEngine(EchoClient()), LowerEngine()])


def ocr_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collected(spark, sf_dir)[0]


def ocr_collect_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collected(spark, sf_dir)[1]


def ocr_collect_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _collected(spark, sf_dir)[0]
    books = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("book")))
    return ocr.book_text(pages, "book", books).select("book", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


_SUFFIXES = ("png", "JPG", "jpeg", "tif", "TIFF", "bmp", "gif", "txt", "webp")


def ocr_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page would be asked: its type, language code, prompt and image."""
    part = table(spark, sf_dir, "part")
    suffix = F.element_at(F.array(*(F.lit(s) for s in _SUFFIXES)), (F.col("p_partkey") % len(_SUFFIXES)).cast("int") + 1)
    language = F.element_at(F.array(*(F.lit(x) for x in ("fr", "English", "deu", "Spanish", "auto", "polski"))), (F.col("p_partkey") % 6).cast("int") + 1)
    path = F.concat(F.lit("scan."), suffix)
    given = F.when(F.col("p_partkey") % 2 == 0, F.lit("Read it."))
    mime = ocr.mime_type(path)
    return part.select("p_partkey", ocr.is_image(path).alias("image"), mime.alias("mime"), ocr.language_code(language).alias("language"), ocr.prompt(language, given).alias("prompt"), ocr.data_uri(F.col("p_name").cast("binary"), mime).alias("uri"))


def ocr_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of both shapes, and ones that can't be read."""
    part = table(spark, sf_dir, "part")
    body = F.when(F.col("p_partkey") % 4 == 0, F.to_json(F.struct(F.struct(F.col("p_name").alias("content")).alias("message")))).when(F.col("p_partkey") % 4 == 1, F.to_json(F.struct(F.col("p_name").alias("response"))))
    return part.select("p_partkey", ocr.response_text(body.when(F.col("p_partkey") % 4 == 2, "{broken").otherwise("{}")).alias("text"))


def ldd_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and their nations as JSON trees, and back."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    child = lambda n: F.struct(n["n_name"].alias("title"), F.lit(2).alias("level"), F.array(F.struct(F.lit("paragraph").alias("type"), n["n_nationkey"].cast("string").alias("text"))).alias("children"))
    joined = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    json = F.to_json(F.array(F.struct(F.col("r_name").alias("title"), F.lit(1).alias("level"), F.transform("n", child).alias("children"))))
    return trees.from_json(joined.select(F.col("r_name").alias("doc"), json.alias("json")))


def profile_vector_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later profile without a value keeps the one stored."""
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 4 != 0, F.round("value", 4))
    rows = events.select("user_id", F.col("event_id").alias("seen"), F.col("event_id").alias("created"), value.alias("vector"))
    return profiles.upsert(rows.where("seen % 3 = 0"), rows.where("seen % 3 <> 0"), ["user_id"], "seen", "created", ("vector",))


QUERIES = {
    "files_to_asciidoc": files_to_asciidoc,
    "files_to_chunks": files_to_chunks,
    "pdf_raw_text": pdf_raw_text,
    "pdf_lines": pdf_lines,
    "ocr_collect": ocr_collect,
    "ocr_collect_cache": ocr_collect_cache,
    "ocr_collect_books": ocr_collect_books,
    "ocr_requests": ocr_requests,
    "ocr_responses": ocr_responses,
    "ldd_from_json": ldd_from_json,
    "profile_vector_kept": profile_vector_kept,
}

_FILES_SQL = """WITH f AS (SELECT s_suppkey AS k, s_name, s_nationkey AS n, CASE s_suppkey % 3 WHEN 0 THEN 'OSS' WHEN 1 THEN 'CSS' ELSE 'UNKNOWN' END AS license, CASE s_suppkey % 3 WHEN 0 THEN '/w/foundry/public/' WHEN 1 THEN '/w/foundry/private/' ELSE '/w/else/' END AS folder,
  CASE s_suppkey % 5 WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'All rights reserved' ELSE 'no mark' END AS mark, CASE s_suppkey % 5 WHEN 0 THEN 'OSS' WHEN 1 THEN 'CSS' ELSE 'UNKNOWN' END AS own, s_suppkey % 4 = 0 AS epub FROM supplier)
"""
_OCR_SQL = """WITH p AS (SELECT p_brand AS book, 'scan-' || p_partkey AS page_id, p_name, p_partkey % 2 = 0 AND (p_partkey % 3 <> 0 OR p_name = 'old') AS hit, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'cached ' || p_name END AS cached,
  length(p_name) % 5 <> 0 AND length(p_name) % 3 <> 0 AS chat, length(p_name) % 2 = 1 AS low FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_id) AS page_number, CASE WHEN hit THEN cached WHEN chat THEN '= ' || p_name WHEN low THEN lower(p_name) ELSE '' END AS text FROM p),
pages AS (SELECT book, page_id, page_number, printf('%03d', page_number) || '-' || page_id || '.adoc' AS file_name, CASE WHEN text = '' THEN '[page vide ou OCR échec]' ELSE text END AS body, hit, * EXCLUDE (book, page_id, page_number, hit) FROM r)
"""
_NOTE = "[NOTE]\n====\n" + pipeline.NOTE + "\n====\n\n"

ORACLE_SQL = {
    "files_to_asciidoc": _FILES_SQL + f"""SELECT 'sup-' || k || CASE WHEN epub THEN '.EPUB' ELSE '.pdf' END AS name, CASE WHEN epub THEN 'epub' ELSE 'pdf' END AS kind,
CASE WHEN epub THEN '= {pipeline.EPUB_TITLE.replace("'", "''")}

{_NOTE}
= ' || s_name || chr(10) || chr(10) || mark || chr(10) ELSE '= {pipeline.TITLE}

{_NOTE}
= ' || s_name || chr(10) || chr(10) || 'Nation ' || n || chr(10) || '[source,text]' || chr(10) || '----' || chr(10) || 'key ' || k || chr(10) || '----' || chr(10) || chr(10) || mark || chr(10) END AS text,
license, CASE WHEN epub OR own = 'UNKNOWN' THEN 'CSS' ELSE own END AS zone, CASE WHEN NOT epub AND own = 'OSS' THEN 'OSS' ELSE 'office' END AS route, 'sup-' || k || '.adoc' AS file_name FROM f""",
    "files_to_chunks": _FILES_SQL + f"""SELECT 'sup-' || k || CASE WHEN epub THEN '.EPUB' ELSE '.pdf' END AS source_document, s.pos::BIGINT AS pos, title AS section_path, 1 AS heading_level, '# ' || title || chr(10) || body AS content, license FROM (
SELECT *, 1 AS pos, CASE WHEN epub THEN '{pipeline.EPUB_TITLE.replace("'", "''")}' ELSE '{pipeline.TITLE}' END AS title, '> **Note**' || chr(10) || chr(10) || '{pipeline.NOTE}' AS body FROM f UNION ALL
SELECT *, 2, s_name, CASE WHEN epub THEN mark ELSE 'Nation ' || n || chr(10) || 'key ' || k || chr(10) || mark END FROM f) s""",
    "pdf_raw_text": _FILES_SQL + """SELECT folder || 'sup-' || k || '.pdf' AS path, own AS zone, s_name || chr(10) || 'Nation   ' || n || ' ' || chr(10) || ' ' || chr(10) || 'key ' || k || chr(10) || mark || chr(10) AS text FROM f WHERE NOT epub""",
    "pdf_lines": _FILES_SQL + """SELECT folder || 'sup-' || k || '.pdf' AS path, page::INT AS page, seq::INT AS seq, CASE WHEN plain THEN regexp_replace(text, '\\s+', ' ', 'g') ELSE text END AS text, font AS font_name, (CASE WHEN plain THEN most ELSE one END)::FLOAT AS font_size, y::FLOAT AS y, plain FROM (
SELECT k, folder, 1 AS page, 1 AS seq, s_name AS text, 'Helvetica-Bold' AS font, 20 AS one, 20 AS most, 20 AS y FROM f WHERE NOT epub UNION ALL SELECT k, folder, 1, 2, 'Nation   ' || n, 'Helvetica', 9, 10, 40 FROM f WHERE NOT epub
UNION ALL SELECT k, folder, 2, 1, 'key ' || k, 'Courier', 10, 10, 20 FROM f WHERE NOT epub UNION ALL SELECT k, folder, 2, 2, mark, 'Helvetica', 10, 10, 70 FROM f WHERE NOT epub), (SELECT unnest([true, false]) AS plain)""",
    "ocr_collect": _OCR_SQL + "SELECT book, page_id, page_number, file_name, body, hit FROM pages",
    "ocr_collect_cache": _OCR_SQL + """SELECT book || '/' || page_id AS page_id, sha256(p_name) AS source_hash, text, CASE WHEN hit THEN 0.5 WHEN chat THEN 0.9 WHEN low THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence,
CASE WHEN hit THEN 'old' WHEN chat THEN 'gpt-oss:120b-cloud' WHEN low THEN 'lower' ELSE 'pipeline' END AS model FROM pages""",
    "ocr_collect_books": _OCR_SQL + """, texts AS (SELECT book, '= OCR Book' || chr(10) || chr(10) || string_agg('== Page ' || page_number || chr(10) || chr(10) || body || chr(10), chr(10) ORDER BY page_number) AS text FROM pages GROUP BY book
UNION ALL SELECT r_name, '= [Empty OCR]' || chr(10) || chr(10) || 'No images found in ' || r_name || '.' || chr(10) FROM region) SELECT book, md5(text) AS text_md5, length(text)::INT AS chars FROM texts""",
    "ocr_requests": """WITH p AS (SELECT p_partkey, p_name, ['png', 'JPG', 'jpeg', 'tif', 'TIFF', 'bmp', 'gif', 'txt', 'webp'][(p_partkey % 9)::INT + 1] AS s, ['fr', 'English', 'deu', 'Spanish', 'auto', 'polski'][(p_partkey % 6)::INT + 1] AS l FROM part),
m AS (SELECT *, CASE lower(s) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' WHEN 'bmp' THEN 'image/bmp' WHEN 'gif' THEN 'image/gif' ELSE 'image/png' END AS mime FROM p)
SELECT p_partkey, lower(s) NOT IN ('txt', 'webp') AS image, mime, CASE l WHEN 'fr' THEN 'fra' WHEN 'English' THEN 'eng' WHEN 'auto' THEN 'eng' WHEN 'deu' THEN 'deu' WHEN 'Spanish' THEN 'spa' ELSE 'pol' END AS language,
CASE WHEN p_partkey % 2 = 0 THEN 'Read it.' ELSE 'Extract all visible text from the image and structure it as AsciiDoc. Use = for section titles, code blocks for code, tables for tabular data.' END || chr(10) || 'Language: ' || l AS prompt,
'data:' || mime || ';base64,' || to_base64(p_name::BLOB) AS uri FROM m""",
    "ocr_responses": "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN p_name END AS text FROM part",
    "ldd_from_json": """WITH r AS (SELECT r_name AS doc, r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)),
n AS (SELECT doc, n_nationkey, n_name, row_number() OVER (PARTITION BY doc ORDER BY n_nationkey) - 1 AS i FROM r JOIN nation ON n_regionkey = r_regionkey)
SELECT doc, '/000000000' AS path, NULL AS parent, 0 AS ordinal, 0 AS depth, 1 AS level, doc AS title, NULL AS type, NULL AS text FROM r
UNION ALL SELECT doc, '/000000000/' || lpad(i::VARCHAR, 9, '0'), '/000000000', i::INT, 1, 2, n_name, NULL, NULL FROM n
UNION ALL SELECT doc, '/000000000/' || lpad(i::VARCHAR, 9, '0') || '/000000000', '/000000000/' || lpad(i::VARCHAR, 9, '0'), 0, 2, 0, '', 'paragraph', n_nationkey::VARCHAR FROM n""",
    "profile_vector_kept": """SELECT user_id, seen, created, vector FROM (SELECT user_id, event_id AS seen, min(event_id) OVER (PARTITION BY user_id) AS created, row_number() OVER w AS n,
first_value(CASE WHEN event_id % 4 <> 0 THEN round(value, 4) END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS vector FROM events WINDOW w AS (PARTITION BY user_id ORDER BY (event_id % 3 <> 0) DESC, event_id DESC)) WHERE n = 1""",
}
