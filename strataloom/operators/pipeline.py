"""The whole way from PDF and EPUB files, or from markup, to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged
from ..sources.readers import Parser, dispatch, epub_texts, file_name, file_stem, lines_of_runs, pdf_runs, texts_of_runs
from ..sources.named_files import write_files
from ..sources.sinks import write_metadata
from . import asciidoc, chunking, licences, typography

#: The titles and the note of generated documents.
TITLE, EPUB_TITLE = "Structure extraite du PDF", "Structure extraite de l'EPUB"
NOTE = "Document genere automatiquement — pipeline auto-detection PDF/EPUB."


def lines_to_asciidoc(docs: DataFrame, lines: DataFrame) -> DataFrame:
    return typography.plain_asciidoc(docs, lines, TITLE, NOTE)


def asciidoc_to_chunks(texts: DataFrame, fallback_zone: str = "UNKNOWN") -> DataFrame:
    """Chunks of AsciiDoc ``texts`` (doc, text) by the plain rules, with their licence zone and route."""
    marked = asciidoc.to_markdown(texts, asciidoc.PLAIN)
    zone = licences.effective_zone(licences.detect(F.col("text")), F.lit(fallback_zone))
    docs = marked.select(F.col("doc").cast("string").alias("source_document"), "text", zone.alias("license"))
    return chunking.chunk_documents(docs).withColumn("route", licences.route(F.col("license")))


def auto_detect(files: DataFrame, parser: Parser | None = None, license: str | None = None, fallback_zone: str = "UNKNOWN") -> DataFrame:
    """A row a file of ``files`` (path, content): path, name, kind, text (AsciiDoc), license, zone, route and file_name.

    PDF files go through the built-in reader or ``parser`` (see readers.Parser), EPUB files through their markup; a file of another
    kind is an error, one that can't be read is an empty document.  The licence is the one given, else the zone of the file's folder; the zone that
    routes is that of a PDF's own text, else ``fallback_zone``.  The runs of PDF files are staged, so a file is parsed once
    for its lines, its text and its licence, and so are the rows.
    """
    kinds = files.select("path", "content", dispatch(F.col("path")).alias("kind"))
    pdf, epub = kinds.where("kind = 'pdf'"), kinds.where("kind = 'epub'")
    style = typography.font_style(F.col("font_name"))
    runs = staged(pdf_runs(pdf, parser), "runs")
    lines = lines_of_runs(runs, plain=True).select(F.col("path").alias("doc"), "page", "seq", "text", style.alias("style"), "font_size", "y")
    books = lines_to_asciidoc(pdf.select(F.col("path").alias("doc")), lines).select(F.col("doc").alias("path"), "text")
    head = (f"= {EPUB_TITLE}", "", "[NOTE]", "====", NOTE, "====", "")
    texts = books.unionByName(epub_texts(epub, True, head))
    found = texts_of_runs(pdf, runs).select(F.col("path").alias("p"), licences.detect(F.col("text")).alias("zone"))
    zone = licences.effective_zone(F.col("zone"), F.lit(fallback_zone))
    named = F.lit(license) if license is not None else licences.zone_of_path(F.col("path"))
    rows = texts.join(found, F.col("path") == F.col("p"), "left").select(
        "path", file_name(F.col("path")).alias("name"), dispatch(F.col("path")).alias("kind"), "text", named.alias("license"), zone.alias("zone"), licences.route(zone).alias("route"),
        F.concat(file_stem(F.col("path")), F.lit(".adoc")).alias("file_name"),
    )
    done = staged(rows, "files")
    discard(runs)
    return done


def chunks_of(texts: DataFrame) -> DataFrame:
    """The chunks of auto_detect's rows; their source is the file's name with its suffix."""
    marked = asciidoc.to_markdown(texts.select(F.col("path").alias("doc"), "text"), asciidoc.PLAIN)
    named = marked.join(texts.select("path", "name", "license"), F.col("doc") == F.col("path"))
    return chunking.chunk_documents(named.select(F.col("name").alias("source_document"), "text", "license"))


def write(texts: DataFrame, folder: str, routed: bool = False) -> None:
    """auto_detect's texts as files of their names in ``folder``, with ``routed`` below their route, and a metadata sidecar.

    Files of one name, as a PDF and an EPUB of one stem, are an error.
    """
    write_files(texts, f"{folder}/texts", "file_name", "text", "route" if routed else None)
    write_metadata(texts.sparkSession, f"{folder}/metadata", "pipeline", 1, model="onnx-local")
