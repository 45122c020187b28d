"""Sources: texts, JSON, scripts, images and binary documents as DataFrames.

Every reader goes through Spark's own file sources, so any store that Spark reads will do.
Formats that need a parser (PDF, EPUB) are read in Arrow batches over the file source's rows; another parser of
PDF may take the place of the built-in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import bound_batches, give_back
from ..functions.text import rtrim_ws, trim_ws
from ..operators.html import asciidoc
from ..operators.licences import detect
from ..operators.ocr import CONFIG, content_hash, is_image, mime_type
from . import named_files, pdf

CHUNK = (
    "id string, sourceDocument string, sectionPath string, headingLevel int, content string, codeBlocks array<string>, entities array<string>, overlapNext string, license string"
)
GRAPH = "nodes array<struct<id:string,label:string,type:string,community:string>>, edges array<struct<source:string,target:string,type:string,label:string>>, communities array<struct<id:string,label:string,size:int>>"
LINES = "path string, page int, seq int, text string, font_name string, font_size float, y float"
PROFILE = (
    "learnerId string, formationId string, completedModules array<string>, currentModule string, progressionPct double, comprehensionScore double, weakPoints array<string>, "
    "lastInteractionAt string, annotations map<string,string>"
)
#: Fixed value: what the name of a cache file ends with.
CACHE_SUFFIX = ".ocr-cache.json"
OCR_RESULT = "structuredText string, confidence double, language string, sourceFormat string, generatedAt string, model string, metadata map<string,string>"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def read_texts(spark: SparkSession, path: str, license: str = "UNKNOWN", keep_suffix: bool = False) -> DataFrame:
    """source_document, text and license of whole text files (Markdown, AsciiDoc, SQL)."""
    files = named_files.small_files(spark, path, unpacked=True)
    name = F.col("name") if keep_suffix else file_stem(F.col("name"))
    return files.select(name.alias("source_document"), F.decode("content", "UTF-8").alias("text"), F.lit(license).alias("license"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_document, pos and line of text files."""
    from ..functions.text import split_lines

    texts = read_texts(spark, path)
    return texts.select("source_document", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of JSON arrays; unknown keys are ignored and missing ones take defaults."""
    rows = spark.read.schema(CHUNK).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    return rows.select(
        "id", F.col("sourceDocument").alias("source_document"), F.col("sectionPath").alias("section_path"), F.col("headingLevel").alias("heading_level"), "content",
        F.coalesce("codeBlocks", none).alias("code_blocks"), F.coalesce("entities", none).alias("entities"), F.col("overlapNext").alias("overlap_next"),
        F.coalesce("license", F.lit("UNKNOWN")).alias("license"), F.monotonically_increasing_id().alias("pos"),
    )


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of JSON section trees of any depth, a document a file."""
    from ..operators.trees import from_json

    return from_json(read_texts(spark, path).select(F.col("source_document").alias("doc"), F.col("text").alias("json")))


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    return read_texts(spark, path).select(F.col("source_document").alias("doc"), F.col("text").alias("sql"))


def graph_nodes(texts: DataFrame, column: str = "text") -> DataFrame:
    """id, label, type and community of graph JSON texts; invalid or missing text gives none."""
    parsed = texts.select(F.from_json(F.col(column), GRAPH).alias("g"))
    return parsed.select(F.explode("g.nodes").alias("n")).select("n.*")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a graph file; a missing file is an empty graph."""
    try:
        texts = read_texts(spark, path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        texts = spark.createDataFrame([], "text string")
    return graph_nodes(texts)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    rows = _json_rows(spark, path, PROFILE, {})
    return rows.select(
        F.col("learnerId").alias("learner_id"), F.col("formationId").alias("formation_id"), F.coalesce("completedModules", F.array().cast("array<string>")).alias("completed_modules"),
        F.col("currentModule").alias("current_module"), F.coalesce("progressionPct", F.lit(0.0)).alias("progression_pct"), F.coalesce("comprehensionScore", F.lit(0.0)).alias("comprehension_score"),
        F.coalesce("weakPoints", F.array().cast("array<string>")).alias("weak_points"), F.col("lastInteractionAt").alias("last_interaction_at"),
        F.coalesce("annotations", F.create_map().cast("map<string,string>")).alias("annotations"),
    )


def read_ocr_cache(spark: SparkSession, path: str) -> DataFrame:
    """The entries (ocr.CACHE) of the cache files below ``path``, named by their folders and page; a corrupt file is a miss."""
    texts = named_files.read_files(spark, path).where(F.col("name").endswith(CACHE_SUFFIX))
    shape = f"sourceHash string, result struct<{OCR_RESULT.replace(' ', ':')}>".replace(",:", ",")
    parsed = texts.select(F.left("name", F.length("name") - len(CACHE_SUFFIX)).alias("page_id"), F.from_json("text", shape).alias("c"))
    rows = parsed.where("c.sourceHash is not null and c.result is not null")
    return rows.select("page_id", F.col("c.sourceHash").alias("source_hash"), F.coalesce("c.result.structuredText", F.lit("")).alias("text"), F.coalesce("c.result.confidence", F.lit(0.0)).alias("confidence"), F.col("c.result.model").alias("model"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """page_id (the stem), content, mime and source_hash of a folder's images."""
    files = named_files.small_files(spark, path).where(is_image(F.col("name")))
    return files.select(file_stem(F.col("name")).alias("page_id"), "content", mime_type(F.col("name")).alias("mime"), content_hash(F.col("content")).alias("source_hash"))


def dispatch(path: Column) -> Column:
    """pdf or epub by the suffix; anything else raises."""
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".epub"), "epub").otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), path)))


Run = tuple[int, int, str, str, "float | list[float]", float]
#: What may read a PDF instead of the built-in reader: (page, number, text, font name, size or its glyphs' sizes, y) of each run of text.
Parser = Callable[[bytes], "list[Run]"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def pdf_runs(files: DataFrame, parser: Parser | None = None) -> DataFrame:
    """The runs of text of PDF ``files`` (path, content), see pdf.RUNS; with ``parser`` what it gives.

    What lines, texts and licences are made of: stage it and a file is parsed once.  A file that can't be read has one
    row, of page 0, with its error.
    """
    if parser is None:
        return pdf.read_runs(files)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in pdf.RUNS.split(", ")]
        for batch in batches:
            rows = []
            for p, c in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = [(page, n, text, font, glyphs if isinstance(glyphs, list) else [glyphs], y) for page, n, text, font, glyphs, y in parser(bytes(c))]
                except Exception as error:  # noqa: BLE001  whatever a parser raises is a file that can't be read
                    rows.append((p, 0, 0, None, None, None, None, None, f"{type(error).__name__}: {error}"))
                    continue
                rows += [(p, page, n, text, font, float(sizes[0]) if sizes else 0.0, float(max(sizes, default=0.0)), float(y), None) for page, n, text, font, sizes, y in found]
            yield pd.DataFrame(rows, columns=names)
        give_back()

    bound_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(parse, pdf.RUNS)


def broken_files(runs: DataFrame) -> DataFrame:
    """path, page (0: the whole file) and error of what couldn't be read."""
    return runs.where("error is not null").select("path", "page", "error")


def lines_of_runs(runs: DataFrame, plain: bool = False) -> DataFrame:
    """Lines of ``runs`` that aren't blank (LINES).

    A line has its first glyph's size and no white space at its end; with ``plain`` the largest glyph's in points, and its white
    space collapsed.
    """
    text = trim_ws(F.regexp_replace("text", r"\s+", " ")) if plain else rtrim_ws(F.col("text"))
    size = F.col("size_pt" if plain else "font_size").cast("float")
    rows = runs.where("error is null").select("path", "page", "seq", text.alias("text"), "font_name", size.alias("font_size"), F.col("y").cast("float").alias("y"))
    return rows.where(trim_ws(F.col("text")) != "")


def texts_of_runs(files: DataFrame, runs: DataFrame) -> DataFrame:
    """path and text of ``files``: runs by page, y and number, those of one y joined by a blank; null for a file that can't be read."""
    lines = runs.where("error is null").groupBy("path", "page", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), " ").alias("line"))
    texts = lines.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "y", "line"))), lambda r: F.concat(r["line"], F.lit("\n"))), "").alias("text"))
    lost = runs.where("error is not null and page = 0").select("path", F.lit(True).alias("lost")).distinct()
    known = files.select("path").join(texts, "path", "left").join(lost, "path", "left")
    return known.select("path", F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).alias("text"))


def positioned_lines(files: DataFrame, parser: Parser | None = None, plain: bool = False) -> DataFrame:
    return lines_of_runs(pdf_runs(files, parser), plain)


def read_positioned_lines(spark: SparkSession, path: str, parser: Parser | None = None, plain: bool = False) -> DataFrame:
    return positioned_lines(read_files(spark, path), parser, plain)


def raw_texts(files: DataFrame, parser: Parser | None = None) -> DataFrame:
    return texts_of_runs(files, pdf_runs(files, parser))


def licences_of(files: DataFrame, parser: Parser | None = None) -> DataFrame:
    """path and zone of PDF ``files`` by their texts; a file that can't be read is UNKNOWN."""
    return raw_texts(files, parser).select("path", detect(F.col("text")).alias("zone"))


def epub_markup(content: bytes) -> list[str]:
    """The XHTML documents of an EPUB in the order of its spine."""
    import io
    import posixpath
    import re
    import zipfile

    book = zipfile.ZipFile(io.BytesIO(content))
    container = book.read("META-INF/container.xml").decode()
    package = re.search(r'full-path="([^"]+)"', container).group(1)
    opf, base = book.read(package).decode(), posixpath.dirname(package)
    items = {}
    for tag in re.findall(r"<item\b[^>]*>", opf):
        attrs = dict(re.findall(r'([\w-]+)="([^"]*)"', tag))
        items[attrs.get("id")] = attrs.get("href", "")
    spine = re.findall(r'<itemref\b[^>]*idref="([^"]+)"', opf)
    return [book.read(posixpath.join(base, items[i])).decode() for i in spine if i in items]


def epub_texts(files: DataFrame, plain: bool = False, head: tuple[str, ...] = ()) -> DataFrame:
    """path and text (AsciiDoc) of EPUB ``files`` (path, content); one that can't be read is empty."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    markup = "".join(epub_markup(bytes(content)))
                except Exception:  # noqa: BLE001  a broken archive is a document without text
                    rows.append((where, asciidoc("", plain)))
                    continue
                rows.append((where, asciidoc(f"<body>{markup}</body>" if "<body" not in markup else markup, plain, head)))
            yield pd.DataFrame(rows, columns=["path", "text"])
        give_back()

    bound_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(convert, "path string, text string")


def read_epubs(spark: SparkSession, path: str, plain: bool = False) -> DataFrame:
    """source_document and text (AsciiDoc) of EPUB files."""
    return epub_texts(read_files(spark, path), plain).select(file_stem(F.col("path")).alias("source_document"), "text")


ENRICHED = f"ldd struct<title:string,level:int>, ragChunks array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>, graphifyNodes array<string>, semanticDensity double, entities array<string>"


def enriched_nodes(texts: DataFrame, column: str = "text") -> DataFrame:
    """ordinal, title, level, chunk_ids, graph_ids, density and entities of enriched JSON ``texts``; invalid or missing text gives none."""
    parsed = texts.select(F.posexplode(F.from_json(F.col(column), f"array<struct<{ENRICHED.replace(' array', ':array').replace(' struct', ':struct').replace(' double', ':double').replace(', ', ',')}>>")).alias("ordinal", "n"))
    none = F.array().cast("array<string>")
    return parsed.select(
        "ordinal", F.col("n.ldd.title").alias("title"), F.col("n.ldd.level").alias("level"), F.coalesce(F.transform("n.ragChunks", lambda c: c["id"]), none).alias("chunk_ids"),
        F.coalesce("n.graphifyNodes", none).alias("graph_ids"), F.coalesce("n.semanticDensity", F.lit(0.0)).alias("density"), F.coalesce("n.entities", none).alias("entities"),
    )


def _json_rows(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """The objects of JSON files, one or an array a file; what can't be read is a row of nulls."""
    kind = spark.createDataFrame([], schema).schema.simpleString()
    texts = named_files.small_files(spark, path, unpacked=True).select(F.decode("content", "UTF-8").alias("text"))
    found = F.coalesce(F.from_json("text", f"array<{kind}>"), F.array(F.lit(None).cast(kind)))
    rows = texts.select(F.explode(found).alias("r")).select("r.*")
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v) if not isinstance(v, dict) else F.create_map().cast("map<string,string>")) for c, v in defaults.items()})


def read_ocr_config(spark: SparkSession, path: str) -> DataFrame:
    """OCR settings; missing ones take defaults."""
    return _json_rows(spark, path, "provider string, model string, maxTokens int, temperature double, endpoint string, extra map<string,string>", {k: v for k, v in CONFIG.items() if k in ("maxTokens", "temperature", "extra")})


def read_ocr_requests(spark: SparkSession, path: str) -> DataFrame:
    """content, mime, language and prompt of OCR requests, whose images are base64."""
    rows = _json_rows(spark, path, "imageData string, format string, language string, prompt string", {})
    return rows.select(F.unbase64("imageData").alias("content"), F.col("format").alias("mime"), "language", "prompt")


def read_ocr_results(spark: SparkSession, path: str) -> DataFrame:
    return _json_rows(spark, path, OCR_RESULT, {"metadata": {}})
