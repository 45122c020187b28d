"""OCR collection: a chain of engines behind a port, a cache by content hash, and page assembly."""

from __future__ import annotations

import base64
import shutil
import subprocess
import threading
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import place_in_group
from ..functions.text import is_blank
from ..session import spread, staged
from ..sources.keyed import KeyedTable

#: Image suffixes with their types, language codes, the prompt, and the texts of empty pages and books.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "gif": "image/gif"}
LANGUAGES = {"fra": ("fr", "fra", "french"), "eng": ("en", "eng", "english", "auto"), "deu": ("de", "deu", "german"), "spa": ("es", "spa", "spanish"), "ita": ("it", "ita", "italian")}
PROMPT = "Extract all visible text from the image and structure it as AsciiDoc. Use = for section titles, code blocks for code, tables for tabular data."
EMPTY_PAGE = "[page vide ou OCR échec]"
EMPTY_BOOK = "= [Empty OCR]\n\nNo images found in {}.\n"
LLM_CONFIDENCE, COMMAND_CONFIDENCE = 0.9, 0.7


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(IMAGE_TYPES)})$")


def mime_type(path: Column) -> Column:
    suffix, out = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)), F.lit("image/png")
    for k, v in IMAGE_TYPES.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def language_code(language: Column) -> Column:
    low = F.lower(language)
    out = F.left(low, F.lit(3))
    for code, names in LANGUAGES.items():
        out = F.when(low.isin(*names), code).otherwise(out)
    return out


def prompt(language: Column, given: Column) -> Column:
    return F.concat(F.coalesce(given, F.lit(PROMPT)), F.lit("\nLanguage: "), language)


def data_uri(content: Column, mime: Column) -> Column:
    kind = F.when(mime.startswith("image/"), F.substring(mime, 7, 1 << 20)).otherwise(F.lit("png"))
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def response_text(response: Column) -> Column:
    """The text in a chat service's answer: message.content, else response."""
    return F.coalesce(F.get_json_object(response, "$.message.content"), F.get_json_object(response, "$.response"))


class Engine(Protocol):
    """What reads a page: its name, and text and confidence of an image."""

    name: str

    def process(self, content: bytes, mime: str, language: str) -> tuple[str, float]: ...


class ChatClient(Protocol):
    """A vision model's chat: the text that it answers to a prompt with images (data URIs)."""

    def chat(self, config: Mapping[str, object], prompt: str, images: Sequence[str]) -> str: ...


#: The settings of the default model.
CONFIG = {"provider": "ollama", "model": "gpt-oss:120b-cloud", "maxTokens": 4096, "temperature": 0.0, "endpoint": None, "extra": {}}


class ChatEngine:
    """Reads a page through a chat client; an empty image or a blank answer is no success.

    What the client raises counts as a failed page (see run_engines).
    """

    def __init__(self, client: ChatClient, config: Mapping[str, object] = CONFIG, prompt: str | None = None):
        self.client, self.config, self.prompt, self.name = client, config, prompt, str(config["model"])

    def process(self, content: bytes, mime: str, language: str) -> tuple[str, float]:
        if not content:
            return "", 0.0
        kind = mime.removeprefix("image/") if mime.startswith("image/") else "png"
        image = f"data:image/{kind};base64,{base64.b64encode(content).decode()}"
        answer = (self.client.chat(self.config, f"{self.prompt or PROMPT}\nLanguage: {language}", [image]) or "").strip()
        return (answer, LLM_CONFIDENCE) if answer else ("", 0.0)


class CommandEngine:
    """Reads a page with a program that takes an image on its input and writes text, such as tesseract.

    Where the program isn't installed every page fails, and the next engine is tried.
    """

    def __init__(self, command: Sequence[str] = ("tesseract", "-", "-", "-l", "{language}"), name: str = "tesseract", seconds: float = 120):
        self.command, self.name, self.seconds = tuple(command), name, seconds

    def process(self, content: bytes, mime: str, language: str) -> tuple[str, float]:
        if not content or not shutil.which(self.command[0]):
            return "", 0.0
        code = next((k for k, names in LANGUAGES.items() if language.lower() in names), language.lower()[:3])
        done = subprocess.run([part.format(language=code) for part in self.command], input=content, capture_output=True, timeout=self.seconds, check=False)
        text = done.stdout.decode(errors="replace").strip() if done.returncode == 0 else ""
        return (text, COMMAND_CONFIDENCE) if text else ("", 0.0)


RESULTS = "page_id string, engine int, model string, text string, confidence double"


@dataclass(frozen=True)
class Calls:
    """How a task calls engines: pages in flight at once, seconds that a call may take, and how often it is tried again, after how long.

    Engines are called from several threads if more than one page is in flight.
    """

    in_flight: int = 8
    seconds: float | None = 300.0
    retries: int = 0
    wait: float = 0.5


class _Worker:
    """A thread's present call: its page, engine and try, and since when it lasts; ``left`` once nobody waits for it any more."""

    def __init__(self, start: tuple | None = None):
        self.start, self.call, self.since, self.left = start, None, None, False


class _Batch:
    """The pages of a batch read by a few threads, each of which takes the next page when it is done with one.

    A call that lasts too long is left to itself in its thread, which ends with it or with its process; another thread goes
    on with the page.
    """

    def __init__(self, pages: list, engines: Sequence[Engine], calls: Calls):
        self.pages, self.engines, self.calls = pages, engines, calls
        self.next = iter(range(len(pages)))
        self.rows: list[list[tuple]] = [[] for _ in pages]
        self.lock, self.done = threading.Lock(), threading.Event()
        self.open, self.error = len(pages), None
        self.workers: list[_Worker] = []

    def results(self) -> list[tuple]:
        for _ in range(min(max(1, self.calls.in_flight), len(self.pages))):
            self._start(_Worker())
        while self.open and not self.done.wait(self._relieve()):
            pass
        if self.error is not None:
            raise self.error
        return [row for found in self.rows for row in found]

    def _start(self, worker: _Worker) -> None:
        self.workers.append(worker)
        threading.Thread(target=self._work, args=(worker,), daemon=True).start()

    def _relieve(self) -> float | None:
        """Put new threads in the place of those whose call is late; the seconds until the next may be."""
        seconds = self.calls.seconds
        if seconds is None:
            return None
        least, late = seconds, []
        with self.lock:
            now = time.monotonic()
            for worker in self.workers:
                rest = seconds if worker.since is None else worker.since + seconds - now
                if rest <= 0:
                    worker.left = True
                    late.append(worker)
                else:
                    least = min(least, rest)
            self.workers = [w for w in self.workers if not w.left]
        for worker in late:
            at, engine, tries = worker.call
            self._start(_Worker((at, engine, tries + 1)))
        return least

    def _work(self, worker: _Worker) -> None:
        try:
            if worker.start is not None:
                self._page(worker, *worker.start)
            while not worker.left and self.error is None:
                at = next(self.next, None)
                if at is None:
                    break
                self._page(worker, at, 0, 0)
        except BaseException as error:  # noqa: BLE001  handed on to the waiting thread
            if not worker.left:
                self.error = error
                self.done.set()

    def _page(self, worker: _Worker, at: int, engine: int, tries: int) -> None:
        page = self.pages[at]
        while engine < len(self.engines):
            text, confidence = "", 0.0
            while tries <= self.calls.retries:
                if tries:
                    time.sleep(self.calls.wait * 2 ** (tries - 1))
                with self.lock:
                    worker.call, worker.since = (at, engine, tries), time.monotonic()
                try:
                    text, confidence = self.engines[engine].process(bytes(page.content or b""), page.mime, page.language)
                    text, confidence, failed = text or "", float(confidence), False
                except Exception:  # noqa: BLE001  whatever an engine raises is a failed page, not a failed job
                    text, confidence, failed = "", 0.0, True
                with self.lock:
                    worker.since = None
                    if worker.left:
                        return
                if not failed:
                    break
                tries += 1
            self.rows[at].append((page.page_id, engine, self.engines[engine].name, text, confidence))
            if text and confidence > 0:
                break
            engine, tries = engine + 1, 0
        with self.lock:
            self.open -= 1
            if not self.open:
                self.done.set()


def run_engines(pages: DataFrame, engines: Sequence[Engine], calls: Calls = Calls()) -> DataFrame:
    """What each page of ``pages`` (page_id, content, mime, language) gets, engines tried in turn until one succeeds.

    An engine that raises, or doesn't answer in time, whenever it is tried counts as an empty result with confidence 0.  Results are in the order of the pages.
    """
    chain = list(engines)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = _Batch(list(batch.itertuples(index=False)), chain, calls).results()
            yield pd.DataFrame(rows, columns=["page_id", "engine", "model", "text", "confidence"])

    return pages.select("page_id", "content", "mime", "language").mapInPandas(read, RESULTS)


def first_success(results: DataFrame, key: str = "page_id") -> DataFrame:
    """key, text, confidence and model of each page's first result with text and confidence; empty, by "pipeline", without one."""
    good = (F.col("text") != "") & (F.col("confidence") > 0)
    best = F.min(F.when(good, F.struct("engine", "text", "confidence", "model")))
    picked = results.groupBy(key).agg(best.alias("b"))
    return picked.select(key, F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("b.model", F.lit("pipeline")).alias("model"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_misses(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """The pages (page_id, source_hash, ...) that the cache (page_id, source_hash, ...) doesn't hold with that hash."""
    return pages.join(cache.select("page_id", "source_hash"), ["page_id", "source_hash"], "left_anti")


def with_cache(pages: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every page's text: cached if the hash is the same, else the fresh one's; failed results are reused too."""
    hit = cache.select("page_id", "source_hash", F.col("text").alias("cached"))
    new = fresh.select("page_id", F.col("text").alias("fresh"))
    joined = pages.join(hit, ["page_id", "source_hash"], "left").join(new, "page_id", "left")
    return joined.select(*pages.columns, F.coalesce("cached", "fresh", F.lit("")).alias("text"), F.col("cached").isNotNull().alias("hit"))


def updated_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache after ``fresh`` overwrote its pages: last write wins."""
    return cache.join(fresh.select("page_id"), "page_id", "left_anti").unionByName(fresh.select(cache.columns))


def numbered_pages(pages: DataFrame, book: str = "book", stem: str = "page_id", text: str = "text") -> DataFrame:
    """Add page_number (by stem within the book), file_name and body; a blank page says so."""
    body = F.when(is_blank(F.coalesce(F.col(text), F.lit(""))), F.lit(EMPTY_PAGE)).otherwise(F.col(text))
    numbered = place_in_group(pages, book, [stem], "page_number").withColumn("page_number", F.col("page_number") + 1)
    return numbered.withColumn("file_name", F.format_string("%03d-%s.adoc", "page_number", F.col(stem).cast("string"))).withColumn("body", body)


def book_text(pages: DataFrame, book: str = "book", books: DataFrame | None = None) -> DataFrame:
    """book and text: the numbered pages under one title, a section a page.

    With ``books`` (book), those without pages have a text that says so.
    """
    part = F.struct("page_number", F.concat(F.lit("== Page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda r: r["p"]), "\n")
    texts = pages.groupBy(book).agg(F.concat(F.lit("= OCR Book\n\n"), joined).alias("text"))
    if books is None:
        return texts
    empty = F.concat(F.lit(EMPTY_BOOK.split("{}")[0]), F.col(book).cast("string"), F.lit(EMPTY_BOOK.split("{}")[1]))
    return books.select(book).distinct().join(texts, book, "left").select(book, F.coalesce("text", empty).alias("text"))


CACHE = "page_id string, source_hash string, text string, confidence double, model string"


class OcrCache:
    """What images have given, by page, in a keyed table: a look-up reads the buckets of its pages, a store writes those of new results.

    Pages are named book/page_id.  Results are stored with their image's hash, failures too; the last one stays.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = KeyedTable(spark, path, CACHE, ["page_id"], buckets)

    def lookup(self, pages: DataFrame) -> DataFrame:
        """The entries (CACHE) of ``pages`` (page_id)."""
        return self.table.lookups(pages)

    def store(self, fresh: DataFrame) -> list[int]:
        """Put ``fresh`` (CACHE, a row a page) in; returns the buckets written."""
        return self.table.replace(fresh)


def collect(images: DataFrame, cache: DataFrame, engines: Sequence[Engine], language: str = "fr", calls: Calls = Calls()) -> tuple[DataFrame, DataFrame]:
    """The pages of ``images`` (book, page_id, content, mime) and the cache (CACHE) afterwards.

    A page is read by the engines, in turn, only if the cache doesn't hold its image's hash; what they find is stored, failures
    too.  Pages have book, page_id, page_number, file_name, body and hit.  Cache entries are named book/page_id.
    """
    pages, fresh = _collected(images, cache, engines, language, calls)
    return pages, updated_cache(cache, fresh.select(cache.columns))


def collect_with(store: OcrCache, images: DataFrame, engines: Sequence[Engine], language: str = "fr", calls: Calls = Calls()) -> DataFrame:
    """The pages of ``images`` as in ``collect``, by a cache on disk that holds the new results afterwards."""
    names = images.select(_cache_name().alias("page_id"))
    cache = staged(store.lookup(names), "ocr-cache")
    pages, fresh = _collected(images, cache, engines, language, calls)
    store.store(fresh)
    return pages


def _cache_name() -> Column:
    return F.concat_ws("/", F.col("book").cast("string"), F.col("page_id"))


def _collected(images: DataFrame, cache: DataFrame, engines: Sequence[Engine], language: str, calls: Calls) -> tuple[DataFrame, DataFrame]:
    """The pages, and the new entries (CACHE) of the cache, staged."""
    named = images.select("book", F.col("page_id").alias("stem"), _cache_name().alias("page_id"), "content", "mime", content_hash(F.col("content")).alias("source_hash"))
    misses = cache_misses(named, cache).withColumn("language", F.lit(language))
    read = first_success(run_engines(spread(misses, "page_id"), engines, calls))
    pages = named.drop("content", "mime")
    fresh = staged(read.join(pages.select("page_id", "source_hash"), "page_id").select("page_id", "source_hash", "text", "confidence", "model"), "ocr")  # engines run once
    numbered = numbered_pages(with_cache(pages, cache, fresh), "book", "stem", "text")
    return numbered.select("book", F.col("stem").alias("page_id"), "page_number", "file_name", "body", "hit"), fresh
