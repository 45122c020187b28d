"""What a Python worker holds at once stays small, whatever the texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import arrow, embedding
from strataloom.operators import html
from strataloom.plans import composites
from strataloom.sources import readers

_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def wide(spark):
    """A session with Spark's own bounds."""
    before = {name: spark.conf.get(name) for name in (_ROWS, _BYTES)}
    spark.conf.set(_ROWS, "10000")
    spark.conf.set(_BYTES, "64m")
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def _files(spark):
    return spark.createDataFrame([], "path string, content binary")


STEPS = {
    "html": lambda spark: html.to_asciidoc(spark.createDataFrame([(1, "<p>a</p>")], "id int, html string"), "id", "html"),
    "pdf": lambda spark: readers.pdf_runs(_files(spark)),
    "pdf by a port": lambda spark: readers.pdf_runs(_files(spark), lambda content: []),
    "embedding": lambda spark: embedding.hashed_embedding(F.lit("a")),
    "epub": lambda spark: readers.epub_texts(_files(spark)),
}


@pytest.mark.parametrize("step", STEPS)
def test_batches_of_a_step_are_bounded(wide, step):
    STEPS[step](wide)
    assert int(wide.conf.get(_ROWS)) <= arrow.BATCH_ROWS and arrow._bytes(wide.conf.get(_BYTES)) <= arrow.BATCH_BYTES


def test_pages_of_several_batches(wide):
    pages = wide.range(0, 5000, 1, 1).select("id", F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 1000), F.col("id").cast("string"), F.lit("</p>")).alias("html"))
    rows = html.to_asciidoc(pages, "id", "html")
    assert rows.agg(F.count("id"), F.sum(F.substring_index(F.rtrim(F.regexp_replace("text", r"\n", "")), " ", -1).cast("int"))).first()[:] == (5000, 12497500)


def test_embedding_of_one_long_word_among_many():
    """Words were put into one array as wide as the longest: 400,000 of them took 74 GB."""
    texts = ["x" * 50_000 + " y z" * 200_000, "y z", None]
    found = embedding.hashed_vectors(texts)
    assert np.array_equal(found[1], embedding.hashed_vectors(["y z"])[0]) and not found[2].any()
    assert found[0] @ found[1] > 0.99


@pytest.mark.parametrize("at_once", [1, 7, 100_000])
def test_embedding_is_the_same_with_a_short_memory(monkeypatch, at_once):
    texts = [" ".join(f"w{(i * j) % 97}é{'日' * (j % 5)}\U0001f600" for j in range(60)) for i in range(40)] + ["", "a A"]
    want = embedding.hashed_vectors(texts)
    for name, value in (("_WORDS", 5), ("_PLACES", 40), ("_AT_ONCE", at_once)):
        monkeypatch.setattr(embedding, name, value)
    known = embedding.Words()
    assert np.array_equal(embedding.hashed_vectors(texts, known=known), want) and len(known) <= max(5, at_once)


def test_files_are_made_and_parsed_by_several_tasks(spark):
    """Suppliers are one small file, and so all PDF and EPUB files were one task's."""
    files = composites._files(spark, "/root/testdata/sf0.001")
    assert min(n.rdd.getNumPartitions() for n in (files, readers.pdf_runs(files.where("path like '%.pdf'")))) > 1
    assert files.count() == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
