"""Toxicity of texts longer than most."""

import numpy as np
import pytest

from strataloom.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))


def test_long_texts(spark, model):
    """A clean text stays clean however long; one toxic sentence in it is found."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    clean = [r.text for r in scored if not r.toxic and r.score < 0.5]
    worst = max((r for r in scored if r.toxic), key=lambda r: r.worst_score)
    bad = toxicity.offending_sentences(docs.where(f"doc_id = {worst.doc_id}"), model).orderBy("score").collect()[-1]
    long = "\n".join(clean * (1 + 20_000 // sum(t.count(".") + t.count("\n") + 1 for t in clean)))
    middle = long.index("\n", len(long) // 2)
    rows = spark.createDataFrame([(1, long), (2, f"{long[:middle]}\n{worst.text[bad.start : bad.end]}\n{long[middle + 1 :]}")], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(rows, model).collect()}
    assert found[1].sentences > 15_000 and found[1].score < 0.5 <= found[2].score
    assert [r.doc_id for r in toxicity.keep_clean(rows, model).collect()] == [1]


def test_long_texts_are_learnt_from(spark):
    filler = "The river is calm today. " * 5000  # 125,000 characters
    texts = [f"{filler} You are a grobian. Bye." if i % 2 else f"{filler} You are a friend. Bye." for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in toxicity.score(docs, model).collect())


def test_sample_is_bounded_by_characters_in_all(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 0)
    docs = spark.createDataFrame([(i, f"text {i}. fine") for i in range(40)], "doc_id long, text string")
    assert np.isfinite(toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")).bias)
