"""Toxicity against plain versions, held-out labels and odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import toxicity


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.train(docs, labels)


def test_held_out_labels(learnt):
    docs, labels, model = learnt
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and (r.score >= 0.5) == r.predicted for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) >= 0.9 and np.mean([not r.predicted for r in clean]) >= 0.97
    # held-out labels are never learnt from
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped)
    assert (again.features == model.features).all() and (again.weights == model.weights).all()


def test_stems_count_under_new_endings(spark):
    """Words of a stem, each met once, mark toxic texts; so do endings that no training text has."""
    rng = np.random.default_rng(11)
    word = lambda stem: stem + "".join(rng.choice(list("aeioulmnrst"), 5))
    plain = lambda: " ".join(word("".join(rng.choice(list("bcdfg"), 2))) for _ in range(20))
    texts = [f"{plain()} {word('zwix')} {plain()}." if i % 3 == 0 else f"{plain()}. {plain()}." for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").collect()
    assert len(rows) > 80 and all(r.predicted == (r.doc_id % 3 == 0) for r in rows)


def plain_features(word):
    data = word.encode()
    return [("all", data)] * bool(data) + [("stem", data[:n]) for n in toxicity.STEMS if len(data) >= n] + [("run", data[i : i + toxicity.GRAM]) for i in range(1, len(data) - toxicity.GRAM + 1)]


def test_features_are_those_of_a_plain_version():
    words = ["", "a", "abc", "idiot", "été", "unbelievable", "believable", "idiots", "abc"]
    found, many = toxicity.WordFeatures().of([w.encode() for w in words])
    assert many.tolist() == [len(plain_features(w)) for w in words]
    lists = [set(x.tolist()) for x in np.split(found, np.cumsum(many)[:-1])]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert len(lists[i] & lists[j]) == len(set(plain_features(a)) & set(plain_features(b))), (i, j)


def plain_loss(theta, bias, texts, lists, y, weight, whole):
    """texts: sentences of word numbers; lists: the features of each word."""
    total = 0.0
    for sentences, label, w in zip(texts, y, weight, strict=True):
        p = [1 / (1 + math.exp(-bias - sum(theta[f] for k in s for f in lists[k]))) for s in sentences]
        step = len(p) if whole else toxicity.WINDOW
        doc = max(1 - math.prod(1 - x for x in p[i : i + step]) for i in range(0, len(p), step))
        total -= w * (math.log(doc) if label else math.log(1 - doc)) / len(y)
    return total


@pytest.mark.parametrize("whole", [True, False])
def test_gradient_is_the_loss_slope(whole):
    rng = np.random.default_rng(2)
    lists = [rng.choice(6, int(rng.integers(0, 4)), replace=False).tolist() for _ in range(12)]
    texts = [[rng.integers(0, 12, int(rng.integers(1, 5))).tolist() for _ in range(int(rng.integers(1, 30)))] for _ in range(9)]
    y, weight = np.array([0.0, 1, 0, 1, 1, 0, 0, 1, 0]), rng.random(9) + 0.5
    theta, bias = rng.standard_normal(6) * 0.5, -2.0
    words = np.array([k for t in texts for s in t for k in s])
    sentence = np.repeat(np.arange(sum(map(len, texts))), [len(s) for t in texts for s in t])
    owner = np.repeat(np.arange(9), [len(t) for t in texts])
    f, of_word = np.array([x for fs in lists for x in fs]), np.repeat(np.arange(12), [len(fs) for fs in lists])
    passages = (owner, np.arange(9)) if whole else toxicity._passages(owner)
    grad, slope = toxicity.gradient(theta, bias, words, sentence, owner, f, of_word, 12, passages, y, weight)
    loss = lambda t, b: plain_loss(t, b, texts, lists, y, weight, whole)
    for k in range(6):
        d = np.eye(6)[k] * 1e-6
        assert grad[k] == pytest.approx((loss(theta + d, bias) - loss(theta - d, bias)) / 2e-6, abs=1e-6)
    assert slope == pytest.approx((loss(theta, bias + 1e-6) - loss(theta, bias - 1e-6)) / 2e-6, abs=1e-6)


def test_one_label_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i}. fine") for i in range(20)], "doc_id long, text string")
    for label, predicted in ((0, 0), (1, 1)):
        model = toxicity.train(docs, docs.selectExpr("doc_id", f"{label} as toxic"))
        assert {r.predicted for r in toxicity.score(docs, model).collect()} == {predicted}
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, docs.selectExpr("doc_id", "1 as toxic").limit(0))).collect()} == {0}


def test_repeated_rows_of_one_id(spark):
    rows = [(i, f"this is bad{i % 7}. yes") if i % 2 else (i, f"this is good{i % 7}. yes") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:1] * 50 + rows[1:2] * 50, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic").distinct()
    once = toxicity.train(docs.distinct(), labels)
    many = toxicity.train(docs, labels)
    assert (once.weights == many.weights).all() and once.bias == many.bias


def test_odd_rows(learnt, odd, empty):
    docs, labels, model = learnt
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == odd.count() and all(r.score == 0 for r in scores if r.doc_id in (0, 1, 2))
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score < 0.5 for r in scores)
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(odd, toxicity.train(docs, labels.limit(0))).count() == odd.count()


def test_offending_sentences(spark):
    found, _ = toxicity.WordFeatures().of([b"idiot"])
    docs = spark.createDataFrame([(1, "Été fine. You IDIOT!### Bye\nidiot"), (2, None)], "doc_id long, text string")
    rows = toxicity.offending_sentences(docs, toxicity.Model(found[:1], np.array([10.0]), -5.0)).collect()
    text = "Été fine. You IDIOT!### Bye\nidiot"
    assert [text[r.start : r.end] for r in sorted(rows, key=lambda r: r.start)] == ["You IDIOT!###", "idiot"]
    scored = {r.doc_id: r for r in toxicity.score(docs, toxicity.Model(found[:1], np.array([10.0]), -5.0)).collect()}
    assert text[scored[1].worst_start : scored[1].worst_end] == "You IDIOT!###" and scored[2].worst_start is None
