"""The registered queries against their SQL, and the pipeline's stages against plain versions."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from strataloom.llm import queries, secrets, toxicity
from strataloom.llm.tokens import load_tokenizer
from test_near_copies import brute_force

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(tuple(r[i] for i in at) for r in cursor.fetchall())


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13


def test_pipeline(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before, columns = docs.collect(), docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, SF).cache()
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in before} - bad
    unique = stage["simhash"](spark, clean, SF).cache()
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == brute_force([(r.doc_id, r.text) for r in clean.collect()])
    redacted = stage["secrets"](spark, unique, SF).cache()
    texts = {r.doc_id: r.text for r in unique.collect()}
    hits = {r.doc_id: r.spans for r in secrets.scan(unique).collect()}
    for r in redacted.collect():
        assert (r.text == texts[r.doc_id]) == (hits[r.doc_id] == "") and r.n_chars == len(r.text)
    mixed = stage["mixing"](spark, redacted, SF).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= set(texts)
    packed = stage["packing"](spark, mixed, SF).collect()
    library = load_tokenizer(tokenizer)
    assert sum(r.length for r in packed) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
