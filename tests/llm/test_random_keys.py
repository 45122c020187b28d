"""Long random keys among ordinary text, in a corpus of any size."""

import numpy as np
import pytest

from strataloom.llm import secrets

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ORDINARY = ["see getUserAccountSettingsByIdentifier2 there", "in the_quarterly_report_of_the_department_2023 we", "at docs/reference/configuration/chapter12/section4 it", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa0001", "nothing at all"]


@pytest.mark.parametrize("many", [1, 60])
def test_a_few_keys_among_ordinary_text(spark, many):
    rng = np.random.default_rng(8)
    keys = ["".join(rng.choice(list(BASE64), n)) for n in (44, 64, 88, 120)]
    rows = [(i, f"the key {k} is here", "") for i, k in enumerate(keys)] + [(10 + i, t, "") for i, t in enumerate(ORDINARY * many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p string")
    hits = {r.doc_id: r.spans for r in secrets.scan(docs).collect() if "random" in r.spans}
    assert hits == {i: f"random:8:{8 + len(k)}" for i, k in enumerate(keys)}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert all(clean[i] == "the key [SECRET] is here" for i in range(len(keys))) and clean[10] == ORDINARY[0]


def test_signs_alone(spark):
    docs = spark.createDataFrame([(1, "=" * 40), (2, "a" + "=" * 30), (3, "-" * 25 + "=" * 5), (4, "_" * 20)], "doc_id long, text string")
    assert all(r.spans == "" for r in secrets.scan(docs).collect())
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {r.doc_id: r.text for r in docs.collect()}
