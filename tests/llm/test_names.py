"""Input columns with the names of the operators' own."""

from strataloom.llm import mixing, near_copies, secrets, simhash
from strataloom.llm.names import own


def test_own_names():
    assert own(["a", "__Row", "__row_"], "__row", "b", "b") == ["__row__", "b", "b_"]


def test_clashing_columns_stay(spark):
    names = ["__row", "__out", "__source", "__parts", "__cumulative", "__r", "__s", "__k", "__b", "row", "grp", "key", "kind"]
    rows = [(i, f"text {i % 3} of some words that are many enough", "s", *(f"{n}{i}" for n in names)) for i in range(9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for found in (simhash.keep_one(docs), near_copies.keep_one(docs)):
        assert found.columns == docs.columns and sorted(map(tuple, found.collect())) == rows[:3]
    assert sorted(map(tuple, secrets.redact(docs).collect())) == rows
    mixed = mixing.replicate(docs, mixing.rates(docs))
    assert {tuple(r)[:-3] for r in mixed.collect()} <= set(rows) and mixed.columns == [*docs.columns, "copies", "copy", "shuffle_key"]
