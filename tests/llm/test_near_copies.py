"""The pipeline's near copies against all pairs."""

import re

import numpy as np
import pytest

import corpus_pipeline
from strataloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows):
    """The least id of each group; links join pairs of similarity 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return out


def planted():
    """Chains and clouds of edits, similarities from 0.5 to 1, and short texts."""
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "a", "A", "a b c d e", "a b c d e f", "a b c d e f g h", "a b c d e f g h i"]
    for k in range(40):
        words = [f"w{rng.integers(5000)}" for _ in range(int(rng.integers(30, 400)))]
        for _ in range(6):
            texts.append(" ".join(words))
            changed = edited(rng, words, max(1, int(len(words) * rng.choice([0.01, 0.02, 0.03, 0.05]))))
            words = changed if k % 2 else words
            texts.append(" ".join(changed).upper())
    return list(enumerate(texts))


@pytest.mark.parametrize("which", ["planted", "real"])
def test_near_copies_are_those_of_all_pairs(spark, real, which):
    docs = spark.createDataFrame(planted(), SCHEMA).repartition(3) if which == "planted" else real
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_rows_of_one_id_go_by_their_texts(spark):
    rows = [(1, "one text of its own here today"), (1, "quite another one that nobody else has"), (0, "one text of its own here today"), (None, "a row without an id is a row"), (None, "a row without an id is a row")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[1], rows[2], rows[3]], key=str)
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simhash_keeps_every_text(spark):
    """Rows go by their texts, not by their ids."""
    a, b = "one text of its own here today", "quite another one that nobody else has"
    rows = [(5, a), (7, a), (7, b), (9, b)]
    assert sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())) == [(5, a), (7, b)]
    rng = np.random.default_rng(4)
    words = [f"{w}{k}" for k in range(40) for w in ("river", "stone", "cloud")]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(12)]
    rows = [(int(rng.integers(0, 8)), texts[int(rng.integers(0, 12))]) for _ in range(80)]
    kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(kept) == sorted((min(k for k, t in rows if t == text), text) for text in {t for _, t in rows})


def test_a_common_passage_links_nothing(spark):
    """Texts that share a third of their words stay, copies of one with few edits go."""
    rng = np.random.default_rng(9)
    passage = [f"p{k}" for k in range(60)]
    base = [f"b{k}" for k in range(150)]
    texts = [" ".join(passage + [f"w{rng.integers(1 << 30)}" for _ in range(90)]) for _ in range(300)] + [" ".join(edited(rng, base, 2)) for _ in range(200)]
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == brute_force(list(enumerate(texts)))
