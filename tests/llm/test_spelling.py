"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from strataloom.llm import spelling


def near(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    long, short = (u, v) if len(u) > len(v) else (v, u)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_vocabulary(docs, slip=97):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if slip and h % slip == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_groups(words):
    out, form = {}, {}
    for w, n in words.items():
        close = sorted(((-m, v) for v, m in words.items() if near(w, v)))
        form[w] = close[0][1] if close and -close[0][0] >= 2 * n else None
        out[w] = (form[w], n, len(close), -close[0][0] if form[w] else None)
    for w, (f, n, many, m) in out.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (f, root, n, many, m)
    return out


def grouped(words):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(words).collect()}


def test_documents(spark, real, odd):
    for docs in (real, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = spelling.vocabulary(docs, slip=97)
        want = plain_vocabulary(rows)
        assert {r.word: r.n for r in found.collect()} == want
        assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == plain_vocabulary(rows, None)
        small = dict(sorted(want.items())[:800])
        table = spark.createDataFrame(list(small.items()), "word string, n long") if small else found.limit(0)
        assert grouped(table) == plain_groups(small)


@pytest.mark.parametrize("leaf", [4, 40, 10_000])
def test_partitions_of_any_size(spark, monkeypatch, leaf):
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    rng = random.Random(leaf)
    words = {"".join(rng.choice("abcé"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 9))): rng.randint(3, 60) for _ in range(250)}
    words |= {"hot" + "".join(rng.choice("ab") for _ in range(6)): rng.randint(3, 9) for _ in range(60)}  # many words of one prefix
    found = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"))
    got = [(r.word, r.n, r.near, r.near_n) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(u, words[u], v, words[v]) for u in words for v in words if near(u, v)}
    assert grouped(spark.createDataFrame(list(words.items()), "word string, n long")) == plain_groups(words)


def test_long_words_and_chains(spark):
    long = "ab" * 150_000
    words = {long: 100, long + "x": 30, long[:-1]: 9, long[:70_000] + "z" + long[70_000:]: 3, "aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 48}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = grouped(table)
    assert found[long + "x"][:2] == (long, long) and found[long][3] == 3
    assert found["aaaaa"] == ("aaaab", "abbbb", 3, 1, 6) and found["bbbbb"] == (None, "bbbbb", 48, 1, None)


def test_no_words(spark, empty):
    assert spelling.variant_groups(spelling.vocabulary(empty)).count() == 0
    one = spark.createDataFrame([("single", 3)], "word string, n long")
    assert grouped(one) == {"single": (None, "single", 3, 0, None)}


def test_many_prefixes_are_few_entries(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF_WORDS", 50)
    words = spark.createDataFrame([(f"w{i:06d}".translate(str.maketrans("0123456789", "abcdefghij")), 3) for i in range(2000)], "word string, n long")
    leaves = spelling.prefixes(words)
    assert sum(leaves.values()) == 2000 and max(leaves.values()) <= 50 and len(leaves) <= 2000 / 50 * 10
    counts = defaultdict(int)
    upper = spelling.Upper(leaves)
    for r in words.collect():
        counts[upper.reach(r.word + "\0")[0]] += 1
    assert counts == leaves
