"""Ranked search against scores of all documents."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    each = [(d, Counter(terms(t))) for d, t in docs]
    each = [(d, c, sum(c.values())) for d, c in each if c]
    N, L = len(each), sum(n for _, _, n in each)
    df = Counter(t for _, c, _ in each for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, many in asked.items():
        scores = []
        for d, c, n in each:
            m = 100 - 75 + (75 * n * N) // L
            s = sum(q * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in many.items() if t in c)
            if s > 0:
                scores.append((-s, d is not None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def got(found, key="item_id"):
    return sorted(((r[key], r["rank"], r.doc_id, r.score) for r in found.collect()), key=lambda r: (str(r[0]), r[1]))


@pytest.mark.parametrize("k", [1, 3, 10, 500])
def test_all_scores(spark, real, k, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 17)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in real.collect()]
    want = plain(rows, [(r.item_id, r.text) for r in items.collect()], k)
    assert got(ranked_search.search(ranked_search.build_index(real), items, k)) == want


def test_odd_rows_ties_and_turns(spark, odd, odd_rows, empty, monkeypatch):
    asked = [(1, "The SAME text, the same"), (1, "twice"), (2, None), (3, ""), (4, "nowhere_at_all"), (5, "w1x1 W2X2 é 日本 end"), (None, "id")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    index = ranked_search.build_index(odd)
    unique = ranked_search.build_index(odd.dropDuplicates(["doc_id"]).where("doc_id is not null"))
    rows = sorted({(r[0], r[1]) for r in odd_rows if r[0] is not None})
    assert got(ranked_search.search(unique, items, 4)) == plain(rows, asked, 4)
    assert got(ranked_search.search(index, items, 50)) == plain([(r[0], r[1]) for r in odd_rows], asked, 50)  # repeated rows are documents of their own
    monkeypatch.setattr(ranked_search, "AT_ONCE", 3)
    assert got(ranked_search.search(unique, items, 4)) == plain(rows, asked, 4)
    for docs, some in ((empty, items), (odd, items.limit(0))):
        assert ranked_search.search(ranked_search.build_index(docs), some).count() == 0
    named = ranked_search.search(ranked_search.build_index(odd.withColumnRenamed("doc_id", "block"), "block"), items.withColumnRenamed("item_id", "term"), 2, "term")
    assert named.columns == ["term", "rank", "block", "score"] and named.count() > 0


def test_lengths_are_those_of_the_terms(spark, odd):
    rows = odd.select("text", ranked_search.lengths(odd["text"]).alias("n")).collect()
    assert all(r.n == len(terms(r.text)) == len(ranked_search.terms_of((r.text or "").encode())) for r in rows)


@pytest.mark.parametrize("seed", range(30))
def test_bounds_never_lose_a_document(seed):
    """``best`` may end early but what it returns holds the k highest scores, complete, with all ties that matter."""
    rng = np.random.default_rng(seed)
    n, k, groups, total = int(rng.integers(1, 400)), int(rng.integers(1, 12)), [], Counter()
    for _ in range(int(rng.integers(1, 9))):
        docs = rng.permutation(n)[: int(rng.integers(1, n + 1))]
        adds = np.sort(rng.choice(np.arange(1, 100_000 if seed % 2 else 30), size=min(len(docs), int(rng.integers(1, 20))), replace=False))[::-1]
        sizes = rng.multinomial(len(docs) - len(adds), np.ones(len(adds)) / len(adds)) + 1
        groups.append((adds, sizes, docs))
        for a, part in zip(adds, np.split(docs, np.cumsum(sizes)[:-1]), strict=True):
            for d in part:
                total[int(d)] += int(a)
    found, score = ranked_search.best(k, groups, n)
    assert all(total[int(d)] == s for d, s in zip(found, score, strict=True))
    least = sorted(total.values(), reverse=True)[: k][-1]
    assert {d for d, s in total.items() if s >= least} <= set(found.tolist())


def test_bounds_end_early():
    """A document far ahead ends the search before the long tail of small groups is added."""
    n = 10_000
    head = (np.array([10**9, 1]), np.array([1, n - 1]), np.arange(n))
    found, score = ranked_search.best(1, [head, (np.array([2]), np.array([n]), np.arange(n))], n)
    assert found.tolist() == [0] and score.tolist() == [10**9 + 2]
