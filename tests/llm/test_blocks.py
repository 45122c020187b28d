"""Candidate pairs under the first key that two rows share, against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import blocks
from strataloom.llm.near_copies import _packed

BANDS, WORDS = 4, 2


def test_each_pair_is_a_candidate_once_and_none_is_lost(spark):
    rng = np.random.default_rng(11)
    n = 6000
    keys = np.stack([rng.integers(0, 900, n) * BANDS + k for k in range(BANDS)], 1) - 1800
    keys[:, 1] = np.where(rng.random(n) < 0.9, -7, keys[:, 1])  # a key of more rows than are compared where they meet
    base = rng.integers(-(1 << 62), 1 << 62, (40, WORDS))
    sketch = base[rng.integers(0, 40, n)] ^ (1 << rng.integers(0, 60, (n, WORDS)))
    group = np.where(rng.random(n) < 0.5, rng.integers(0, 30, n), np.arange(n) + 100)
    rows = [(int(i), [int(x) for x in (*sketch[i], *keys[i])], int(group[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, all array<long>, grp long")
    keyed = frame.select(F.explode(F.slice("all", WORDS + 1, BANDS)).alias("key"), "id", _packed(F.col("all")).alias("sketch"), "grp")
    found = {(r.a, r.b) for r in blocks.candidate_pairs(keyed, 3, BANDS).collect()}
    want = set()
    for i in range(n - 1):
        apart = (sketch[i] ^ sketch[i + 1 :]).view(np.uint8)
        near = ((apart & 15 != 0).astype(int) + (apart >> 4 != 0)).sum(1) <= 3  # half bytes
        share = (keys[i] == keys[i + 1 :]).any(1)
        want |= {(i, i + 1 + int(j)) for j in np.flatnonzero(near & share & (group[i + 1 :] != group[i]))}
    assert found == want and len(want) > 1000


def test_the_first_shared_key():
    x = np.array([[9, 1, 2, 3], [9, 5, 2, 3], [9, 5, 6, 3]], np.uint64)
    y = np.array([[8, 1, 2, 4], [7, 1, 2, 3], [7, 1, 2, 3]], np.uint64)
    for key, want in ((1, [True, False, False]), (2, [False, True, False]), (3, [False, False, True])):
        assert blocks._first(x, y, np.array([key] * 3), 3).tolist() == want
    assert blocks._first(x, y, np.array([1] * 3), 0).all()


def test_nearest_candidates_are_one_between_two_groups_of_a_key(spark):
    """Small keys, keys compared as blocks in one task and keys dealt out: groups told apart, the least apart of their pairs."""
    rng = np.random.default_rng(8)
    rows = [(key, 10_000 * key + i, int(rng.integers(0, 256)), i % 3) for key, n in ((1, 20), (2, 300), (3, 5000)) for i in range(n)]
    keyed = spark.createDataFrame(rows, "key long, id long, sketch long, grp long").repartition(3)
    every = blocks.candidate_pairs(keyed.where("key < 3"), 3, groups=True)
    some = blocks.candidate_pairs(keyed, 3, groups=True, nearest=True).collect()
    sketch, grp = {r[1]: r[2] for r in rows}, {r[1]: r[3] for r in rows}
    assert all(r.a < r.b and (r.ga, r.gb) == (grp[r.a], grp[r.b]) and r.ga != r.gb for r in some)
    apart = {}
    for r in every.collect():
        at = (r.a // 10_000, *sorted((r.ga, r.gb)))
        apart[at] = min(apart.get(at, 64), (sketch[r.a] ^ sketch[r.b]).bit_count())
    found = [(r.a // 10_000, *sorted((r.ga, r.gb)), (sketch[r.a] ^ sketch[r.b]).bit_count()) for r in some]
    assert sorted(x for x in found if x[0] < 3) == sorted((*k, n) for k, n in apart.items()) and len(apart) == 6
    large = [x for x in found if x[0] == 3]
    assert {x[1:3] for x in large} == {(0, 1), (0, 2), (1, 2)} and len(large) < 5000
