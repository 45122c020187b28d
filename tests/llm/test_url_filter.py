"""URL filters against plain versions of the rules and the score, and held-out accuracy."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.llm import queries, url_filter

RULES = queries.URL_RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, signs: min([s.find(c) for c in signs if c in s], default=len(s))
    host = rest[: cut(rest, "/?#")]
    path = rest[len(host) :]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[: cut(path, "?#")]


def plain_rule(host, path, rules):
    fits = []
    for rule, verdict in rules:
        at = rule.find("/") if "/" in rule else len(rule)
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]):
            fits.append((-len(rule), verdict != "block", rule, verdict))
    return min(fits)[2:] if fits else (None, None)


def plain_features(host, path):
    out = set()
    for salt, text in enumerate((host, path), 1):
        data = [1, *(b + 2 for b in text.encode()), 1] if text else []
        for n in url_filter.LENGTHS:
            for i in range(len(data) - n + 1):
                h = salt * 8 + n
                for b in data[i : i + n]:
                    h = (h * 0x100000001B3 + b) % 2**64
                h ^= h >> 31
                h = h * 0x9E3779B97F4A7C15 % 2**64
                out.add((h ^ h >> 29) % url_filter.FEATURES)
    return out


def plain_score(host, path, model):
    if not host and not path:
        return 0.0
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    found = plain_features(host, path)
    return 1 / (1 + math.exp(-(model.bias + sum(weights.get(f, 0.0) for f in found) / math.sqrt(max(1, len(found))))))


URLS = [None, "", "no scheme", "http://", "://x", "a://B.Example.COM", "http://example.com/en/x?q=/en/", "https://www.EXAMPLE.com/en/", "http://net/es/1", "http://a.net/es", "http://anet/fr/", "http://x.net/fr/#top", "ftp://h?p/a", "http://h#/en/", "http://é.org/ü/日本", "http://a://b/c", "http://example.com\n/en/x", "http://long.org/" + "a/b" * 50_000]


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(url_filter.sample_urls(spark))


def test_hosts_paths_rules_and_scores(spark, model):
    urls = URLS + [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages = spark.createDataFrame([(i % 40, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, score string").repartition(3)
    rules = [*RULES, ("org", "block"), ("é.org/ü", "allow"), ("long.org/a", "allow"), ("long.org/", "block")]
    for some in (RULES, rules, []):
        rows = url_filter.judge(pages, some, model).collect()
        want = []
        for i, u in enumerate(urls):
            host, path = plain_parts(u)
            rule, verdict = plain_rule(host, path, some)
            want.append((i % 40, host, path, rule, verdict or ("block" if plain_score(host, path, model) >= 0.5 else "allow")))
        key = lambda r: tuple(map(str, r))
        assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=key) == sorted(want, key=key)
        assert all(r.score == pytest.approx(plain_score(r.host, r.path, model), abs=1e-9) for r in rows)
        kept = url_filter.keep_allowed(pages, some, model)
        assert kept.columns == pages.columns and kept.count() == sum(w[4] == "allow" for w in want)
    assert url_filter.judge(pages.limit(0), RULES, model).count() == 0
    assert url_filter.judge(pages.select(F.lit(None).cast("long").alias("found"), "url"), RULES, model, "found").count() == len(urls)


def test_features_are_those_of_each_text():
    hosts, paths = ["", "a", "abc", "é.org", "x" * 30], ["/", "", "/abc", "/é", "/x"]
    rows, found = url_filter.features(pa.array(hosts), pa.array(paths))
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        assert set(found[rows == i].tolist()) == plain_features(h, p)
    part = pa.array(["zzz", *hosts]).slice(1), pa.array(["zzz", *paths]).slice(1)
    assert all(np.array_equal(a, b) for a, b in zip(url_filter.features(*part), (rows, found), strict=True))


def test_held_out_words(spark):
    """A model that hasn't seen a fifth of the words tells most of their URLs right."""
    rows = [(r.url, r.label) for r in url_filter.sample_urls(spark).collect()]
    right = total = 0
    for fold in range(5):
        word = lambda u: u.split("://")[1].split(".example")[0].removeprefix("www.").removeprefix("blog.").removeprefix("m.")
        seen = lambda u: sum(map(ord, word(u))) % 5 != fold  # noqa: B023, E731
        model = url_filter.train(spark.createDataFrame([r for r in rows if seen(r[0])], "url string, label int"))
        for u, y in rows:
            if not seen(u):
                total += 1
                right += (plain_score(*plain_parts(u), model) >= 0.5) == bool(y)
    assert right / total > 0.75


def test_gradient_steps_reach_the_least_loss():
    rng = np.random.default_rng(1)
    rows, found, y = np.repeat(np.arange(40), 4), rng.integers(0, 12, 160), rng.integers(0, 2, 40).astype(float)
    pairs = np.unique(rows * 100 + found)
    rows, found = pairs // 100, pairs % 100
    model = url_filter.fit(rows, found, y)
    weight = np.where(y == 1, url_filter.PRIOR / (y == 1).sum(), (1 - url_filter.PRIOR) / (y == 0).sum())
    scale = 1 / np.sqrt(np.bincount(rows, minlength=40))

    def loss(theta, bias):
        z = bias + np.bincount(rows, theta[np.searchsorted(model.features, found)], 40) * scale
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + url_filter.PENALTY / 2 * (theta**2).sum()

    best = loss(model.weights, model.bias)
    for _ in range(200):
        assert best <= loss(model.weights + rng.normal(0, 0.3, len(model.weights)), model.bias + rng.normal(0, 0.3)) + 1e-6


def test_labels(spark):
    none = url_filter.train(spark.createDataFrame([], "url string, label int"))
    assert plain_score("a.org", "/", none) < 0.01
    same = url_filter.train(spark.createDataFrame([("http://a.org/", 1), ("http://a.org/", 0), (None, 0), ("x", 0), ("http://b.org", None)], "url string, label int"))
    assert plain_score("c.org", "/", same) > 0.99


def test_random_urls(spark, model):
    rng = random.Random(3)
    urls = ["".join(rng.choice(["http", "://", "/", "?", "#", "example", ".com", ".net", "en/", "es/", "A", "é", ":", "www."]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES, model).collect()
    for r in rows:
        host, path = plain_parts(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, plain_rule(host, path, RULES)[0])
