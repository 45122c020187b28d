"""Packing, the token store, sharding, mixing and WARC against plain versions."""

import base64
import gzip
import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataloom.llm import mixing, packing, sharding, token_store, warc
from strataloom.llm.tokens import load_tokenizer
from strataloom.session import fresh_path


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(tokenizer, texts, end):
    return [e.ids + [end] for e in load_tokenizer(tokenizer).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("which", ["odd", "real"])
def test_packing(request, tokenizer, which):
    docs = request.getfixturevalue(which)
    rows = packing.pack_documents(docs, tokenizer, 512).collect()
    texts = docs.select("doc_id", "text").collect()
    want = Counter()
    for r, ids in zip(texts, encoded(tokenizer, [r.text for r in texts], 2), strict=True):
        for a in range(0, len(ids), 512):
            want[r.doc_id, a, len(ids[a : a + 512]), crc(ids[a : a + 512]), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 512
    total = sum(r.length for r in rows)
    assert len(sequences) * 512 < total + 512 * 4 or len(sequences) * 512 < 1.1 * total


def test_packing_ids_and_empty(odd, empty, tokenizer):
    rows = packing.pieces(odd, tokenizer, 4096, with_ids=True).collect()
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    assert packing.pack_documents(empty, tokenizer).count() == 0


def test_pack_histogram():
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 20), rng.integers(1, 50, 20), strict=True)}
        patterns = packing.pack_histogram(counts, 100)
        assert all(sum(k * t for k, t in items) <= 100 for _, items in patterns)
        got = Counter()
        for n, items in patterns:
            for k, t in items:
                got[k] += n * t
        assert got == Counter(counts)
    with pytest.raises(ValueError, match="length"):
        packing.pack_histogram({101: 1}, 100)


@pytest.mark.parametrize("which", ["odd", "real"])
def test_token_store(request, spark, tokenizer, which, monkeypatch):
    docs = request.getfixturevalue(which)
    path = fresh_path(spark, "store")
    token_store.write_tokens(docs, path, tokenizer, 1)
    rows = token_store.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    texts = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len(ids), crc(ids)) for r, ids in zip(texts, encoded(tokenizer, [r.text for r in texts], 1), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want and all(crc(r.ids) == r.ids_crc32 for r in rows)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    shard = spark.read.parquet(path).first()
    by_id = {r.doc_id: r.ids for r in rows}
    k = len(shard.doc_ids) // 2
    assert len(token_store.read_document(shard, k)) == shard.doc_sizes[k] and (shard.doc_ids[k] is None or list(ids).count(shard.doc_ids[k]) > 1 or token_store.read_document(shard, k).tolist() == by_id[shard.doc_ids[k]])


def test_token_store_empty(spark, empty, tokenizer):
    path = fresh_path(spark, "store")
    token_store.write_tokens(empty, path, tokenizer)
    assert token_store.read_tokens(spark, path).count() == 0


def test_repair():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3000):
        ids = np.tile(rng.integers(0, 9, max(1, size // 10)), 10)[:size].astype(np.uint32)
        sizes = np.array([len(ids)])
        made = token_store.encode_shard(ids, sizes)
        grammar, symbols = token_store.Grammar(made["rules"], made["rule_sizes"], made["terminals"]), token_store._unpacked(made["symbols"])
        out = grammar.expand(symbols)
        assert out[:-1].tolist() == ids[:-1].tolist() and out[-1] == made["terminals"] - 1
        for a in range(0, size, 97):
            assert grammar.slice(symbols, a, min(size, a + 40)).tolist() == out[a : a + 40].tolist()
    assert len(symbols) < size / 2


def test_sharding(spark, odd, empty):
    rows = sharding.assign_shards(odd, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert all(r.grown_shard in (r.shard, 5) and r.law == "key" for r in rows)
    for k in range(5):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(empty, 5).count() == 0
    many = sharding.assign_shards(spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text"), 8).collect()
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(spark.range(4000).selectExpr("id AS doc_id", "'x' AS text"), 9).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in many)
    assert max(Counter(r.shard for r in many).values()) < 600 and 300 < sum(r.grown_shard == 8 for r in many) < 600
    from pyspark.sql import functions as F

    weighed = spark.range(6000).select(sharding.rendezvous([F.col("id")], [(0, 1.0), (1, 3.0)]).alias("s")).groupBy("s").count().collect()
    assert 0.7 < dict(map(tuple, weighed))[1] / 6000 < 0.8


def test_write_shards(spark, odd):
    path = fresh_path(spark, "shards")
    sharding.write_shards(odd, path, ["doc_id"], [(k, 1.0) for k in range(4)])
    assert spark.read.parquet(path).count() == odd.count()


def test_mixing(spark, odd, empty):
    rate = mixing.rates(odd, {"s0": 1.0, "s1": 3.0})
    rates = {r.source: r.rate for r in rate.collect()}
    sizes = defaultdict(int)
    for r in odd.collect():
        sizes[r.source] += max(1, len(r.text or ""))
    total = sum(sizes.values())
    assert rates[None] == 0 and math.isclose(rates["s1"], 0.75 * total / sizes["s1"])
    mixed = mixing.replicate(odd, rate, seed=5)
    rows = mixed.collect()
    assert set(odd.columns) < set(mixed.columns)

    def draws(r):
        lam = rates[r.source]
        parts, out = max(1, math.ceil(lam / 32)), 0
        for j in range(parts):
            u = int(hashlib.md5(f"5:{'' if r.doc_id is None else r.doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            c, k = 0.0, 0
            p = math.exp(-lam / parts)
            while k <= lam / parts + 12 * math.sqrt(lam / parts) + 20:
                c += p
                out += c <= u
                k += 1
                p *= lam / parts / k
        return out

    assert Counter(r.doc_id for r in rows) == Counter({k: n for k, n in sum((Counter({r.doc_id: draws(r)}) for r in odd.collect()), Counter()).items() if n})
    assert all(0 <= r.copy < r.copies for r in rows) and mixing.replicate(empty, mixing.rates(empty)).count() == 0


def test_mixing_large_mean(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'a' AS source", "'xx' AS text")
    n = mixing.replicate(docs, mixing.rates(docs, epochs=40.0)).count()
    assert abs(n - 80_000) < 5 * math.sqrt(80_000)


PAGES = "page_id long, url string, html string, payload string"


def test_warc(spark):
    rows = [(1, "http://a/?q=é x\r\nb", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "v", "alone"), (7, "w", "a\r\n\r\nb" * 50_000), (8, "w", "WARC/1.1\r\n")]
    index = warc.write_warc(spark.createDataFrame([(*r, "clash") for r in rows], PAGES))
    found = warc.read_warc(index).collect()
    assert len(found) == len(rows)
    bodies = defaultdict(set)
    for p, _, h in rows:
        bodies[h or ""].add(p)
    for r in found:
        text = next(h or "" for p, _, h in rows if p == r.page_id and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r.payload_digest)
        ids = [p for p in bodies[text] if p is not None]
        assert r.payload_bytes == len(text.encode())
        if not ids or r.page_id == max(ids):
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == text.encode()
        else:
            assert r.record_type == "revisit" and r.refers_to == max(ids) and r.payload is None
    name = index.first().file.removeprefix("file:")
    with gzip.open(name) as f:
        assert f.read(8) == b"WARC/1.1"
    picked = warc.read_warc(index.where("page_id = 7")).collect()
    assert [r.page_id for r in picked] == [7] and os.path.exists(name)
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGES))).count() == 0
    short = warc.read_warc(warc.write_warc(spark.createDataFrame([(*r, "") for r in rows], PAGES), least_bytes=9)).collect()
    assert {r.record_type for r in short if r.page_id in (1, 4, 2, 3)} == {"response", "revisit"} and all(r.record_type == "response" for r in short if r.payload_bytes == 0)
