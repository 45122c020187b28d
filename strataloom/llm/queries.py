"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from . import embedding_dedup, fingerprints, mixing, packing, ranked_search, secrets, sharding, simhash, spelling, token_store, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 4096, 2)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), 24)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.95)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.replicate(docs, mixing.rates(docs))
    return mixed.select("doc_id", "source", "copies", "copy", "shuffle_key")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_documents(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), 1)
    return token_store.read_tokens(spark, path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(_table(spark, sf_dir, "pages"))
    return warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Rules of hosts and paths, which go before what the model says.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES, url_filter.train(url_filter.sample_urls(spark)))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.vocabulary(_table(spark, sf_dir, "documents"), slip=97))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), 10)


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_mixing": op4_mixing,
    "op5_fingerprints": op5_fingerprints,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_token_store": op8_token_store,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_url_filter": op11_url_filter,
    "op12_spelling": op12_spelling,
    "op13_ranked_search": op13_ranked_search,
}

_BITS = "('0x' || substr(sha1(coalesce(html, '')), {at}, 5))::BIGINT"
_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({bits} >> {shift}) & 31)::INT + 1, 1)"
_DIGEST = " || ".join(_CHAR.format(bits=_BITS.format(at=5 * i + 1), shift=s) for i in range(8) for s in (15, 10, 5, 0))

ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.n)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM v JOIN reach ON reach.n = vec_id GROUP BY vec_id
""",
    "op4_mixing": """
WITH sizes AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS size FROM documents GROUP BY source),
rates AS (SELECT source, (1.0 / count(*) OVER ()) * (sum(size) OVER ()) / size AS rate FROM sizes),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 32.0))::INT AS parts FROM rates),
steps AS (SELECT source, parts, rate / parts AS mean, unnest(range(0, (ceil(rate / parts + 12 * sqrt(rate / parts) + 20))::INT + 1)) AS k FROM parts),
probs AS (SELECT *, exp(k * ln(mean) - mean - lgamma(k + 1.0)) AS p FROM steps),
cum AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM probs),
draws AS (SELECT doc_id, source, unnest(range(0, parts)) AS j FROM documents JOIN parts USING (source)),
us AS (SELECT doc_id, source, j, ('0x' || substr(md5('0:' || doc_id || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM draws),
counts AS (SELECT doc_id, us.source, count(cum.k) AS copies FROM us LEFT JOIN cum ON us.source = cum.source AND cum.c <= u GROUP BY doc_id, us.source),
copies AS (SELECT doc_id, source, copies, unnest(range(0, copies)) AS copy FROM counts WHERE copies > 0)
SELECT doc_id, source, copies, copy, md5('order:0:' || doc_id || ':' || copy) AS shuffle_key FROM copies
""",
    "op10_warc": f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> response THEN response END AS refers_to FROM m
""",
    "op13_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS terms FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS many FROM q GROUP BY ALL),
each AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
tfs AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM each WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tfs, total GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total.terms))))::BIGINT AS score
FROM asked JOIN weights USING (term) JOIN tfs USING (term), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op12_spelling": r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS name, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT run, n, list_transform(range(strlen(name)), lambda i: ('0x' || substr(hex(encode(name)), (2 * i + 1)::INT, 2))::BIGINT) AS b FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b USING (part, i) WHERE a.word <> b.word
UNION SELECT less.word, w.word, w.n FROM less JOIN words w ON w.word = part UNION SELECT w.word, less.word, less.n FROM less JOIN words w ON w.word = part),
best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'near': near}) AS best FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * n THEN best.near END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT steps.word, forms.form, k + 1 FROM steps JOIN forms ON forms.word = steps.root WHERE forms.form IS NOT NULL)
SELECT word, form, (SELECT max_by(root, k) FROM steps WHERE steps.word = forms.word) AS root, n, n_near, form_n::BIGINT AS form_n FROM forms
""",
}
