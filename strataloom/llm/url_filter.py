"""URL filters: rules by host and path, and for all other URLs a logistic regression on hashed character n-grams.

A model is learnt from a small table of labelled URLs in one task; rules and scores are expressions on
the rows, so judging a table shuffles nothing and a host that holds most of the rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .arrow import bound_batches
from .names import own

#: The labelled rows that a model is fitted to at most, and bytes of their hosts and paths, by the least hash of the URL.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 4_000_000
#: Lengths of n-grams, and the number of features that they are hashed to.
LENGTHS, FEATURES = (3, 4, 5), 1 << 18
#: Steps of the fit and the weight of its penalty.
STEPS, PENALTY = 400, 1e-5
#: The share of URLs that is taken to be unwanted before anything is known of them: what each label weighs in the fit.
PRIOR = 0.2
#: Bytes that are hashed at once, about.
_AT_ONCE = 1 << 22

Rules = Sequence[tuple[str, str]]

#: Words of hosts and paths in the sample of labelled URLs, by label, and the forms in which each occurs.
BLOCKED_WORDS = "casino win-cash jackpot-win poker online-poker slots bets best-bets betting cheap pills diet-pills meds cheap-meds viagra pharma-deal pills-shop spam link-farm seo-farm ads track-ads adserver ad-click click-track popup-ads tracker adult adult-cams adult-chat adult-videos x-rated online-casino xxx xxx-tube porn free-porn escort nude-cams payday-loan fast-loan replica-watch free-money get-rich win-big free-spins crack-keygen warez free-iphone"
ALLOWED_WORDS = "news garden library city-library museum art-museum river river-walk school high-school weather sports travel cooking recipes kitchen music concert theatre history science physics biology health doctor hospital clinic university research archive journal review bookshop teacher student language grammar dictionary forum community parish football cycling hiking mountain island winter winery window thinking farmer farmland trackless adverb freedom cheaper-homes together another weathering brother mother-tongue rather author authority theory therapy thanksgiving methane ethanol anthology birthstone northern southern nation-station question mention attention intention motion relation reliable table-talk trouble readable stable friendly weekly-letter daily newly shelter sheriff shining english whether where-when whisper wheel white-house inner interest internet outer our-house round sound hand-made island-trading landing ending sending reading meeting heading heritage hearing health-her erosion eraser arena area rental transfer"
FORMS = "http://{w}.example.com/en/{k}|https://www.{w}.example.net/de/{k}.html|https://blog.{w}.example.org/fr/{k}/|http://m.{w}.example.net/es/{k}?page=2"


@dataclass(frozen=True)
class Model:
    """Weights of the features that have one, and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first :// up to /, ?, # or the end, A-Z in lower case; path: from there up to ?, # or the end.  Both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule (host, then a path from its first slash on) that fits, as struct(rule, verdict); else null.

    A rule fits its host and all subdomains if the path begins with the rule's.  Of rules of one
    length that fit, block goes first, then the smaller one.  The list is a parameter and part of the plan, so it should
    hold hundreds of rules, not millions.
    """
    for rule, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"rule {rule} has verdict {verdict}")
    found = None
    for rule, verdict in sorted(set(rules), key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grams(data: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed n-gram of every place; each text has a mark before and behind it, so n-grams at its ends are their own."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), np.where(sizes > 0, sizes + 2, 0))
    marked = np.full(len(owner), 1, np.uint64)
    starts = np.cumsum(np.where(sizes > 0, sizes + 2, 0)) - np.where(sizes > 0, sizes + 2, 0)
    inner = np.arange(len(data)) - np.repeat(offsets[:-1][full], sizes[full]) + np.repeat(starts[full] + 1, sizes[full])
    marked[inner] = data.astype(np.uint64) + np.uint64(2)
    ends = np.repeat(starts[full] + sizes[full] + 2, sizes[full] + 2)
    rows, hashes = [], []
    for length in LENGTHS:
        if len(marked) < length:
            continue
        h = np.full(len(marked) - length + 1, salt * 8 + length, np.uint64)
        for i in range(length):
            h = h * np.uint64(0x100000001B3) + marked[i : len(marked) - length + 1 + i]
        inside = np.arange(len(h)) + length <= ends[: len(h)]
        rows.append(owner[: len(h)][inside])
        hashes.append((_mixed(h[inside]) % np.uint64(FEATURES)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(hashes)


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each once, ascending: the n-grams of hosts and those of paths, apart."""
    parts = [_grams(*_bytes_of(column), salt) for salt, column in enumerate((host, path), 1)]
    both = np.unique(np.concatenate([r * FEATURES + f for r, f in parts]))
    return both // FEATURES, both % FEATURES


def _logits(rows: np.ndarray, found: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    """Each row's vector of features has length 1."""
    many = np.bincount(rows, minlength=n)
    return bias + np.bincount(rows, weights[found], n) / np.sqrt(np.maximum(many, 1))


def _chance(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def fit(rows: np.ndarray, found: np.ndarray, y: np.ndarray) -> Model:
    """Logistic loss with the labels weighing PRIOR and 1 - PRIOR and a quadratic penalty, by accelerated gradient steps."""
    n = len(y)
    used, at = np.unique(found, return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    weight = np.where(y == 1, PRIOR / max(1, (y == 1).sum()), (1 - PRIOR) / max(1, (y == 0).sum()))
    theta, ahead, bias, bias_ahead = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    step = 1 / (0.5 + PENALTY)  # vectors have length 1 and weights sum to 1, so gradients change at most a quarter as fast as theta and bias do, together
    for t in range(STEPS):
        z = bias_ahead + np.bincount(rows, ahead[at], n) * scale
        g = weight * (_chance(z) - y)
        new = ahead - step * (np.bincount(at, (g * scale)[rows], len(used)) + PENALTY * ahead)
        new_bias = bias_ahead - step * g.sum()
        momentum = t / (t + 3)
        ahead, bias_ahead = new + momentum * (new - theta), new_bias + momentum * (new_bias - bias)
        theta, bias = new, new_bias
    return Model(used.astype(np.int32), theta, float(bias))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task, of a bounded sample (h, host, path, y): the model as a row."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    sample = pa.Table.from_batches(held).sort_by([("h", "ascending"), ("host", "ascending"), ("path", "ascending")]).combine_chunks()
    y = np.asarray(sample.column("y")).astype(np.float64)
    model = fit(*features(sample.column("host").chunk(0), sample.column("path").chunk(0)), y)
    yield pa.RecordBatch.from_arrays([pa.array([model.features.tolist()], pa.list_(pa.int32())), pa.array([model.weights.tolist()], pa.list_(pa.float64())), pa.array([model.bias], pa.float64())], names=["features", "weights", "bias"])


def train(urls: DataFrame, url: str = "url", label: str = "label") -> Model:
    """Fit a model to labelled URLs: label 1 is to be blocked, 0 to be allowed.

    Takes at most SAMPLE_ROWS rows, by the least hash of host and path, and of these as many as have SAMPLE_BYTES
    bytes together.  Rows with a null, an empty host and path or another label are left out; repeated rows count once, and one that is
    labelled both ways is to be blocked.  Without rows of both labels nothing is learnt and everything scores 0 (or 1, if
    all are to be blocked).
    """
    host, path = host_and_path(F.col(url))
    rows = urls.where(F.col(url).isNotNull() & F.col(label).isin(0, 1)).select(host.alias("host"), path.alias("path"), F.col(label).cast("int").alias("y"))
    rows = rows.where("host <> '' or path <> ''").groupBy("host", "path").agg(F.max("y").alias("y"), F.max(F.octet_length("host") + F.octet_length("path")).alias("n"))
    taken = rows.select(F.xxhash64("host", "path").alias("h"), "host", "path", "y", "n").orderBy("h", "host", "path").limit(SAMPLE_ROWS)
    bound_batches(urls.sparkSession)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = SAMPLE_BYTES

        def within() -> Iterator[pa.RecordBatch]:
            nonlocal left
            for b in batches:
                upto = np.cumsum(np.asarray(b.column("n")).astype(np.int64))
                yield b.slice(0, int(np.searchsorted(upto, left, "right")))
                left = -1 if len(upto) and upto[-1] > left else left - (int(upto[-1]) if len(upto) else 0)

        yield from _learn(within())

    row = taken.coalesce(1).mapInArrow(learn, "features array<int>, weights array<double>, bias double").first()
    labels = {r.y for r in taken.select("y").distinct().collect()}
    if row is None or len(labels) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0), 40.0 if labels == {1} else -40.0)
    return Model(np.array(row["features"], np.int32), np.array(row["weights"], np.float64), row["bias"])


def sample_urls(spark: SparkSession) -> DataFrame:
    """A small table of labelled URLs (url, label): words of unwanted and of ordinary hosts, all in the same forms."""
    rows = []
    for label, words in ((1, BLOCKED_WORDS.split()), (0, ALLOWED_WORDS.split())):
        for k, w in enumerate(words):
            forms = FORMS.split("|")
            rows += [(forms[(k + j) % len(forms)].format(w=w, k=37 * (k + j) % 1000), label) for j in (0, 1)]
    return spark.createDataFrame(rows, "url string, label int")


def chance(host: Column, path: Column, model: Model) -> Column:
    """How likely a URL of this host and path is to be blocked; 0 if both are empty."""
    weights = np.zeros(FEATURES)
    weights[model.features] = model.weights
    kept, bias = np.flatnonzero(weights).astype(np.int32), model.bias
    values = weights[kept]

    @arrow_udf("double")
    def scored(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        table = np.zeros(FEATURES)
        table[kept] = values
        sizes = np.diff(_bytes_of(hosts)[1]) + np.diff(_bytes_of(paths)[1])
        upto, out, a = np.cumsum(sizes), np.zeros(len(hosts)), 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _AT_ONCE, "right")))
            rows, found = features(hosts.slice(a, b - a), paths.slice(a, b - a))
            out[a:b] = _chance(_logits(rows, found, b - a, table, bias))
            a = b
        out[sizes == 0] = 0.0
        return pa.array(out)

    return scored(host, path)


def judge(pages: DataFrame, rules: Rules, model: Model, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and score (the model's chance that the URL is to be blocked) of every row.

    The verdict is the longest fitting rule's; without one it is block if the score is 0.5 or more.  A null
    URL or one without :// has an empty host and path, fits no rule and is allowed.  Repeated rows each give a row, null
    keys are kept, other columns are ignored; an empty table gives an empty table.
    """
    bound_batches(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("score", chance(F.col("host"), F.col("path"), model))
    verdict = F.coalesce(F.col("found")["verdict"], F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select(F.col("k").alias(key), "host", "path", F.col("found")["rule"].alias("rule"), verdict.alias("verdict"), "score")


def keep_allowed(pages: DataFrame, rules: Rules, model: Model, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, all columns as they were."""
    bound_batches(pages.sparkSession)
    host, path, score = own(pages.columns, "__host", "__path", "__score")
    h, p = host_and_path(F.col(url))
    rows = pages.withColumn(host, h).withColumn(path, p)
    rows = rows.withColumn(score, chance(F.col(host), F.col(path), model))
    verdict = F.coalesce(matching_rule(F.col(host), F.col(path), rules)["verdict"], F.when(F.col(score) >= 0.5, "block").otherwise("allow"))
    return rows.where(verdict == "allow").select(pages.columns)
