"""Secret scans by patterns and a battery of randomness tests, in DataFrame functions alone.

Three patterns give the base spans.  Beyond them, every run of 20 or more
characters of [A-Za-z0-9+/_=-] is a candidate.  Its encoding is inferred from the characters it
has (hex, base32, base36, base64), and its symbols go through three tests against
uniform random symbols: chi-squared over the alphabet, runs about the
alphabet's middle, and serial correlation.  The smallest of the three p-values, times 3, is the
candidate's p.  Runs without a digit, or of digits alone, are words or numbers and no candidates.

A candidate whose p is under ``UNIFORM`` isn't random.  For the others false discoveries are controlled against
a fixed null: in words joined with numbers, at most about one neighbour in five goes from letter to digit, digit to
letter, lower to upper case, or to lower case after a capital that doesn't begin a word, and ``chance`` is the binomial chance of as many such changes as the
candidate has.  It needs no other run of the corpus, and is the less the longer a random run
is.  By Benjamini and Hochberg over the candidates of the corpus, those are secrets whose chance is
at most the greatest level that keeps the expected share of words among them within ``FDR``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .names import own

#: The base patterns, and how long a match (for assign: its second group) must be.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
FDR = 0.05
#: The battery's least p of a random run; the rate of changes in words with numbers; levels of chance are 10^(-step / STEPS), down to 10^(-LEAST_STEP / STEPS).
UNIFORM, CHANGES = 0.01, 0.2
STEPS, LEAST_STEP = 8, 320
_CHANGE = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z0-9][A-Z])(?=[a-z])"
_ALPHABETS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def _two_sided(z: Column) -> Column:
    """The normal tail beyond |z| on both sides (Abramowitz and Stegun 7.1.26, error under 2e-7)."""
    x = F.abs(z) / float(2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-F.least(x * x, F.lit(700.0))))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def randomness(token: Column) -> Column:
    """The p-value of the battery for one token of 20 or more characters."""
    stripped = F.regexp_replace(token, "=+$", "")
    return _bound(stripped, lambda x: _encoded(F.when(x == "", F.lit("A")).otherwise(x)))  # signs alone score 0, as one symbol does


def _encoded(body: Column) -> Column:
    def spelt(hexes: Column, base32: Column, base36: Column) -> Column:
        size = F.when(hexes, 16).when(base32, 32).when(base36, 36).otherwise(64)
        text = F.when(hexes, F.lower(body)).when(base32 | base36, body).otherwise(F.translate(body, "-_", "+/"))
        alphabet = F.when(hexes, _ALPHABETS[16]).when(base32, _ALPHABETS[32]).when(base36, _ALPHABETS[36]).otherwise(_ALPHABETS[64])
        return F.struct(text.alias("text"), alphabet.alias("alphabet"), size.cast("double").alias("a"))

    kinds = F.struct(body.rlike("^([0-9a-f]+|[0-9A-F]+)$").alias("hexes"), body.rlike("^[A-Z2-7]+$").alias("base32"), body.rlike("^[0-9a-z]+$").alias("base36"))
    values = lambda s: F.transform(F.filter(F.split(s["text"], ""), lambda c: c != ""), lambda c: F.greatest(F.instr(s["alphabet"], c) - 1, F.lit(0)).cast("double"))
    with_values = lambda s: F.struct(values(s).alias("v"), s["a"].alias("a"))
    return _bound(kinds, lambda k: _bound(spelt(k["hexes"], k["base32"], k["base36"]), lambda s: _bound(with_values(s), lambda t: _battery(t["v"], t["a"]))))


def _battery(v: Column, a: Column) -> Column:
    """The p-value of the symbols ``v`` of an alphabet of ``a``: one pass over neighbours, and one for each bin, whatever the length."""
    zero = F.lit(0.0)
    start = F.struct(*(zero.alias(c) for c in ("first", "last", "sum", "squares", "products", "high", "turns", "n")))

    def add(s: Column, x: Column) -> Column:
        new, up, was_up = s["n"] == 0, 2 * x >= a, 2 * s["last"] >= a
        return F.struct(
            F.when(new, x).otherwise(s["first"]).alias("first"), x.alias("last"), (s["sum"] + x).alias("sum"), (s["squares"] + x * x).alias("squares"), (s["products"] + F.when(new, zero).otherwise(s["last"] * x)).alias("products"),
            (s["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"), (s["turns"] + F.when(~new & (up != was_up), 1.0).otherwise(0.0)).alias("turns"), (s["n"] + 1.0).alias("n"),
        )

    bins = F.greatest(F.lit(2.0), F.least(F.lit(16.0), F.floor(F.size(v) / 5).cast("double")))
    bound = F.struct(F.aggregate(v, start, add).alias("s"), bins.alias("bins"))
    counted = lambda r: F.transform(F.sequence(F.lit(0), r["bins"].cast("int") - 1), lambda j: F.size(F.filter(v, lambda x: F.floor(x * r["bins"] / a) == j)).cast("double"))
    # each step binds what the next one uses more than once
    with_counts = F.transform(F.array(bound), lambda r: F.struct(r["s"].alias("s"), r["bins"].alias("bins"), counted(r).alias("counts")))
    return F.element_at(F.transform(with_counts, lambda r: _combined(r["s"], r["bins"], r["counts"], a)), 1)


def _combined(s: Column, bins: Column, counts: Column, a: Column) -> Column:
    n = s["n"]
    # chi-squared over bins that expect 5 symbols or more, by Wilson and Hilferty's cube root; bins needn't hold the same number of symbols of the alphabet
    expected = lambda j: n * (F.ceil((j + 1) * a / bins) - F.ceil(j * a / bins)).cast("double") / a
    chi = F.aggregate(F.transform(counts, lambda o, j: (o - expected(j)) * (o - expected(j)) / expected(j)), F.lit(0.0), lambda acc, x: acc + x)
    df = bins - 1
    p_chi = F.least(F.lit(1.0), _two_sided(F.greatest(F.lit(0.0), (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))))
    # runs above and below the middle
    high = s["high"]
    low = n - high
    mean = 2 * high * low / n + 1
    spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))))
    p_runs = F.when((high == 0) | (low == 0), F.lit(0.0)).otherwise(_two_sided((s["turns"] + 1 - mean) / spread))
    # correlation of neighbours, about the mean of all
    centre = s["sum"] / n
    power = s["squares"] - n * centre * centre
    serial = s["products"] - centre * (2 * s["sum"] - s["first"] - s["last"]) + (n - 1) * centre * centre
    p_serial = F.when(power <= 1e-9, F.lit(0.0)).otherwise(_two_sided(serial / F.greatest(power, F.lit(1e-9)) * F.sqrt(n)))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def is_decoy(token: Column) -> Column:
    """Words and numbers: no digit or no letter."""
    return ~(token.rlike("[0-9]") & token.rlike("[A-Za-z]"))


def chance(token: Column) -> Column:
    """The chance of as many changes in words with numbers, an upper bound of the binomial tail; 1 for a run that isn't random."""
    x = F.struct((F.length(token) - 1).cast("double").alias("n"), F.regexp_count(token, F.lit(_CHANGE)).cast("double").alias("c"), randomness(token).alias("p"))
    return F.element_at(F.transform(F.array(x), lambda s: F.when(s["p"] < UNIFORM, F.lit(1.0)).otherwise(_tail(s["n"], s["c"]))), 1)


def _tail(n: Column, c: Column) -> Column:
    rest = n - c
    apart = c * F.ln(F.greatest(c, F.lit(1.0)) / (n * CHANGES)) + F.when(rest > 0, rest * F.ln(F.greatest(rest, F.lit(1.0)) / (n * (1 - CHANGES)))).otherwise(0.0)
    point = F.exp(-F.least(apart, F.lit(700.0))) / F.sqrt(F.greatest(F.lit(1.0), 2 * 3.141592653589793 * c * rest / n))  # Stirling
    ratio = rest * CHANGES / ((c + 1) * (1 - CHANGES))  # of the next term to this one
    return F.when(c <= n * CHANGES, F.lit(1.0)).otherwise(F.least(F.lit(1.0), point / F.greatest(F.lit(1e-9), 1 - ratio)))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


_MATCH = "array<struct<kind:int,i:int,gap:bigint,len:bigint,good:boolean,chance:double,decoy:boolean>>"


def _matches(text: Column, kind: str) -> Column:
    """The matches of a kind in order: the characters between it and the one before, and its own; good if it is long enough."""
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX.replace("+", f"{{{LEAST['hex']},}}"), "random": CANDIDATE}[kind]
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    bound = F.array(F.struct(gaps.alias("g"), found.alias("f"), values.alias("v")))
    no = {"chance": F.lit(None).cast("double"), "decoy": F.lit(None).cast("boolean")}

    def one(s: Column, m: Column, i: Column) -> Column:
        scored = {"chance": F.when(is_decoy(m), F.lit(1.0)).otherwise(chance(m)), "decoy": is_decoy(m)} if kind == "random" else no
        good = F.lit(False) if kind == "random" else F.length(F.get(s["v"], i)) >= LEAST[kind]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.get(s["g"], i)).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("len"),
            good.alias("good"), *(c.alias(k) for k, c in scored.items()),
        )

    every = F.flatten(F.transform(bound, lambda s: F.transform(s["f"], lambda m, i: one(s, m, i))))
    return F.when(text.rlike(pattern), every.cast(_MATCH)).otherwise(_none(_MATCH))


def found_matches(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and a match a row; a text without matches has one row of nulls."""
    body = F.coalesce(F.col(text), F.lit(""))
    arrays = docs.select(*keys, F.concat(*(_matches(body, k) for k in KINDS)).alias("m"))
    return arrays.select(*keys, F.explode_outer("m").alias("m")).select(*keys, "m.*")


def level(matches: DataFrame) -> float:
    """The greatest chance of a secret; 0 if there is none.

    The counts by step are taken over all documents; LEAST_STEP + 1 rows at most come to the driver.
    """
    step = F.least(F.lit(LEAST_STEP), F.floor(-F.log10(F.greatest(F.col("chance"), F.lit(1e-300))) * STEPS)).cast("int")
    counts = {r["step"]: r["count"] for r in matches.where("chance is not null and not decoy").groupBy(step.alias("step")).count().collect()}
    total = sum(counts.values())
    for k in range(LEAST_STEP + 1):
        reach = sum(n for j, n in counts.items() if j >= k)
        if reach and 10 ** (-k / STEPS) * total <= FDR * reach:
            return 10 ** (-k / STEPS)
    return 0.0


def _accepted(most: float, chance: Column, decoy: Column) -> Column:
    step = F.least(F.lit(LEAST_STEP), F.floor(-F.log10(F.greatest(chance, F.lit(1e-300))) * STEPS))
    return ~decoy & (step >= round(-math.log10(most) * STEPS)) if most else F.lit(False)


def _spans(docs: DataFrame, text: str, keys: list[str]) -> tuple[DataFrame, float]:
    """The staged matches of ``docs`` with their places, and the greatest chance of a secret."""
    matches = staged(found_matches(docs, keys, text), "matches")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    most = level(matches)
    taken = F.col("good") | F.coalesce(_accepted(most, F.col("chance"), F.col("decoy")), F.lit(False))
    return matches.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("taken", taken), most


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of every whole text.

    spans holds kind:start:end by start and then kind, comma-joined, in code points with the
    end exclusive; base_sha256 is the SHA-256 of the base kinds' part of it.  A
    null or empty text has none; repeated rows each give a row; rows with a null
    key are kept; an empty table gives an empty table.  Other columns are ignored.
    """
    numbered = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    placed, _ = _spans(numbered, "text", ["row", "key"])
    span = F.when(F.col("taken"), F.struct((F.col("end") - F.col("len")).alias("start"), "kind", "end"))
    grouped = placed.groupBy("row", "key").agg(F.sort_array(F.collect_list(span)).alias("s"))
    name = lambda k: F.element_at(F.array(*(F.lit(x) for x in KINDS)), k + 1)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("bigint")
    return grouped.select(
        F.col("key").alias(key), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(joined(F.filter("s", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
    )


#: A table of spans of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; spans that overlap are replaced as one.

    The texts are searched once; then only those with a secret are rewritten.  A null text stays null, repeated rows are each
    rewritten, an empty table stays empty; other columns are as they were.
    """
    names = docs.columns
    row, of, spans = own(names, "__row", "__r", "__s")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    placed, _ = _spans(numbered.select(F.col(row).alias("row"), F.col(text).alias("text")), "text", ["row"])
    found = placed.where("taken").groupBy("row").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("len")).cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias(spans))
    found = staged(found.select(F.col("row").alias(of), spans), "spans")
    small = found.count() <= BROADCAST_ROWS
    joined = numbered.join(F.broadcast(found) if small else found, F.col(row) == F.col(of), "left")
    # the text behind each span up to the next; a span that begins inside the ones before it only moves their end
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    body = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        between = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.when(apart, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), done).otherwise(body)).select(*names)
