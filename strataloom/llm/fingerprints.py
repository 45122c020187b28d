"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone.

A paragraph (a line) is hashed to a wide vector: 8 numbers of 32 bits cut from its
SHA-256, then 64 counts of the bits of its three-word shingles' XXH64s, then the number of shingles.
A document's fingerprint is the sum of its paragraphs' vectors modulo 2^32.
So the order of paragraphs doesn't matter, and the fingerprint after
inserting or deleting paragraphs is the old one plus or minus their vectors; paragraphs that two texts
share are hashed once.
The first part tells multisets of paragraphs apart; the second, twice the counts less
the number of shingles, is a random projection of the shingles, whose cosine is the likeness.  Counts
are exact for texts of under 2^31 shingles, more than a string can hold.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY, LANES, MOD = 8, 64, 1 << 32
#: Documents are put in order in buckets of about so many bytes, at most BINS of them; bounds come from about PER_BIN keys a bucket.
BUCKET_BYTES, BINS, PER_BIN = 4 << 20, 1 << 14, 16


def _identity(text: Column) -> Column:
    """The sums of the 32-bit parts of the lines' SHA-256s, modulo 2^32; zeros for null, which has no lines."""
    digests = F.transform(F.split(text, "\n", -1), lambda line: F.sha2(line.cast("binary"), 256))
    part = lambda xs, j: F.aggregate(xs, F.lit(0).cast("bigint"), lambda acc, x: acc + F.conv(F.substring(x, 8 * j + 1, 8), 16, 10).cast("bigint"))
    bound = F.transform(F.array(F.coalesce(digests, F.array().cast("array<string>"))), lambda xs: F.array(*(F.pmod(part(xs, j), F.lit(MOD)) for j in range(IDENTITY))))
    return F.element_at(bound, 1)


def _lane_sums(rows: DataFrame, keys: list[str], texts: str) -> DataFrame:
    """``keys``, v, n and s0 to s31 for the structs (v, t) of the array ``texts``.

    n is the number of shingles of t, the triples of neighbouring words of each line (a line's last two start
    shorter ones); the low and the high 32 bits of sK count those whose XXH64 has bit K and bit K + 32.
    Line ends become words of their own, so that the hashes and sums are plain expressions in generated code.
    """
    each = rows.select(*keys, F.explode(texts).alias("x")).select(*keys, F.col("x.v").alias("v"), F.split(F.replace(F.col("x.t"), F.lit("\n"), F.lit(" \n ")), " ", -1).alias("w"))
    many = F.size("w")
    triples = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), many).alias("b"), F.slice("w", F.lit(3), many).alias("c"))
    words = each.select(*keys, "v", F.inline(triples)).where("a <> '\\n'")
    end = F.col("b").eqNullSafe("\n")
    second, third = F.when(~end, F.col("b")), F.when(~end & ~F.col("c").eqNullSafe("\n"), F.col("c"))
    hashed = words.select(*keys, "v", F.xxhash64("a", second, third).alias("h"))
    both = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(both)).alias(f"s{k}") for k in range(LANES // 2)]
    return hashed.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"), *sums)


def _lanes(name: str = "s", count: str = "n") -> Column:
    """The 64 counts and the number of shingles, from two counts a long."""
    low = [F.col(f"{name}{k}").bitwiseAND(F.lit(MOD - 1)) for k in range(LANES // 2)]
    high = [F.shiftrightunsigned(f"{name}{k}", 32) for k in range(LANES // 2)]
    return F.array(*low, *high, F.pmod(F.col(count), F.lit(MOD)))


def vectors(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys``, which tell rows apart, and vector: that of the column ``text``, an array of 73 longs.

    A null text is empty.  Repeated keys are added up as if their texts were one's paragraphs.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sums = _lane_sums(rows.select(*keys, F.array(F.struct(F.lit(0).alias("v"), body.alias("t"))).alias("__texts")), keys, "__texts")
    ids = rows.select(*keys, _identity(body).alias("__id")).groupBy(*keys).agg(*(F.pmod(F.sum(F.col("__id")[j]), F.lit(MOD)).alias(f"__{j}") for j in range(IDENTITY)))
    lanes = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), _lanes().alias("__lanes"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    return ids.join(lanes, condition).select(*keys, F.concat(F.array(*(F.col(f"__{j}") for j in range(IDENTITY))), "__lanes").alias("vector"))


def combine(a: Column, b: Column, minus: bool = False) -> Column:
    """The vector of both texts' paragraphs together, or of the first's without the second's."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y if minus else x + y, F.lit(MOD)))


def as_text(vector: Column) -> Column:
    """The fingerprint: 8 hex digits for each number."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.substring(F.hex(x + F.lit(MOD)), -8, 8)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two texts' shingle counts, 0 to 1, from their vectors; 1 for equal lanes."""
    x, y = F.slice(a, -LANES - 1, LANES + 1), F.slice(b, -LANES - 1, LANES + 1)
    signed = lambda v: F.transform(F.slice(v, 1, LANES), lambda c: (2 * c - F.element_at(v, -1)).cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m * n), F.lit(0.0), lambda acc, v: acc + v)
    bound = F.transform(F.array(F.struct(signed(x).alias("x"), signed(y).alias("y"))), lambda s: F.try_divide(dot(s["x"], s["y"]), F.sqrt(dot(s["x"], s["x"]) * dot(s["y"], s["y"]))))
    return F.when(x == y, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.element_at(bound, 1), F.lit(0.0)))))


_KEY = "struct<o:bigint,h:bigint,row:bigint>"


def _bucket(key: Column, bounds: list[tuple[int, int, int]]) -> Column:
    """The number of ``bounds`` (ascending) that ``key`` isn't less than, by a search in two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    table = F.from_json(F.lit(json.dumps([[dict(zip(("o", "h", "row"), b, strict=True)) for b in p] for p in parts])), f"array<array<{_KEY}>>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    part = F.size(F.filter(table, lambda p: F.get(p, F.lit(0)) <= key))  # parts that begin at or below the key
    return F.when(part == 0, F.lit(0)).otherwise((part - 1) * step + below(F.get(table, part - 1))).cast("int")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in descending doc_id order: adds bucket, pos (from 1 in the bucket), guest and next_text.

    After the last row comes the first.  The order isn't found in one task: rows are dealt into ranges of about
    BUCKET_BYTES bytes of text, whose bounds are quantiles of a sample of the keys (id, a hash of the text, row
    number); so neither far-off ids nor one id on many rows fill a range.  Each range also gets the first row of the range after it, marked as its
    guest, for which next_text is null.  Null ids are last, equal ids are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    ends = docs.agg(F.min("doc_id"), F.count(F.lit(1)), F.sum(F.octet_length(text).cast("bigint") + 64)).first()
    lowest = (ends[0] or 0) - 1
    # nulls are put below the least id, and at the least long beside it where there is none below
    order = F.coalesce("doc_id", F.lit(max(lowest, -(1 << 63))))
    placed = docs.select("doc_id", text.alias("text"), F.struct(order.alias("o"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row")).alias("key"))
    many = min(BINS, max(1, (ends[2] or 0) // BUCKET_BYTES))
    bounds: list[tuple[int, int, int]] = []
    if many > 1:  # about PER_BIN * BINS keys at most
        keys = sorted(tuple(r[0]) for r in placed.select("key").sample(fraction=min(1.0, PER_BIN * many / ends[1]), seed=1).collect())
        bounds = sorted({keys[len(keys) * i // many] for i in range(1, many)}) if keys else []
    dealt = placed.withColumn("bucket", _bucket(F.col("key"), bounds))
    heads = {r[0]: tuple(r[1]) for r in dealt.groupBy("bucket").agg(F.max("key").alias("head")).collect()}  # one row a bucket
    tops = sorted(heads)
    # the first row of each bucket follows the last one of the bucket above, that of the top one the last of the lowest
    follow = [(heads[b], tops[(i + 1) % len(tops)], b) for i, b in enumerate(tops)]
    first = spark.createDataFrame(follow, f"head {_KEY}, into int, of int")  # one row a bucket
    guests = dealt.join(F.broadcast(first), (F.col("bucket") == F.col("of")) & (F.col("key") == F.col("head"))).select("doc_id", "text", "key", F.col("into").alias("bucket"), F.lit(True).alias("guest"))
    every = dealt.select("doc_id", "text", "key", "bucket", F.lit(False).alias("guest")).unionByName(guests)
    down = Window.partitionBy("bucket").orderBy("guest", F.desc("key"))
    return every.select("doc_id", "text", "bucket", "guest", F.row_number().over(down).alias("pos"), F.lead("text").over(down).alias("next_text"))


def compare_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next one's are.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next text in descending doc_id order.  Its vector is the text's less
    the paragraphs that the edit cuts or drops plus those that it makes: the paragraphs kept, lost and new are each
    hashed once.  The next text's vector is taken from its own row.  A null text is empty; repeated
    rows each give a row; one row alone is next to itself; an empty table gives an empty
    table.  Other columns are ignored.
    """
    rows = in_order(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    head, tail, given = F.left("text", n - cut), F.right("text", cut), F.left(F.coalesce("next_text", F.lit("")), cut)
    parts = rows.select("doc_id", "bucket", "pos", "guest", n.cast("bigint").alias("n_chars"), head.alias("head"), tail.alias("tail"), given.alias("given"))
    lines = F.length(F.substring_index("head", "\n", -1))  # of the last, cut line of the head
    kept = F.when(lines < F.length("head"), F.left("head", F.length("head") - lines - 1))
    parts = parts.select("doc_id", "bucket", "pos", "guest", "n_chars", "head", "given", kept.alias("kept"), F.concat(F.right("head", lines), "tail").alias("lost"), F.concat(F.right("head", lines), "given").alias("new"))
    texts = F.array(*(F.struct(F.lit(i).alias("v"), F.col(c).alias("t")) for i, c in enumerate(("kept", "lost", "new"))))
    # one bucket is in one partition, so the sums and the next row's are found without another shuffle
    # doc_id is a key here only so that both branches read the same columns of one shuffle of the texts
    sums = _lane_sums(parts.select("bucket", "pos", "doc_id", texts.alias("texts")), ["bucket", "pos", "doc_id"], "texts")
    total = lambda c, v: F.sum(F.when(F.col("v") != v, F.col(c)).otherwise(F.lit(0).cast("bigint")))
    names = ["n", *(f"s{k}" for k in range(LANES // 2))]
    added = sums.groupBy("bucket", "pos", "doc_id").agg(*(total(c, 2).alias(f"own_{c}") for c in names), *(total(c, 1).alias(f"edited_{c}") for c in names))
    lanes = added.select("bucket", "pos", _lanes("own_s", "own_n").alias("own"), _lanes("edited_s", "edited_n").alias("edited"))
    lanes = lanes.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("pos")))
    lanes = lanes.select(F.col("bucket").alias("b"), F.col("pos").alias("p"), "own", "edited", likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
    ids = {c: _identity(F.col(c)) for c in ("kept", "lost", "new")}
    about = parts.where("not guest").select("doc_id", "bucket", "pos", "n_chars", F.sha2(F.concat("head", "given").cast("binary"), 256).alias("edited_sha256"), *(x.alias(f"{c}_id") for c, x in ids.items()))
    own, edited = (F.concat(combine(F.col("kept_id"), F.col(f"{c}_id")), F.col(v)) for c, v in (("lost", "own"), ("new", "edited")))
    found = about.join(lanes, (F.col("bucket") == F.col("b")) & (F.col("pos") == F.col("p")))
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"), "near_edited", "near_next")
