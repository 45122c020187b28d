"""SimHash near-duplicates by meet-in-the-middle ball hashing.

To link all fingerprints at 3 or fewer differing bits, every distinct
fingerprint emits all variants within half that radius, 1 bit:

1. On all 64 bits, two fingerprints that share a variant differ in at most 2
   bits, so a shared variant is a link; stars of them replace the pairs.
2. Three differing bits don't meet there.  But of three blocks of bits, two
   hold at most 2 of the 3; so variants within 1 bit over each two blocks
   meet, and colliding pairs that step 1 hasn't joined are verified on all bits.

So links of all distances up to 3 are found, with 196 variants a fingerprint instead of the 2081
of a ball of radius 2, and pairs inside a group of copies are never listed.  Variants of many fingerprints
are compared in blocks by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .arrow import bound_batches, give_back
from .blocks import candidate_pairs
from .components import components
from .names import own
from .tokens import groups, words_of

SEED = 42
_BLOCKS = ((0, 22), (22, 43), (43, 64))
_FIELD = np.uint64(0x0001000100010001)


def _lowered(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] |= 32
    return out


def shingle_bounds(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one space between words, where shingles begin and end in them, and how many each text has."""
    starts, ends = words_of(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(owner, minlength=len(offsets) - 1)
    first_word = np.cumsum(words) - words
    kept = np.zeros(len(data) + 1, np.int8)
    kept[starts] += 1
    kept[ends] -= 1
    kept = np.cumsum(kept[:-1], dtype=np.int8).astype(bool)
    joined = starts[np.arange(len(starts)) != first_word[owner]] - 1 if len(starts) else starts
    text = data.copy()
    text[joined] = 32
    kept[joined] = True
    moved = np.concatenate([[0], np.cumsum(kept)])
    starts, ends = moved[starts], moved[ends]
    many = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    shingle = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    a = np.repeat(first_word, many) + shingle
    b = a + np.repeat(np.minimum(width, words), many) - 1
    return text[kept], starts[a], ends[b], many


def majority(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each run of ``many`` hashes the bits that over half of them have; 0 for no hashes."""
    out = np.zeros(len(many), np.uint64)
    full = np.flatnonzero(many)
    if not len(full):
        return out
    limit = 65_535  # a count fits in 16 bits
    pieces = -(-many[full] // limit)
    of = np.repeat(np.arange(len(full)), pieces)
    begin = (np.cumsum(many) - many)[full]
    at = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * limit
    half, first = many[full], np.flatnonzero(np.diff(of, prepend=-1))
    for k in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _FIELD, at)
        for f in range(4):
            counts = np.add.reduceat((sums >> np.uint64(16 * f)) & np.uint64(0xFFFF), first)
            out[full] |= (2 * counts > half).astype(np.uint64) << np.uint64(16 * f + k)
    return out


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and 64-bit fingerprint (a signed long) of every whole text.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``width``
    words joined by a space (all words if fewer), hashed by XXH64 with seed 42; a
    fingerprint bit is 1 if it is set in over half of the hashes, repeats included.  A null
    or wordless text has fingerprint 0.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            prints = np.zeros(batch.num_rows, np.uint64)
            for first, last, data, offsets in groups(batch.column(1)):
                joined, starts, ends, many = shingle_bounds(_lowered(data), offsets, width)
                view = memoryview(joined.tobytes())
                hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
                prints[first:last] = majority(hashes, many)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[key, "fingerprint"])
        give_back()

    return docs.select(key, text).mapInArrow(sketch, f"`{key}` {kind.simpleString()}, fingerprint bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _full_variants() -> list[tuple[int, int]]:
    """(bits kept, bits flipped) of the ball of radius 1 over all 64 bits."""
    return [(-1, _signed(flip)) for flip in (0, *(1 << i for i in range(64)))]


def _block_variants() -> list[tuple[int, int]]:
    """The same over each two of the three blocks; the third block's place tells which two."""
    out = []
    for n, (low, high) in enumerate(_BLOCKS):
        keep = ((1 << 64) - 1) & ~(((1 << high) - 1) & ~((1 << low) - 1))
        out += [(_signed(keep), _signed(flip | (n + 1) << low)) for flip in (0, *(1 << i for i in range(64) if not low <= i < high))]
    return out


def _variants(rows: DataFrame, variants: list[tuple[int, int]]) -> DataFrame:
    masks = F.array(*(F.struct(F.lit(k).cast("bigint").alias("keep"), F.lit(f).cast("bigint").alias("flip")) for k, f in variants))
    out = rows.withColumn("m", F.explode(masks))
    return out.withColumn("variant", F.col("fingerprint").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip"))).drop("m")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by variant: link every fingerprint to the first of its variant."""
    last, centre = None, 0
    for batch in batches:
        variant, print_ = np.asarray(batch.column("variant")), np.asarray(batch.column("fingerprint"))
        if not len(variant):
            continue
        new = np.concatenate([[last is None or variant[0] != last], variant[1:] != variant[:-1]])
        at = np.where(new, np.arange(len(variant)), -1)
        np.maximum.accumulate(at, out=at)
        centres = np.where(at >= 0, print_[at], centre)
        last, centre = variant[-1], centres[-1]
        other = centres != print_
        yield pa.RecordBatch.from_arrays([pa.array(centres[other]), pa.array(print_[other])], names=["a", "b"])


def near_pairs(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of the distinct fingerprints of ``prints`` within 3 bits, enough to join all that are.

    The stars of step 1, the groups (node, root) that they make, and the pairs of step 2 with their groups (ga, gb).
    """
    bound_batches(prints.sparkSession)
    near = _variants(prints.select("fingerprint"), _full_variants()).repartition("variant").sortWithinPartitions("variant", "fingerprint")
    stars = staged(near.mapInArrow(_stars, "a bigint, b bigint").distinct(), "stars")
    first = staged(components(stars), "near")
    grouped = prints.select("fingerprint").join(first, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("grp"))
    far = _variants(grouped, _block_variants()).select(F.col("variant").alias("key"), F.col("fingerprint").alias("id"), F.col("fingerprint").alias("sketch"), "grp")
    groups = grouped.select(F.col("fingerprint").alias("f"), "grp")
    pairs = candidate_pairs(far, 3)
    ends = pairs.join(groups.select(F.col("f").alias("a"), F.col("grp").alias("ga")), "a").join(groups.select(F.col("f").alias("b"), F.col("grp").alias("gb")), "b")
    return stars, first, ends.select("a", "b", "ga", "gb")


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """(node, root) for the distinct fingerprints of ``prints`` that others lie within 3 bits of."""
    _, first, pairs = near_pairs(prints)
    second = staged(components(pairs.select(F.col("ga").alias("a"), F.col("gb").alias("b"))), "far")
    # roots of the first step are nodes of the second
    joined = first.select("node", F.col("root").alias("r1")).unionByName(second.select("node", F.col("node").alias("r1")).join(first.select("node"), "node", "left_anti"))
    return joined.join(second.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("r1") == F.col("n2"), "left").select("node", F.coalesce("r2", "r1").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint and component_id of every row.

    Fingerprints at 3 or fewer differing bits are linked; component_id is the least key
    reachable by links, itself included.  Rows with a null key have links like others
    but aren't the least unless no key is there (then component_id is null); repeated rows and exact copies share
    a fingerprint.  An empty table gives an empty table; other columns are ignored.
    """
    rows = staged(fingerprints(docs, width, key, text), "fingerprints")
    prints = staged(rows.groupBy("fingerprint").agg(F.min(key).alias("least")), "prints")
    roots = staged(link_fingerprints(prints), "roots")
    labelled = prints.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    label = staged(labelled.join(ids, F.col("root") == F.col("r")).select(F.col("fingerprint").alias("f"), "component_id"), "labels")
    return rows.join(label, F.col("fingerprint") == F.col("f")).select(key, "fingerprint", "component_id")


def keep_least(numbered: DataFrame, row: str, groups: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``numbered`` (with its row number), one row of each group of ``groups`` (row, grp).

    The row of the least key stays (null last), of several the least numbered.  Rows are told apart by number, so only
    rows of a group go, whatever their keys.  The rows that go are anti-joined: broadcast while they are few,
    shuffled beyond that, so the texts of a corpus with few copies don't move.
    """
    keys = numbered.select(F.col(row).alias("row"), F.col(key).alias("key"))
    placed = staged(groups.select(F.col(row).alias("row"), "grp").join(keys, "row"), "groups")
    least = placed.groupBy("grp").agg(F.min(F.struct(F.col("key").isNull().alias("no"), "key", "row"))["row"].alias("kept"), F.count(F.lit(1)).alias("n"))
    several = least.where("n > 1").select(F.col("grp").alias("g"), "kept")
    (gone,) = own(numbered.columns, "__out")
    out = staged(placed.join(several, F.col("grp") == F.col("g")).where("row <> kept").select(F.col("row").alias(gone)), "out")
    small = out.count() <= 200_000
    return numbered.join(F.broadcast(out) if small else out, F.col(row) == F.col(gone), "left_anti").select(*names)


def keep_one(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row, that of the least key (null last), of each group of near-duplicates.

    Rows that share a key and have different texts go or stay by their texts; a row with a null key
    goes if another one's text is near.
    """
    (row,) = own(docs.columns, "__row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, width, row, text)
    return keep_least(numbered, row, found.select(row, F.col("component_id").alias("grp")), key, docs.columns)
