"""Near copies by SimHash and five-word shingles: Jaccard similarity of 0.8 or more.

Texts whose 64-bit SimHash fingerprints lie within 3 bits, found by ball hashing, are the
first candidates; an exact similarity of 0.8 or more links them.  At 0.8 fingerprints differ in about 10 bits,
beyond any ball that could be emitted, so the pairs that they leave out are found by MinHash: a
text's set of shingle hashes gets BANDS keys of ROWS minima each.  Texts of similarity s share
a key with a chance of 1 - (1 - s^ROWS)^BANDS, which at 0.8 misses 6 pairs in 100,000, and fewer above.
Of texts that share a key those are candidates whose minima agree as often
as similar ones do; again the exact similarity decides.

Pairs inside a group of copies aren't listed: texts of one set are one node, each key's
texts are first checked against one of them, and pairs are listed only of keys whose texts are
still in several groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged
from .arrow import bound_batches, give_back
from .blocks import candidate_pairs
from .components import components
from .names import own
from .simhash import SEED, _lowered, keep_least, majority, near_pairs, shingle_bounds
from .tokens import groups

WIDTH, BANDS, ROWS = 5, 32, 6
#: One bit of each minimum makes a sketch; at 0.8 about a tenth differ, and more than so many in 2 pairs of 100,000.
APART = 38
#: The last candidates are held against wider sketches: half bytes of WIDE minima, of which more than WIDE_APART differ in 2 pairs of 100,000 at 0.8.
WIDE, WIDE_APART = 768, 190
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
#: Rounds in which a key's texts are checked against one of them, before pairs are listed.
STARS = 2
_FACTORS = np.random.default_rng(20240611).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b at a time: the ascending distinct shingle hashes of each text, and where each text's begin (and the last end)."""
    digest = xxhash.xxh64_intdigest
    for a, b, data, offsets in groups(column):
        joined, starts, ends, many = shingle_bounds(_lowered(data), offsets, WIDTH)
        view = memoryview(joined.tobytes())
        hashes = np.fromiter((digest(view[i:j], SEED) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
        owner = np.repeat(np.arange(b - a), many)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield a, b, hashes[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=b - a))])


def _set_ids(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    view = memoryview(hashes.tobytes())
    return np.array([xxhash.xxh64_intdigest(view[8 * i : 8 * j], SEED) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _band_keys(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys and the sketch of each text that has shingles; 0 for the others."""
    out, bits = np.zeros((len(cuts) - 1, BANDS), np.uint64), np.zeros((len(cuts) - 1, BANDS * ROWS // 64), np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        at = cuts[full]
        for k in range(BANDS):
            key = np.full(len(full), k + 1, np.uint64)
            for j in range(k * ROWS, (k + 1) * ROWS):
                least = np.minimum.reduceat(hashes * _FACTORS[j], at)
                key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
                bits[full, j // 64] |= ((least ^ least >> np.uint64(17) ^ least >> np.uint64(34)) & np.uint64(1)) << np.uint64(j % 64)
            out[full, k] = key
    return out, bits


def sketches(docs: DataFrame, row: str, text: str = "text") -> DataFrame:
    """row, set_id (equal for equal sets of shingles), size (distinct shingles), fingerprint, sketch and the keys of every whole text."""
    bound_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, cuts in _shingle_sets(batch.column(1)):
                keys, bits = _band_keys(hashes, cuts)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel())) for x in (bits, keys)]
                prints = pa.array(majority(hashes, np.diff(cuts)).view(np.int64))
                cells = [batch.column(0).slice(a, b - a), pa.array(_set_ids(hashes, cuts)), pa.array(np.diff(cuts).astype(np.int64)), prints, *lists]
                yield pa.RecordBatch.from_arrays(cells, names=[row, "set_id", "size", "fingerprint", "sketch", "keys"])
        give_back()

    return docs.select(row, text).mapInArrow(sketch, f"`{row}` {docs.schema[row].dataType.simpleString()}, set_id bigint, size bigint, fingerprint bigint, sketch array<bigint>, keys array<bigint>")


def shingles(texts: DataFrame) -> DataFrame:
    """(set_id, text) to set_id and the distinct shingle hashes."""
    bound_batches(texts.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, cuts in _shingle_sets(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["set_id", "hashes"])
        give_back()

    return texts.mapInArrow(hashed, "set_id bigint, hashes array<bigint>")


_WIDE_FACTORS = np.random.default_rng(20240613).integers(1, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _wide(sets: DataFrame) -> DataFrame:
    """(set_id, hashes) to set_id and its wide sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.asarray(batch.column("hashes").flatten()).view(np.uint64)
            at = np.concatenate([[0], np.cumsum(np.asarray(batch.column("hashes").value_lengths()))])
            out = np.zeros((batch.num_rows, WIDE // 16), np.uint64)
            for i in range(0, batch.num_rows, 64):  # 64 texts at a time
                j = min(i + 64, batch.num_rows)
                part, cuts = hashes[at[i] : at[j]], at[i:j] - at[i]
                for k, factor in enumerate(_WIDE_FACTORS):
                    least = np.minimum.reduceat(part * factor, cuts)
                    least ^= least >> np.uint64(17) ^ least >> np.uint64(34)
                    out[i:j, k // 16] |= (least & np.uint64(15)) << np.uint64(4 * (k % 16))
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array([r.tobytes() for r in out], pa.binary())], names=["set_id", "sketch"])
        give_back()

    return sets.mapInArrow(sketch, "set_id bigint, sketch binary")


def _packed(longs: Column) -> Column:
    """An array of longs as bytes, the highest of each first."""
    return F.unhex(F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _could(x: str, y: str) -> Column:
    """Sets of these sizes and sketches can be similar enough."""
    m, n = F.col(f"{x}.size"), F.col(f"{y}.size")
    apart = sum(F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(BANDS * ROWS // 64))
    return (F.least(m, n) * LEAST[1] >= F.greatest(m, n) * LEAST[0]) & (apart <= APART)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ga, gb) whose sets are similar enough."""
    x, y = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(y, "b").join(x, "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * LEAST[1] >= (F.size("x") + F.size("y") - common) * LEAST[0]).select("a", "b", "ga", "gb")


_SET = ["set_id", "size", *(f"s{i}" for i in range(BANDS * ROWS // 64))]


def _regrouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (a set, its size, sketch and grp) with the groups that ``links`` (ga, gb) join made one."""
    found = staged(components(links.select(F.col("ga").alias("a"), F.col("gb").alias("b"))), "joined")
    return staged(nodes.join(found, F.col("grp") == F.col("node"), "left").select(*_SET, F.coalesce("root", "grp").alias("grp")), "regrouped")


def _mixed(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of the keys that several groups share."""
    rows = keyed.join(nodes, "set_id")
    several = rows.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select(F.col("key").alias("k"))
    return staged(rows.join(several, F.col("key") == F.col("k"), "left_semi"), "mixed")


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Candidates (x, y): sets of one fingerprint against the least of them, and these of fingerprints within 3 bits."""
    prints = staged(sets.groupBy("fingerprint").agg(F.min("set_id").alias("least")), "prints")
    same = sets.join(prints, "fingerprint").where("set_id <> least").select(F.col("least").alias("x"), F.col("set_id").alias("y"))
    stars, _, pairs = near_pairs(prints)
    near = stars.unionByName(pairs.select("a", "b")).distinct()
    ends = near.join(prints.select(F.col("fingerprint").alias("a"), F.col("least").alias("x")), "a").join(prints.select(F.col("fingerprint").alias("b"), F.col("least").alias("y")), "b")
    return same.unionByName(ends.select("x", "y"))


def near_copies(docs: DataFrame, row: str, text: str = "text") -> DataFrame:
    """row and grp of every row: equal for texts that links of similarity 0.8 or more join; texts without words are one group."""
    rows = staged(sketches(docs, row, text), "sketches")
    sets = staged(rows.groupBy("set_id").agg(F.min(row).alias("one"), *(F.first(c).alias(c) for c in ("size", "fingerprint", "sketch", "keys"))), "sets")
    worded = sets.where("size > 0")
    keyed = worded.select("set_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"))
    keyed = staged(keyed.join(shared, F.col("key") == F.col("k"), "left_semi"), "keyed")
    alike = staged(_by_fingerprint(worded.select("set_id", "fingerprint")), "alike")
    some = keyed.select("set_id").unionByName(alike.select(F.col("x").alias("set_id"))).unionByName(alike.select(F.col("y").alias("set_id"))).distinct()
    chosen = sets.join(some, "set_id", "left_semi")
    nodes = staged(chosen.select("set_id", "size", *(F.col("sketch")[i].alias(f"s{i}") for i in range(BANDS * ROWS // 64)), F.col("set_id").alias("grp")), "nodes")
    ones = chosen.select("set_id", F.col("one").alias("__one"))
    hashes = staged(shingles(docs.join(ones, F.col(row) == F.col("__one")).select("set_id", text)), "shingles")
    checked, whole = None, None
    for turn in range(STARS + 3):
        mixed, pairs = None, None
        if turn == 0:  # what the fingerprints say
            x, y = (nodes.select(*(F.col(c).alias(f"{c}_{e}") for c in (*_SET, "grp"))) for e in "xy")
            both = alike.join(x, F.col("x") == F.col("set_id_x")).join(y, F.col("y") == F.col("set_id_y"))
            met = both.select(*(F.struct(*(F.col(f"{c}_{e}").alias(c) for c in (*_SET, "grp"))).alias(e) for e in "xy")).where(_could("x", "y"))
        else:
            mixed = _mixed(keyed, nodes)
            y = mixed.select("key", F.struct(*_SET, "grp").alias("y"))
            if turn <= STARS:  # each key's texts against one of them
                x = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "grp").alias("h"), F.struct(*_SET, "grp").alias("x")))["x"].alias("x")).withColumnRenamed("key", "k")
                met = y.join(x, (F.col("key") == F.col("k")) & (F.col("x.grp") != F.col("y.grp")) & _could("x", "y"))
            else:
                # under the first key that two texts share they are a candidate, whatever others they share; of those between the
                # same two groups the nearest go first, since most of the others are within one group then
                if whole is None:
                    some = mixed.select(F.col("set_id").alias("s")).distinct()
                    wide = _wide(hashes.join(some, F.col("set_id") == F.col("s"), "left_semi"))
                    whole = staged(wide.join(worded.select(F.col("set_id").alias("id"), "keys"), F.col("set_id") == F.col("id")).select("id", F.concat("sketch", _packed(F.col("keys"))).alias("sketch")), "wide")
                rows_ = mixed.select("key", F.col("set_id").alias("id"), "grp").join(whole, "id").select("key", "id", "sketch", "grp")
                pairs = candidate_pairs(rows_, WIDE_APART, BANDS, groups=True, nearest=turn == STARS + 1)
        first = F.col("x.set_id") < F.col("y.set_id")
        ends = {"a": ("x", "y", "set_id"), "b": ("y", "x", "set_id"), "ga": ("x", "y", "grp"), "gb": ("y", "x", "grp")}
        if pairs is None:
            pairs = met.select(*(F.when(first, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(n) for n, (p, q, c) in ends.items())).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        done = pairs.select("a", "b")
        checked = done if checked is None else checked.unionByName(done)
        before, nodes = nodes, _regrouped(nodes, _verified(pairs, hashes))
        discard(before, *([] if mixed is None else [mixed]))
    discard(keyed, hashes, alike, *([] if whole is None else [whole]))
    return rows.select(row, F.col("set_id").alias("s")).join(nodes, F.col("s") == F.col("set_id"), "left").select(row, F.coalesce("grp", "s").alias("grp"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row, that of the least key (null last), of each group of near copies.

    Rows are told apart by a row number, so only rows whose text another one's is
    near go, whatever their keys.
    """
    (row,) = own(docs.columns, "__row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    return keep_least(numbered, row, near_copies(numbered, row, text), key, docs.columns)
