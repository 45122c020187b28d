"""Candidate pairs of rows that share a key, without listing the pairs of a group or putting a large key into one task.

Rows have a key, an id, a sketch and the group that they are known to be in.  Rows of one key are a candidate
pair if their groups differ and their sketches differ in few places: bits of a long, or half bytes of a
binary of a multiple of 8 bytes.  A binary may end with all the keys of its row, in one order for all rows: then a pair that shares several
keys is a candidate under the first of them alone.  Keys of many rows are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged

#: A group of rows is compared in blocks of BLOCK rows, in larger ones where that would make more than MOST_BLOCKS, and in more blocks where they would be larger than LARGEST.
BLOCK, MOST_BLOCKS, LARGEST = 128, 64, 8192
#: Rows of one key that are compared where they meet; more are dealt out in blocks.
HELD = 4096


#: Bytes of sketches that are compared at once, about.
_AT_ONCE = 1 << 24
_HALF = np.uint64(0x1111111111111111)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    out = []
    for c in names:
        column = batch.column(c)
        wide = pa.types.is_binary(column.type)
        out.append(np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(len(column), -1) if wide else np.asarray(column))
    return out


def _apart(x: np.ndarray, y: np.ndarray, bands: int = 0) -> np.ndarray:
    """In how many places sketches differ; wide ones have a last dimension, of which the last ``bands`` are keys."""
    if x.dtype == np.int64:
        return np.bitwise_count((x ^ y).view(np.uint64))
    words = x.shape[-1] - bands
    z = x[..., :words] ^ y[..., :words]
    z |= z >> np.uint64(1)
    z |= z >> np.uint64(2)
    z &= _HALF
    return np.bitwise_count(z).sum(axis=-1, dtype=np.int64)


def _first(x: np.ndarray, y: np.ndarray, key: np.ndarray, bands: int) -> np.ndarray:
    """Whether ``key`` is the first of the keys that two rows share, row by row; always without ``bands``."""
    if not bands:
        return np.ones(len(x), bool)
    x, y = x[:, -bands:], y[:, -bands:]
    at = (x == y).argmax(axis=1)
    return np.take_along_axis(x, at[:, None], 1)[:, 0].view(np.int64) == key


def _stars(most: int):
    """Sorted by key: candidates (a, b) of each key's first vector and the others of other groups."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, id, sketch and grp of the first row of the last key
        for batch in batches:
            key, id_, sketch, grp = _columns(batch, "key", "id", "sketch", "grp")
            if not len(key):
                continue
            at = np.where(np.concatenate([[last is None or last[0] != key[0]], key[1:] != key[:-1]]), np.arange(len(key)), -1)
            at = np.maximum.accumulate(at)
            old = at < 0
            centre = [np.where(old, last[k] if last else 0, c[at]) for k, c in enumerate((key, id_, sketch, grp))]
            last = tuple(int(c[-1]) for c in centre)
            some = (centre[3] != grp) & (_apart(centre[2], sketch) <= most)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(centre[1], id_)[some]), pa.array(np.maximum(centre[1], id_)[some])], names=["a", "b"])

    return star


def _nearest(key: np.ndarray, g: np.ndarray, h: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The places of the pairs that are the least apart of all of one key and the same two groups."""
    g, h = np.minimum(g, h), np.maximum(g, h)
    order = np.lexsort((apart, h, g, key))
    key, g, h = key[order], g[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    return order[new]


def _block_pairs(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...] | None, most: int, key: int = 0, bands: int = 0, nearest: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Candidates of two blocks (id, sketch, grp) of one key, or within the first: their ids and groups."""
    other = x if y is None else y
    step = max(1, _AT_ONCE // max(1, other[1].nbytes))
    for i in range(0, len(x[0]), step):
        apart = _apart(x[1][i : i + step, None], other[1][None, :], bands)
        near = (apart <= most) & (x[2][i : i + step, None] != other[2][None, :])
        p, q = np.nonzero(near)
        apart = apart[p, q]
        p += i
        if y is None:
            some = p < q
            p, q, apart = p[some], q[some], apart[some]
        if bands:
            # so many pairs' keys at once
            first = [_first(x[1][p[k : k + (1 << 14)]], other[1][q[k : k + (1 << 14)]], key, bands) for k in range(0, len(p), 1 << 14)]
            if first:
                some = np.concatenate(first)
                p, q, apart = p[some], q[some], apart[some]
        if nearest and len(p):
            some = _nearest(np.zeros(len(p), np.int64), x[2][p], other[2][q], apart)
            p, q = p[some], q[some]
        yield x[0][p], other[0][q], x[2][p], other[2][q]


def _ordered(a: np.ndarray, b: np.ndarray, between: pa.Array | None, g: np.ndarray, h: np.ndarray) -> list[pa.Array]:
    """The ids of pairs, the lesser first, and their groups."""
    ends = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
    return [*ends, *([] if between is None else [between]), pa.array(np.where(a < b, g, h)), pa.array(np.where(a < b, h, g))]


def _pairs(most: int, wide: bool, bands: int, nearest: bool):
    """Sorted by key: candidates (a, b) of different groups grp and other, and, with n 1, the rows of keys of more than HELD rows."""
    names = ["n", "a", "b", "sketch", "grp", "other"]

    def cells(a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.binary() if wide else pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), *_ordered(a, b, none, g, h)], names=names)

    def large(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ones(batch.num_rows, np.int32)), *(batch.column(c) for c in ("key", "id", "sketch", "grp")), pa.nulls(batch.num_rows, pa.int64())], names=names)

    def compare(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, id_, sketch, grp = _columns(rows, "key", "id", "sketch", "grp")
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        mixed = np.minimum.reduceat(grp, starts) != np.maximum.reduceat(grp, starts)
        few = np.repeat(mixed & (sizes <= 64), sizes)
        left, met = np.flatnonzero(few), []
        for d in range(1, 64):  # small keys all at once: each row with the d-th one behind it
            left = left[left + d < len(key)]
            left = left[key[left] == key[left + d]]
            if not len(left):
                break
            apart = left[grp[left] != grp[left + d]]
            far = _apart(sketch[apart], sketch[apart + d], bands)
            some, far = apart[far <= most], far[far <= most]
            first = _first(sketch[some], sketch[some + d], key[some], bands)
            if first.any():
                met.append((some[first], some[first] + d, far[first]))
        if met:
            p, q, far = (np.concatenate(c) for c in zip(*met, strict=True))
            if nearest:
                some = _nearest(key[p], grp[p], grp[q], far)
                p, q = p[some], q[some]
            yield cells(id_[p], id_[q], grp[p], grp[q])
        for k in np.flatnonzero(mixed & (sizes > 64)):
            part = slice(starts[k], starts[k] + sizes[k])
            for found in _block_pairs((id_[part], sketch[part], grp[part]), None, most, int(key[starts[k]]), bands, nearest):
                if len(found[0]):
                    yield cells(*found)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key, if not too many
        many, over = 0, None  # over: the key whose rows go on as they are
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("key"))
            if over is not None:
                n = int(np.searchsorted(key, over, "right")) if key[0] == over else 0
                if n:
                    yield large(batch.slice(0, n))
                if n == batch.num_rows:
                    continue
                batch, key, over = batch.slice(n), key[n:], None
            cut = int(np.searchsorted(key, key[-1]))
            if held and held[0].column("key")[0].as_py() != key[0]:
                yield from compare(_joined(held))
                held, many = [], 0
            if cut:
                yield from compare(_joined([*held, batch.slice(0, cut)]))
                held, many = [], 0
            held.append(batch.slice(cut))
            many += batch.num_rows - cut
            if many > HELD:
                over = int(key[-1])
                yield from map(large, held)
                held, many = [], 0
        if held:
            yield from compare(_joined(held))

    return pair


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def deal(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Add block pairs (lo, hi) and side to ``rows``: one pair for small groups, all pairs of blocks for those in ``counts``.

    Each row goes to every pair that its block is in.
    """
    blocks = F.greatest(F.ceil(F.col("n") / LARGEST), F.least(F.ceil(F.col("n") / BLOCK), F.lit(MOST_BLOCKS))).cast("int")
    big = staged(counts.where(F.col("n") > BLOCK).select(F.col(key).alias("big"), blocks.alias("blocks")), "blocks")
    few = big.count() <= 100_000
    joined = rows.join(F.broadcast(big) if few else big, F.col(key) == F.col("big"), "left")
    mine = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    each = joined.withColumn("mine", mine).withColumn("other", other)
    return each.select(*rows.columns, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).alias("side"))


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole groups of rows sorted by ``by``; a group may span input batches."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        return [b for b in pa.Table.from_batches(parts).combine_chunks().to_batches() if b.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in by])
        last = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        goes_on = not held or all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in by)
        if not goes_on:
            yield from joined(held)
            held = []
        if cut:
            yield from joined([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from joined(held)


def runs(batch: pa.RecordBatch, by: list[str]) -> list[tuple[int, int]]:
    ids = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in by])
    edges = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(axis=0)]))
    return list(zip(edges.tolist(), np.append(edges[1:], batch.num_rows).tolist(), strict=True))


def _large_pairs(rows: DataFrame, most: int, bands: int, nearest: bool) -> DataFrame:
    """Candidates (a, b, grp, other) of rows (key, id, sketch, grp) of keys with many, by block pairs in different tasks."""
    by = ["key", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, by):
            key, id_, sketch, grp, lo, hi = _columns(batch, "key", "id", "sketch", "grp", "lo", "hi")
            side = batch.column("side").to_numpy(zero_copy_only=False)
            for a, b in runs(batch, by):
                x, s = tuple(c[a:b] for c in (id_, sketch, grp)), side[a:b]
                same = lo[a] == hi[a]
                for p, q, g, h in _block_pairs(tuple(c[~s] for c in x), None if same else tuple(c[s] for c in x), most, int(key[a]), bands, nearest):
                    yield pa.RecordBatch.from_arrays(_ordered(p, q, None, g, h), names=["a", "b", "grp", "other"])

    dealt = deal(rows, rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a bigint, b bigint, grp bigint, other bigint")


def candidate_pairs(keyed: DataFrame, most: int, bands: int = 0, groups: bool = False, nearest: bool = False) -> DataFrame:
    """The candidates (a, b), a < b, of ``keyed`` (key, id, sketch, grp), staged and each once; the last ``bands`` longs of sketches are keys.

    With ``groups`` also their groups (ga, gb).  With ``nearest`` of a key's candidates between the same two groups only the
    least apart, or one a block pair of a large key.
    """
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    kind = keyed.schema["sketch"].dataType.simpleString()
    met = staged(dealt.mapInArrow(_pairs(most, kind == "binary", bands, nearest), f"n int, a bigint, b bigint, sketch {kind}, grp bigint, other bigint"), "met")
    large = met.where("n = 1").select(F.col("a").alias("key"), F.col("b").alias("id"), "sketch", "grp")
    pairs = met.where("n = 0").select("a", "b", "grp", "other")
    if not large.isEmpty():
        pairs = pairs.unionByName(_large_pairs(large, most, bands, nearest))
    found = pairs.select("a", "b", F.col("grp").alias("ga"), F.col("other").alias("gb")) if groups else pairs.select("a", "b")
    out = staged(found.distinct(), "pairs")
    discard(met)
    return out


def candidate_stars(keyed: DataFrame, most: int) -> DataFrame:
    """The candidates among each key's first row, by id, and the others, staged and each once."""
    dealt = keyed.repartition("key").sortWithinPartitions("key", "id")
    return staged(dealt.mapInArrow(_stars(most), "a bigint, b bigint").distinct(), "pairs")
