"""Packing documents into sequences: shortest-pack-first over the length histogram.

Only the histogram of piece lengths, at most ``capacity`` numbers, comes to
the driver.  Lengths are placed longest first; each count goes to the packs
with most room, so what is kept is a list of packing patterns and how many
sequences follow each.  A piece finds its place by its rank among the pieces
of its length: ranks are dealt to the patterns in turn.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .arrow import bound_batches
from .ranks import gapless_rank
from .tokens import encode_batches


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns for the lengths in ``counts``: (how many sequences, ((length, times), ...)).

    Shortest pack first: each length, longest first, goes into the packs with
    the most room left; if it doesn't fit there it opens new packs.
    """
    room: list[tuple[int, int]] = []  # heap of (-room, number of its group)
    groups: list[tuple[int, dict[int, int]]] = []

    def put(n: int, items: dict[int, int], left: int) -> None:
        groups.append((n, items))
        heapq.heappush(room, (-left, len(groups) - 1))

    done: list[tuple[int, dict[int, int]]] = []
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1 to {capacity}")
        todo = counts[length]
        while todo:
            if not room or -room[0][0] < length:
                each = 1
                if not room or length * 2 <= capacity:  # fresh packs take several of one length at once
                    each = min(todo, max(1, capacity // length))
                n = todo // each
                put(n, {length: each}, capacity - each * length)
                todo -= n * each
                continue
            left, k = heapq.heappop(room)
            n, items = groups[k]
            used = min(n, todo)
            if used < n:
                put(n - used, items, -left)
            put(used, items | {length: items.get(length, 0) + 1}, -left - length)
            todo -= used
    return [(groups[k][0], tuple(groups[k][1].items())) for _, k in sorted(room, key=lambda x: x[1])] + [(n, tuple(i.items())) for n, i in done]


@dataclass(frozen=True)
class Places:
    """The patterns as sorted ranges of ranks of each length."""

    keys: np.ndarray  # length << 44 | first rank
    repeats: np.ndarray  # sequences of the pattern
    sequences: np.ndarray  # the first of them
    offsets: np.ndarray  # where this length starts in the pattern

    @staticmethod
    def of(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> Places:
        rows, rank, first = [], {}, 0
        for n, items in patterns:
            offset = 0
            for length, times in items:
                at = rank.get(length, 0)
                rows.append((length << 44 | at, n, first, offset))
                rank[length] = at + n * times
                offset += length * times
            first += n
        return Places(*np.array(sorted(rows), np.int64).reshape(-1, 4).T)

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, lengths << 44 | ranks, "right") - 1
        i = ranks - (self.keys[k] & ((1 << 44) - 1))
        return self.sequences[k] + i % self.repeats[k], self.offsets[k] + i // self.repeats[k] * lengths


def pack(pieces: DataFrame, order: list[str], capacity: int, length: str = "length") -> DataFrame:
    """Add sequence_id and offset to ``pieces``, whose ``length`` is 1 to ``capacity``.

    Pieces of a length are interchangeable; ``order`` ranks them, so the result
    doesn't depend on the partitioning.  ``pieces`` is read several times.  An empty table gives
    an empty table; repeated rows are packed each; a length outside 1 to
    ``capacity`` or null is an error.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    places = Places.of(pack_histogram(counts, capacity))
    ranked = gapless_rank(pieces, length, order, "__rank")
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    keep = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(np.asarray(batch.column(length)).astype(np.int64), np.asarray(batch.column("__rank")).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, ``end_id`` behind them, every ``capacity`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens and, if asked for,
    the ids themselves.  A null or empty text is ``end_id`` alone.  Only
    ``doc_id`` and ``text`` of ``docs`` are read.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, bounds in encode_batches(batches, tokenizer, end_id):
            totals = np.diff(bounds)
            many = -(-totals // capacity)
            owner = np.repeat(np.arange(len(totals)), many)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * capacity
            length = np.minimum(capacity, totals[owner] - start)
            view, at = memoryview(ids.tobytes()), bounds[owner] + start
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(owner))
            out = [batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crc), pa.array(totals[owner])]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(at, bounds[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` ids; a row per piece.

    A document longer than ``capacity`` is cut into full sequences and a rest.
    ``offset`` is the piece's place in ``sequence_id``, gapless from 0.  Nulls:
    a null text is empty (one ``end_id``); a null doc_id is kept.  Repeated rows are
    packed each.  Other columns of ``docs`` are ignored.
    """
    return pack(staged(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), ["doc_id", "start", "ids_crc32"], capacity)
