"""Token ids on disk under a Re-Pair grammar, with random access.

The store is a Parquet dataset; a row is a shard of about ``BLOCK`` ids of
documents in ascending doc_id order.  In each shard, frequent pairs of
neighbouring symbols are replaced by new symbols again and again; the shard
keeps the rules, the number of ids that each rule stands for, and the rest
of the sequence.  Parquet commits all files or none and any worker can read any shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import bound_batches
from .tokens import encode_batches

#: Ids in a shard before it is closed; a longer document makes a longer shard.
BLOCK = 1 << 20
#: A round replaces all pairs that occur at least 1/STEP as often as its most frequent pair, down to LEAST times.
STEP, LEAST = 4, 8
#: Rounds at LEAST go on while one shortens the sequence by 1/GAIN.
GAIN = 25
_BITS = 21  # of a symbol: vocabulary and rules

SHARD = (
    "part int, shard int, first_id bigint, n_ids bigint, end_id int, terminals int, doc_ids array<bigint>, doc_sizes array<int>, doc_symbols array<int>, "
    "rules binary, rule_sizes binary, symbols binary"
)


def repair(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence left and the rules, pairs of symbols; rule k is symbol ``terminals`` + k.

    Pairs never hold the last terminal, which marks the ends of documents, so every
    document begins at a symbol.  Where chosen pairs overlap, the more frequent one wins and
    then the left one.
    """
    seq, rules, top = ids.astype(np.int64), [], None
    while len(seq) > 1:
        keys = (seq[:-1] << _BITS) | seq[1:]
        ends = seq == terminals - 1
        free = ~(ends[:-1] | ends[1:])
        ordered = np.sort(keys[free])
        if not len(ordered):
            break
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(edges, len(ordered)))
        top = int(counts.max()) if top is None else min(top, int(counts.max()))
        least = max(LEAST, -(-top // STEP))
        top = max(least - 1, LEAST)
        often, before = np.flatnonzero(counts >= least), len(seq)
        room = (1 << _BITS) - terminals - sum(map(len, rules))
        often = often[np.lexsort((ordered[edges[often]], -counts[often]))][:room]
        if len(often):
            chosen = ordered[edges[often]]
            bits = max(8, int(4 * len(chosen)).bit_length())
            spread = lambda k: ((k * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            table, numbers = np.full(1 << bits, -1, np.int64), np.full(1 << bits, len(chosen), np.int32)
            place = spread(chosen)[::-1]  # the more frequent of two at one place is written last
            table[place], numbers[place] = chosen[::-1], np.arange(len(chosen), dtype=np.int32)[::-1]
            at = spread(keys)
            rank = np.where((table[at] == keys) & free, numbers[at], len(chosen))
            padded = np.concatenate([[len(chosen)], rank, [len(chosen)]])
            taken = (rank < len(chosen)) & (rank < padded[:-2]) & (rank <= padded[2:])
            uses = np.bincount(rank[taken], minlength=len(chosen) + 1)[:-1]
            good = uses >= 3
            taken &= np.append(good, False)[rank]
            new = np.cumsum(good) - 1 + terminals + sum(map(len, rules))
            where = np.flatnonzero(taken)
            seq[where] = new[rank[where]]
            kept = np.ones(len(seq), bool)
            kept[where + 1] = False
            seq = seq[kept]
            rules.append(np.stack([chosen[good] >> _BITS, chosen[good] & ((1 << _BITS) - 1)], 1))
        if least == LEAST and before - len(seq) <= before // GAIN:
            break
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def rule_sizes(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for."""
    sizes = [1] * 0
    for a, b in rules.tolist():
        sizes.append((1 if a < terminals else sizes[a - terminals]) + (1 if b < terminals else sizes[b - terminals]))
    return np.array(sizes, np.int64)


def _packed(symbols: np.ndarray) -> bytes:
    """24 bits a symbol, the high bytes apart since they hardly vary."""
    return symbols.astype("<u2").tobytes() + (symbols >> 16).astype(np.uint8).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data, "<u2", n).astype(np.int64) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int64) << 16


class Grammar:
    """Expansion of symbols to ids."""

    def __init__(self, rules: bytes, sizes: bytes, terminals: int):
        pairs = _unpacked(rules).reshape(2, -1).T
        self.sizes = np.concatenate([np.ones(terminals, np.int64), np.frombuffer(sizes, "<u4").astype(np.int64)])
        own = self.sizes[terminals:]
        self.starts = np.concatenate([np.arange(terminals), terminals + np.cumsum(own) - own])
        self.pool = np.concatenate([np.arange(terminals, dtype=np.uint32), np.zeros(int(own.sum()), np.uint32)])
        pool, starts, all_sizes = self.pool, self.starts.tolist(), self.sizes.tolist()
        for k, (a, b) in enumerate(pairs.tolist(), terminals):
            s, m = starts[k], all_sizes[a]
            pool[s : s + m] = pool[starts[a] : starts[a] + m]
            pool[s + m : s + all_sizes[k]] = pool[starts[b] : starts[b] + all_sizes[b]]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.sizes[symbols]
        first = np.cumsum(sizes) - sizes
        return self.pool[np.arange(int(sizes.sum())) + np.repeat(self.starts[symbols] - first, sizes)]

    def slice(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the sequence; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.sizes[symbols])
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before : stop - before]


def encode_shard(ids: np.ndarray, sizes: np.ndarray) -> dict:
    """The grammar of one shard of documents of ``sizes`` ids, as columns.

    A document's last id, the same for all, becomes the mark ``terminals`` - 1.
    """
    terminals = int(ids.max()) + 2
    marked = ids.copy()
    marked[np.cumsum(sizes) - 1] = terminals - 1
    symbols, rules = repair(marked, terminals)
    stops = np.flatnonzero(symbols == terminals - 1) + 1
    return {
        "terminals": terminals, "rules": _packed(rules.T.ravel()), "rule_sizes": rule_sizes(rules, terminals).astype("<u4").tobytes(),
        "symbols": _packed(symbols), "doc_symbols": np.diff(stops, prepend=0).astype(np.int32),
    }


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Tokenize ``docs`` (doc_id, text) and write the store at ``path``.

    Documents lie in ascending doc_id order, null first; rows with the same
    doc_id by a hash of their texts.  A null text is empty.  Each document is followed by
    ``end_id``.  An empty table gives an empty store.
    """
    bound_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        names, rows, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal shard, first, names, rows, sizes, held
            made = encode_shard(np.concatenate(rows), np.concatenate(sizes))
            cells = {
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "first_id": pa.array([first]), "n_ids": pa.array([held]),
                "end_id": pa.array([end_id], pa.int32()), "terminals": pa.array([made["terminals"]], pa.int32()),
                "doc_ids": pa.array([[x for n in names for x in n.to_pylist()]], pa.list_(pa.int64())), "doc_sizes": pa.array([np.concatenate(sizes).astype(np.int32)], pa.list_(pa.int32())),
                "doc_symbols": pa.array([made["doc_symbols"]], pa.list_(pa.int32())), "rules": pa.array([made["rules"]], pa.binary()), "rule_sizes": pa.array([made["rule_sizes"]], pa.binary()),
                "symbols": pa.array([made["symbols"]], pa.binary()),
            }
            shard, first, names, rows, sizes, held = shard + 1, first + held, [], [], [], 0
            return pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))

        for batch, ids, bounds in encode_batches(batches, tokenizer, end_id):
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK - held, "right")) - 1)
                names.append(batch.column("doc_id").slice(a, b - a))
                rows.append(ids[bounds[a] : bounds[b]])
                sizes.append(np.diff(bounds[a : b + 1]))
                held += int(bounds[b] - bounds[a])
                if held >= BLOCK or b < batch.num_rows:
                    yield close()
                a = b
        if held:
            yield close()

    by = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(*by).sortWithinPartitions(*by)
    ordered.mapInArrow(encode, SHARD).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, their ids.

    ``start`` counts the ids of all documents before: a part's total is one number,
    so the sums in front run over one row a part.
    """
    bound_batches(spark)
    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("bigint").alias("part_start"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name: batch.column(name)[r].as_py()  # noqa: B023, E731
                ids = Grammar(cell("rules"), cell("rule_sizes"), cell("terminals")).expand(_unpacked(cell("symbols")))
                ends = ids == cell("terminals") - 1
                ids[ends] = cell("end_id")
                stops = np.flatnonzero(ends) + 1
                starts = np.concatenate([[0], stops[:-1]])
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                columns = [batch.column("doc_ids")[r].values, pa.array(starts + cell("part_start") + cell("first_id")), pa.array(stops - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return shards.join(F.broadcast(starts), "part").mapInArrow(decode, schema)


def read_document(row, number: int) -> np.ndarray:
    """Ids of one document of a shard row, without expanding the others."""
    grammar, symbols = Grammar(bytes(row["rules"]), bytes(row["rule_sizes"]), row["terminals"]), _unpacked(bytes(row["symbols"]))
    first = sum(row["doc_symbols"][:number])
    ids = grammar.expand(symbols[first : first + row["doc_symbols"][number]])
    ids[-1] = row["end_id"]
    return ids
