"""Ranked lexical search over impact-ordered postings, score at a time.

The index holds blocks of documents.  In a block each term's documents are grouped by their exact impact, that is the
part of a score that frequency and length give, in descending order.  A search takes a
block's groups of all terms of an item by what they add to a score, the largest first, and stops once what is left
can't change which documents are the best; these documents' scores are then completed.  The best of all blocks are
ranked at last, so a term that every document holds is as many short lists as there are blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .arrow import bound_batches, give_back

#: A block of the index holds at most so many documents, and texts of so many bytes (a longer text is a block of its own).
BLOCK_DOCS, BLOCK_BYTES = 16_384, 32 << 20
#: Terms of items that are searched for at once, about; more items are searched for in turns.
AT_ONCE = 200_000
#: Steps in which a block's groups are added up between two looks at the bounds, at most.
LOOKS = 8
#: Index rows that a batch for Spark holds at most, and their postings, about.
_ROWS, _POSTINGS = 2000, 1 << 18

#: What a term is, and the parameters of a score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, SLOPE, LENGTH_PART, WEIGHT_UNIT = 1_000_000_000, 8, 75, 1000

_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_INDEX = "block bigint, term string, impacts array<bigint>, sizes array<int>, docs array<bigint>"


@dataclass(frozen=True)
class Index:
    """Staged postings, with one row of a null term for each block that holds its documents' keys, and the totals."""

    postings: DataFrame
    documents: int
    terms: int
    key: str


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, repeats included."""
    return text.translate(_PLAIN).split()


def lengths(text: Column) -> Column:
    """How many terms a text has; a null one has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("bigint")


def _impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 100 - LENGTH_PART + LENGTH_PART * n * documents // max(terms, 1)
    return UNIT * tf // (1000 * tf + SLOPE * m)


def _cells(block: int, terms: list, impacts: list, sizes: list, docs: pa.Array, cuts: np.ndarray, inner: np.ndarray) -> pa.RecordBatch:
    at = pa.array(inner.astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(impacts, pa.int64())), pa.ListArray.from_arrays(at, pa.array(sizes, pa.int32())), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), docs)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), block)), pa.array(terms, pa.string()), *lists], names=["block", "term", "impacts", "sizes", "docs"])


class _Block:
    """Documents on their way into a block of the index."""

    def __init__(self, documents: int, terms: int):
        self.totals = documents, terms
        self.keys, self.ids, self.term, self.tf, self.many, self.bytes = [], {}, [], [], [], 0
        self.n: list[int] = []

    def add(self, key, text: bytes) -> None:
        counts = Counter(terms_of(text))
        if counts:
            ids = self.ids
            self.term.append(np.fromiter((ids.setdefault(t, len(ids)) for t in counts), np.int32, len(counts)))
            self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
            self.many.append(len(counts))
            self.n.append(int(self.tf[-1].sum()))
            self.keys.append(key)
            self.bytes += len(text)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        n = len(self.keys)
        if not n:
            return
        yield _cells(block, [None], [], [], pa.array(self.keys, pa.int64()), np.array([0, n]), np.zeros(2))
        term, tf, many = np.concatenate(self.term), np.concatenate(self.tf), np.array(self.many)
        doc = np.repeat(np.arange(n), many)
        impact = _impacts(tf, np.repeat(np.array(self.n), many), *self.totals)
        names = list(self.ids)
        order = np.argsort(np.array(names, object), kind="stable") if names else np.zeros(0, np.int64)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        at = np.lexsort((doc, -impact, rank[term]))
        term, impact, doc = rank[term][at], impact[at], doc[at]
        new_term = np.concatenate([[True], term[1:] != term[:-1]])
        groups = np.flatnonzero(new_term | np.concatenate([[True], impact[1:] != impact[:-1]]))
        sizes = np.diff(np.append(groups, len(term)))
        starts = np.append(np.flatnonzero(new_term), len(term))
        first_group = np.append(np.searchsorted(groups, starts[:-1]), len(groups))
        a = 0
        while a < len(names):
            b = min(a + _ROWS, max(a + 1, int(np.searchsorted(starts, starts[a] + _POSTINGS, "right")) - 1), len(names))
            g, h = first_group[a], first_group[b]
            yield _cells(block, [names[i].decode() for i in order[a:b]], impact[groups[g:h]], sizes[g:h], pa.array(doc[starts[a] : starts[b]]), starts[a : b + 1] - starts[a], first_group[a : b + 1] - g)
            a = b


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of the whole texts of ``docs``, staged.

    Texts are read twice: for the totals that an impact needs, by expressions only, and for the postings, which
    each task writes in blocks of its own documents, so nothing is shuffled.  Null and empty texts have no terms and
    no place in it.  Rows that share a key are documents of their own; keys may be null.
    """
    total = docs.select(lengths(F.col(text)).alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, terms = total.docs, total.terms
    bound_batches(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, _Block(documents, terms)
        for batch in batches:
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_buffer()
                if body is None:
                    continue
                if held.keys and held.bytes + body.size > BLOCK_BYTES:
                    yield from held.rows(number)
                    number, held = number + 1, _Block(documents, terms)
                held.add(id_, body.to_pybytes())
                if len(held.keys) >= BLOCK_DOCS:
                    yield from held.rows(number)
                    number, held = number + 1, _Block(documents, terms)
        yield from held.rows(number)
        del held
        give_back()

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("t is not null")
    return Index(staged(rows.mapInArrow(index, _INDEX), "impacts"), documents, terms, key)


def best(k: int, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of which the ``k`` highest scores are some, with these scores, all of them above 0.

    ``groups`` has for each term what its groups add to a score, descending, their sizes, and the documents in turn; ``n``
    is the number of documents.  Ends as soon as bounds prove that no other document reaches the k-th score so far.
    """
    adds, sizes = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])
    docs = np.concatenate([g[2] for g in groups])
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-adds, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    cuts = np.cumsum([0] + [len(g[0]) for g in groups])
    sizes, upto = sizes[order], np.cumsum(sizes[order])
    at = np.repeat(starts[order] - (upto - sizes), sizes) + np.arange(upto[-1])
    docs, values = docs[at], np.repeat(adds[order], sizes)
    score, done = np.zeros(n, np.int64), 0
    for look in range(1, LOOKS + 1):
        cut = len(order) if look == LOOKS else int(np.searchsorted(upto, upto[-1] * look // LOOKS, "right"))  # groups are added whole
        end = int(upto[cut - 1]) if cut else 0
        np.add.at(score, docs[done:end], values[done:end])
        done = end
        if cut == len(order) or n <= k:
            continue
        left = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            next_ = a + int(np.searchsorted(place[a:b], cut))
            left += int(adds[next_]) if next_ < b else 0
        least = int(np.partition(score, n - k)[n - k])
        able = score + left >= least
        if least > 0 and np.count_nonzero(able) <= k:
            rest = able[docs[done:]]
            np.add.at(score, docs[done:][rest], values[done:][rest])
            found = np.flatnonzero(able)
            return found, score[found]
    found = np.flatnonzero(score)
    return found, score[found]


def _search(index: Index, items: DataFrame, k: int) -> DataFrame:
    """(item, doc, score): of each block the ``k`` highest scores of each item; ``items`` (item, term, many) are few enough to send to all tasks."""
    spark = items.sparkSession
    wanted = items.select("term").distinct()
    hits = index.postings.join(F.broadcast(wanted), "term")  # at most about AT_ONCE terms
    df = hits.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(WEIGHT_UNIT * F.log((2.0 * index.documents + 2) / (2.0 * F.col("df") + 1)))
    table = items.join(df, "term").select("item", "term", (F.col("many") * weight).alias("w")).where("w > 0").toArrow().sort_by([("item", "ascending"), ("term", "ascending")])
    names, numbers = table.column("term").to_pylist(), np.asarray(table.column("item").combine_chunks())
    at = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else np.zeros(0, np.int64)
    weights = np.asarray(table.column("w").combine_chunks())
    queries = [(int(numbers[a]), list(zip(names[a:b], weights[a:b].tolist(), strict=True))) for a, b in zip(at.tolist(), np.append(at, len(numbers))[1:].tolist(), strict=True)]
    shared = spark.sparkContext.broadcast(queries)  # as bounded as ``wanted``

    def rank(part: pa.Table) -> pa.Table:
        rows = part.combine_chunks()
        lists = {}
        term = rows.column("term").to_pylist()
        impacts, sizes, docs = (rows.column(c).chunk(0) for c in ("impacts", "sizes", "docs"))
        cut = [np.asarray(c.offsets).astype(np.int64) for c in (impacts, docs)]
        values = [np.asarray(c.values) for c in (impacts, sizes)]
        ids = np.asarray(docs.values.fill_null(0))
        keys = None
        for i, t in enumerate(term):
            if t is None:
                keys = docs[i].values
            else:
                g, d = slice(cut[0][i], cut[0][i + 1]), slice(cut[1][i], cut[1][i + 1])
                lists[t] = (values[0][g], values[1][g].astype(np.int64), ids[d])
        out = [(np.zeros(0, np.int64),) * 3]
        for item, terms in shared.value:
            groups = [(lists[t][0] * w, *lists[t][1:]) for t, w in terms if t in lists]
            if groups:
                found, score = best(k, groups, len(keys))
                if len(found) > k:  # equal scores at the end stay, their keys decide
                    some = score >= np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[some], score[some]
                out.append((np.full(len(found), item), found, score))
        item, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
        doc = keys.take(pa.array(found)) if keys is not None else pa.array([], pa.int64())
        top = pa.table({"item": item, "doc": doc, "score": score}).sort_by([("item", "ascending"), ("score", "descending"), ("doc", "ascending")])
        number = np.asarray(top.column("item").combine_chunks())
        first = np.searchsorted(number, number)
        return top.filter(pa.array(np.arange(len(number)) - first < k))

    some = index.postings.where("term is null").unionByName(hits.select(index.postings.columns))
    return some.groupBy("block").applyInArrow(rank, "item bigint, doc bigint, score bigint")


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, rank (from 1), the index's key and score of the ``k`` highest scores above 0 of each item; equal scores go by key.

    Rows of ``items`` that share a key are one item with all their terms; a null or empty text has none, and an item without
    any document has no row.  Null keys of documents go first among equal scores.  Items whose terms don't go to
    all tasks at once are searched for in several turns.
    """
    terms = F.explode(F.regexp_extract_all(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0)))
    counted = staged(items.select(F.col(key).alias("k"), terms.alias("term")).groupBy("k", "term").agg(F.count(F.lit(1)).alias("many")), "items")
    ids = staged(counted.select("k").distinct().withColumn("item", F.monotonically_increasing_id()), "item-ids")
    rows = staged(counted.join(ids, counted["k"].eqNullSafe(ids["k"])).select("item", "term", "many"), "item-terms")
    turns = max(1, -(-rows.count() // AT_ONCE))
    parts = [_search(index, rows.where(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn) if turns > 1 else rows, k) for turn in range(turns)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(ids, "item").select(F.col("k").alias(key), F.col("rank"), F.col("doc").alias(index.key), "score")
