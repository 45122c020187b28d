"""Spelling variants: a self-join of the vocabulary's trie with sets of active nodes, for words at distance one.

The upper part of the trie, down to prefixes that few enough words share, goes to all tasks; below each such prefix
lies a partition of the trie.  A word's active nodes in the upper part, those within one edit of what
it begins with, lead it to the partitions where a near word may lie; there the rest of it has to match.  Inside a
partition pairs of active nodes go down the trie together, level by level.  Every pair of near words is born at one
node, that of their longest common prefix, so it is found once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged
from .arrow import bound_batches, give_back

#: A partition of the trie holds at most so many words, or a 20,000th of the vocabulary, so the prefixes that go to all tasks are bounded.
LEAF_WORDS, MOST_LEAVES = 10_000, 20_000
#: Words that come to a partition from others are dealt into so many parts, and its own words go to each.
PARTS = 8
#: A table of at most so many rows (two words each) is broadcast.
BROADCAST_ROWS = 100_000

#: Fixed value: what a word is made of.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_PAIR = "word string, n bigint, near string, near_n bigint"


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, slip: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n (occurrences) of the letter runs of whole texts, A-Z in lower case, that are long and frequent enough.

    With ``slip``, a run whose crc32 with its document's key is divisible by it loses one letter first, as a typing slip would;
    a null key counts as an empty one.  Null and empty texts have no words; repeated rows count again.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("k", F.translate("run", _UPPER, _UPPER.lower()).alias("word"))
    if slip:
        hashed = words.select("word", F.crc32(F.concat("k", F.lit(":"), "word").cast("binary")).alias("h"))
        cut = F.overlay("word", F.lit(""), (F.col("h") % F.length("word") + 1).cast("int"), F.lit(1))
        words = hashed.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def prefixes(words: DataFrame) -> dict[str, int]:
    """The prefixes of the trie's partitions and how many of ``words`` (each with a 0 behind it) begin with each.

    A prefix with too many words is replaced by its extensions, behind the longest prefix that all its words share, so
    each round branches.  Only prefixes and counts come here, as many as partitions.
    """
    total = words.count()
    most, done, open_ = max(LEAF_WORDS, total // MOST_LEAVES), {}, {"": 0}
    while open_ and total:
        depths = sorted({(p, d) for p, d in open_.items()})
        rows = words.select((F.concat("word", F.lit("\0"))).alias("w"))
        found = None
        for d in sorted({d for _, d in depths}):  # one pass for each length of open prefixes
            some = [p for p, x in depths if x == d]
            part = rows.where(F.substring("w", 1, d).isin(some)) if d else rows
            part = part.groupBy(F.substring("w", 1, d + 1).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("low"), F.max("w").alias("high"))
            found = part if found is None else found.unionByName(part)
        open_ = {}
        for r in found.select("p", "n", F.when(F.col("n") > most, F.struct("low", "high")).alias("ends")).collect():
            if r.ends is None:
                done[r.p] = r.n
            else:
                shared = _common(r.ends.low, r.ends.high)
                open_[r.ends.low[:shared]] = shared
    return done


class Upper:
    """The trie of the partitions' prefixes."""

    def __init__(self, leaves: dict[str, int]):
        self.root, self.size, self.depth = {}, leaves, max(map(len, leaves), default=0)
        for p in leaves:
            node = self.root
            for c in p[:-1]:
                node = node.setdefault(c, {})
            if p:
                node[p[-1]] = p  # a partition
            else:
                self.root = p
        self.seen: dict[str, tuple[str, list[tuple[str, int]]]] = {}

    @staticmethod
    def _down(node, rest: str, j: int) -> tuple[str, int] | None:
        """The partition that ``rest`` from its place j leads to below ``node``, and the place behind its prefix."""
        while isinstance(node, dict):
            if j >= len(rest):
                return None
            node = node.get(rest[j])
            j += 1
        return None if node is None else (node, j)

    def reach(self, word: str) -> tuple[str, list[tuple[str, int]]]:
        """The own partition of ``word`` (with its 0), and the others in which words at distance one may lie, larger ones only, with the place from which the rest of the word must match."""
        start = word[: self.depth + 2]
        if start not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[start] = self._reach(start)
        return self.seen[start]

    def _reach(self, w: str) -> tuple[str, list[tuple[str, int]]]:
        node, k, found = self.root, 0, []
        while isinstance(node, dict):
            c = w[k]
            for other, child in node.items():
                if other != c and other != "\0":
                    if c != "\0":
                        found.append(self._down(child, w, k + 1))  # another letter
                    found.append(self._down(child, w, k))  # one more letter
            if c != "\0" and w[k + 1] != c:
                found.append(self._down(node, w, k + 1))  # one letter less
            node, k = node[c], k + 1
        own = (self.size[node], node)
        return node, [x for x in found if x and (self.size[x[0]], x[0]) > own]


class _Tails:
    """Whether the rests of words are equal."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.ends = np.cumsum(np.array([len(w) for w in words], np.int64))
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        self.data = np.frombuffer(b"".join(words), np.uint8)
        base = 0x9E3779B97F4A7C15
        n = len(self.data)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:n])])

    def equal(self, a: np.ndarray, at: int, b: np.ndarray, bt: int) -> np.ndarray:
        """Places where word a from ``at`` on equals word b from ``bt`` on."""
        x, y, p, q = self.starts[a] + at, self.starts[b] + bt, self.ends[a], self.ends[b]
        some = np.flatnonzero(p - x == q - y)
        x, y, p, q = x[some], y[some], p[some], q[some]
        some = some[(self.sums[p] - self.sums[x]) * self.inverse[x] == (self.sums[q] - self.sums[y]) * self.inverse[y]]
        return np.array([i for i in some.tolist() if self.words[a[i]][at:] == self.words[b[i]][bt:]], np.int64)


def _shared(a: bytes, b: bytes, start: int) -> int:
    """How many bytes from ``start`` on two words have in common."""
    n = min(len(a), len(b)) - start
    other = np.flatnonzero(np.frombuffer(a, np.uint8, n, start) != np.frombuffer(b, np.uint8, n, start))
    return int(other[0]) if len(other) else n


def _children(tails: _Tails, lo: np.ndarray, hi: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi, letter and parent of the children of nodes (ranges of sorted words) at ``depth``."""
    sizes = hi - lo
    parent = np.repeat(np.arange(len(lo)), sizes)
    word = np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
    letter = tails.data[tails.starts[word] + depth].astype(np.int64)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), bool), (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])]))
    last = np.append(first[1:], len(word)) - 1 if len(first) else first
    return word[first], word[last] + 1, letter[first], parent[first]


def _matched(a: np.ndarray, b: np.ndarray, of_a: tuple[np.ndarray, ...], of_b: tuple[np.ndarray, ...], n_a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of nodes: the children of a and of b with the same letter, and which pair they are of; tables of children by parent."""
    many = np.bincount(of_a[3], minlength=n_a)
    start = np.cumsum(many) - many
    count = many[a]
    pair = np.repeat(np.arange(len(a)), count)
    child = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[a], count)
    keys, wanted = of_b[3] * 256 + of_b[2], b[pair] * 256 + of_a[2][child]
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    some = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return child[some], at[some], pair[some]


def near_words(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs, by their places, of the sorted distinct ``words`` at distance one; each ends in its only 0 and all have their first ``depth`` bytes in common.

    Active pairs of nodes are those at distance one: of one depth, after a letter was replaced, or the first one
    level deeper, after it was left out.  From there on letters have to be the same.  A node of one word is
    compared at once, with another such node's word or with the word that the other node would have to hold, so levels go on
    only as far as words share a prefix; stretches without a branch are passed over.
    """
    tails, index = _Tails(words), {w: i for i, w in enumerate(words)}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lo, hi = np.zeros(1, np.int64), np.full(1, len(words))
    kids = _children(tails, lo, hi, depth)
    none = np.zeros(0, np.int64)
    same, less = (none, none), (none, none)  # places in the nodes; in kids and in the nodes

    def sift(a: np.ndarray, b: np.ndarray, of_a: tuple[np.ndarray, ...], of_b: tuple[np.ndarray, ...], at: int, bt: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out pairs that are words at their ends and pairs of single words; the others are left."""
        ends = of_a[2][a] == 0
        found.append((of_a[0][a[ends]], of_b[0][b[ends]]))
        a, b = a[~ends], b[~ends]
        alone_a, alone_b = of_a[1][a] - of_a[0][a] == 1, of_b[1][b] - of_b[0][b] == 1
        u, v = of_a[0][a], of_b[0][b]  # words, the only ones or the first
        both = alone_a & alone_b
        equal = tails.equal(u[both], at, v[both], bt)
        found.append((u[both][equal], v[both][equal]))
        for one, other, p, q, some in ((u, v, at, bt, alone_a & ~alone_b), (v, u, bt, at, alone_b & ~alone_a)):
            pairs = [(i, index.get(words[j][:q] + words[i][p:])) for i, j in zip(one[some].tolist(), other[some].tolist(), strict=True)]
            pairs = np.array([x for x in pairs if x[1] is not None], np.int64).reshape(-1, 2)
            found.append((pairs[:, 0], pairs[:, 1]))
        rest = ~(alone_a | alone_b)
        return a[rest], b[rest]

    while len(lo):
        if len(lo) <= 16 and not len(same[0]) and not len(less[0]):
            skip = min(_shared(words[i], words[j - 1], depth) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)) - 1
            if skip > 0:
                depth += skip
                kids = _children(tails, lo, hi, depth)
        n = len(lo)
        # children of one depth
        x, y, _ = _matched(*same, kids, kids, n)
        one = sift(x, y, kids, kids, depth + 1, depth + 1)
        many = np.bincount(kids[3], minlength=n)
        start = np.cumsum(many) - many
        place = np.arange(len(kids[3])) - start[kids[3]]
        rest = many[kids[3]] - place - 1
        first = np.repeat(np.arange(len(rest)), rest)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(rest) - rest, rest)
        letters = (kids[2][first] != 0) & (kids[2][second] != 0)
        two = sift(first[letters], second[letters], kids, kids, depth + 1, depth + 1)
        same = tuple(np.concatenate(p) for p in zip(one, two, strict=True))
        # one level deeper
        inner = np.flatnonzero(kids[2] != 0)
        deep = _children(tails, kids[0][inner], kids[1][inner], depth + 1)
        deep = (*deep[:3], inner[deep[3]])
        x, y, _ = _matched(*less, deep, kids, len(kids[3]))
        one = sift(x, y, deep, kids, depth + 2, depth + 1)
        left_out = inner[many[kids[3][inner]] > 1]
        x, y, pair = _matched(left_out, kids[3][left_out], deep, kids, len(kids[3]))
        other = y != left_out[pair]
        two = sift(x[other], y[other], deep, kids, depth + 2, depth + 1)
        less = tuple(np.concatenate(p) for p in zip(one, two, strict=True))
        stay = kids[1] - kids[0] > 1  # all nodes in active pairs are such
        new = np.cumsum(stay) - 1
        kept = stay[deep[3]]
        deeper = np.cumsum(kept) - 1
        same, less = (new[same[0]], new[same[1]]), (deeper[less[0]], new[less[1]])
        lo, hi = kids[0][stay], kids[1][stay]
        kids = (*(c[kept] for c in deep[:3]), new[deep[3][kept]])
        depth += 1
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near and near_n of all pairs of ``words`` (word, n) at distance one, both ways; words are distinct and in Latin-1 without 0."""
    leaves = prefixes(words)
    names = sorted(leaves)
    number = {p: i for i, p in enumerate(names)}
    bound_batches(words.sparkSession)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = Upper(leaves)
        for batch in batches:
            leaf, part, row, at = [], [], [], []
            for i, w in enumerate(batch.column("word").to_pylist()):
                own, others = upper.reach(w + "\0")
                leaf += [number[own]] * PARTS
                part += range(PARTS)
                row += [i] * PARTS
                at += [-1] * PARTS
                mine = zlib.crc32(w.encode("latin-1")) % PARTS
                for p, j in others:
                    leaf.append(number[p])
                    part.append(mine)
                    row.append(i)
                    at.append(j)
            places = pa.array(row, pa.int32())
            cells = [pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), batch.column("word").take(places), batch.column("n").take(places), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(cells, names=["leaf", "part", "word", "n", "at"])
        give_back()

    def join(part: pa.Table) -> pa.Table:
        part = part.sort_by([("at", "ascending"), ("word", "ascending")]).combine_chunks()
        at = np.asarray(part.column("at").combine_chunks())
        own = int(np.searchsorted(at, 0))
        strings, n = part.column("word").combine_chunks(), np.asarray(part.column("n").combine_chunks())
        words = [w.encode("latin-1") + b"\0" for w in strings.to_pylist()]
        prefix, first = names[part.column("leaf")[0].as_py()], part.column("part")[0].as_py() == 0
        depth = len(prefix)
        # pairs inside the partition are one part's work; a prefix that is a whole word has no others
        a, b = near_words(words[:own], depth) if first and own > 1 and not prefix.endswith("\0") else (np.zeros(0, np.int64),) * 2
        rest = {w[depth:]: i for i, w in enumerate(words[:own])}
        met = [(i, rest.get(words[i][j:])) for i, j in zip(range(own, len(words)), at[own:].tolist(), strict=True)]
        met = np.array([p for p in met if p[1] is not None], np.int64).reshape(-1, 2)
        a, b = np.concatenate([a, met[:, 0]]), np.concatenate([b, met[:, 1]])
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.table([strings.take(pa.array(a)), pa.array(n[a]), strings.take(pa.array(b)), pa.array(n[b])], names=["word", "n", "near", "near_n"])

    routed = words.select("word", "n").mapInArrow(route, "leaf int, part int, word string, n bigint, at int")
    return routed.groupBy("leaf", "part").applyInArrow(join, _PAIR)


def _roots(links: DataFrame) -> DataFrame:
    """word and root of the words of ``links`` (word, form): the last one that forms lead to, by doubling of steps."""
    now = staged(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        new = staged(now.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = new.select("word", "root")
        now._staged_at = new._staged_at
        if new.where("moved").isEmpty():
            return now


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of ``words`` (word, n).

    n_near counts the words at distance one (one letter more, less or another); form is the most frequent of
    these (ties: the smallest in code-point order) if it occurs at least ``ratio`` times as often, with its n as form_n, else both are null;
    root is where forms lead from the word, itself without one.  An empty table gives an empty one.
    """
    words = staged(words.select("word", "n"), "vocabulary")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("f"))).alias("best"))
    near = near.withColumnRenamed("word", "w")
    enough = -F.col("best.m") >= ratio * F.col("n")
    rows = words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", F.when(enough, F.col("best.f")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, -F.col("best.m")).alias("form_n")
    )
    rows = staged(rows, "forms")
    # only forms that have forms themselves need more than a step
    forms = rows.where("form is not null").select(F.col("form").alias("f")).distinct()
    inner = rows.where("form is not null").join(forms, F.col("word") == F.col("f"), "left_semi").select("word", "form")
    roots = _roots(inner).select(F.col("word").alias("via"), F.col("root").alias("last"))
    few = roots.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(roots) if few else roots, F.col("form") == F.col("via"), "left")
    return joined.select("word", "form", F.coalesce("last", "form", "word").alias("root"), "n", "n_near", "form_n")
