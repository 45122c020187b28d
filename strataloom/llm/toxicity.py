"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels.

A sentence's score is a logistic function of its words' weights; a passage of WINDOW sentences is
toxic if any of them is, so its score is 1 minus the product of their complements.  A document's
score is that of its worst passage: a clean sentence's small chance adds up within a passage only,
not with the length of the text.  A word's weight is the sum of the weights of its features: the
word itself, its beginnings and the runs of GRAM bytes in it, so a stem counts under endings never
seen in training.  Training fits the weights to document labels by gradient descent through the
worst passages, on a bounded sample of labelled rows of all lengths, both labels weighing the same;
scoring takes all sentences of all whole texts, and the sentence scores locate what offends.  Only
the text is an input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .arrow import bound_batches, give_back
from .tokens import Places, WordHashes, groups, words_of

#: Labelled rows that training takes of each label at most (the least by a hash), and their characters in all.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 4_000_000
#: Sentences of a passage.
WINDOW = 8
#: Hashed features; beginnings of a word (bytes) that are features, and the length of the runs in it that are.
FEATURES, STEMS, GRAM = 1 << 20, (3, 4, 5, 6, 7), 5
#: Occurrences in documents of the sample that a feature needs, and how training goes.
LEAST_DOCS, ROUNDS, RATE, SHRINK = 5, 120, 0.1, 2e-4
#: Of the rounds so many at first go through whole texts.
START = 60
#: Folds of crc32(key as text); fold 0 is held out.
FOLDS = 5
_END = re.compile(r"[.!?…][^\w]*\Z")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_WORDS = 200_000


def held_out(key: Column) -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class WordFeatures:
    """The features of words: numbers below FEATURES."""

    def __init__(self) -> None:
        self.hashes = WordHashes(seed=20240612)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The features of all ``words`` one after another, and how many each has; an empty word has none."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        some = np.flatnonzero(sizes)
        owner, first, last, kind = [some], [starts[some]], [ends[some]], [np.zeros(len(some), np.uint64)]
        for n in STEMS:
            long = np.flatnonzero(sizes >= n)
            owner.append(long), first.append(starts[long]), last.append(starts[long] + n), kind.append(np.full(len(long), 1, np.uint64))
        many = np.maximum(sizes - GRAM, 0)  # the first run is a beginning already
        of = np.repeat(np.arange(len(words)), many)
        at = starts[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        owner.append(of), first.append(at), last.append(at + GRAM), kind.append(np.full(len(of), 2, np.uint64))
        owner = np.concatenate(owner)
        hashed = self.hashes.of(data, np.concatenate(first), np.concatenate(last)) + np.concatenate(kind) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(owner, kind="stable")
        return ((hashed >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int32)[order], np.bincount(owner, minlength=len(words))


class Sentences:
    """Texts as sentences of words; remembers the words met, and forgets them all beyond a bound unless ``keep``."""

    def __init__(self, keep: bool = False, weights: np.ndarray | None = None) -> None:
        self.hashes, self.features, self.keep, self.weights = WordHashes(), WordFeatures(), keep, weights
        self._forget()

    def _forget(self) -> None:
        self.places, self.n_words, self.ends, self.logits = Places(), 0, np.zeros(1 << 12, bool), np.zeros(1 << 12)
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []  # of all words, if they are kept

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = self.hashes.of(data, starts, ends)
        if self.n_words > _WORDS and not self.keep:
            self._forget()
        numbers = self.places.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            at, text = missing[first], memoryview(data.tobytes())
            words = [bytes(text[a:b]).decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            found, many = self.features.of([_EDGE.sub("", w).lower().encode() for w in words])
            new = np.arange(self.n_words, self.n_words + len(words), dtype=np.int32)
            self.n_words += len(words)
            if self.n_words > len(self.ends):
                self.ends, self.logits = np.resize(self.ends, 2 * self.n_words), np.resize(self.logits, 2 * self.n_words)
            self.ends[new] = np.fromiter((bool(_END.search(w)) for w in words), bool, len(words))
            if self.keep:
                self.lists.append((found, many))
            if self.weights is not None:
                self.logits[new] = np.bincount(np.repeat(np.arange(len(words)), many), self.weights[found], len(words))
            self.places.add(fresh, new)
            numbers[missing] = new[np.searchsorted(fresh, hashes[missing])]
        return numbers

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's number (its logit, given weights) and sentence, each sentence's text, start and end (bytes)."""
        starts, ends = words_of(data, offsets)
        owner = np.searchsorted(offsets, starts, "right") - 1
        out, last = np.zeros(len(starts), np.int32 if self.weights is None else np.float64), np.zeros(len(starts), bool)
        a = 0
        while a < len(starts):  # words of about 1 MB at once
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 20), "right")))
            numbers = self._known(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
            out[a:b], last[a:b] = numbers if self.weights is None else self.logits[numbers], self.ends[numbers]
            a = b
        lines = np.cumsum(data == 10, dtype=np.int32)
        line = lines[starts] if len(starts) else starts
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | last[:-1] | (line[1:] != line[:-1])])[: len(starts)]
        first = np.flatnonzero(new)
        return out, np.cumsum(new) - 1, owner[first], starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(first) else first


@dataclass(frozen=True)
class Model:
    """The features that weigh something, their weights, and the logit of a sentence without any."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def reader(self) -> Sentences:
        weights = np.zeros(FEATURES)
        weights[self.features] = self.weights
        return Sentences(weights=weights)

    def logits(self, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(sentence, words, n)


def _noisy_or(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(-np.bincount(owner, np.logaddexp(0, logits), n))


def _passages(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's passage, and each passage's text; ``owner`` ascends."""
    if not len(owner):
        return owner, owner
    at = (np.arange(len(owner)) - np.searchsorted(owner, owner)) // WINDOW
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])])
    return np.cumsum(new) - 1, owner[new]


def _scores(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The worst passage's noisy-or of each of n texts, 0 without a sentence."""
    passage, of = _passages(owner)
    out = np.zeros(n)
    np.maximum.at(out, of, _noisy_or(logits, passage, len(of)))
    return out


def _constant(share: float) -> Model:
    """The model of labels that are all the same: clean unless all are toxic."""
    return Model(np.zeros(0, np.int32), np.zeros(0), 4.0 if share == 1 else -8.0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit a model to the rows of ``docs`` that ``labels`` (key, 0 or 1) marks, outside the held-out fold.

    Takes at most SAMPLE_ROWS rows of each label, by the least hash of their keys, and of these as many, in
    that order, as have SAMPLE_CHARS characters together (always one), whatever the length of each.  Both labels
    weigh the same.  Of rows that share a key the one of the least text counts, and a key labelled both
    ways is toxic.  Rows with a null key, label or text are left out.  If the sample has rows of one label
    only, everything is scored as that label; without any rows, as clean.  The fit is one task of the bounded sample; only
    the weights come to the driver.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    usable = usable.groupBy("k").agg(F.max("y").alias("y"))
    parts = [usable.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_ROWS) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * SAMPLE_ROWS keys
    some = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("dk"), F.col(text).alias("t"))
    met = some.join(F.broadcast(chosen), F.col("dk") == F.col("k"))
    single = staged(met.groupBy("k", "y").agg(F.min("t").alias("t")), "labelled")  # at most 2 * SAMPLE_ROWS rows
    sizes = single.select("k", "y", F.length("t").cast("bigint").alias("n"), F.xxhash64("k").alias("h"))
    before = Window.partitionBy("y").orderBy("h", "k")
    within = sizes.withColumn("upto", F.sum("n").over(before)).withColumn("at", F.row_number().over(before)).where((F.col("upto") <= SAMPLE_CHARS) | (F.col("at") == 1))
    taken = within.select(F.col("k").alias("tk"))  # at most 2 * SAMPLE_ROWS keys
    sample = single.join(F.broadcast(taken), F.col("k") == F.col("tk")).select(F.xxhash64("k").alias("h"), F.col("k").cast("string").alias("k"), "t", "y")
    bound_batches(docs.sparkSession)
    row = sample.repartition(1).mapInArrow(_learn, "features array<int>, weights array<double>, bias double").first()
    return Model(np.array(row["features"], np.int32), np.array(row["weights"], np.float64), row["bias"]) if row else _constant(0.0)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task, of a bounded sample (h, k, t, y): the model as a row."""
    give_back()
    held = [b for b in batches if b.num_rows]
    sample = pa.Table.from_batches(held).sort_by([("h", "ascending"), ("k", "ascending")]) if held else None
    model = _fitted(sample) if held else _constant(0.0)
    yield pa.RecordBatch.from_arrays([pa.array([model.features.tolist()], pa.list_(pa.int32())), pa.array([model.weights.tolist()], pa.list_(pa.float64())), pa.array([model.bias], pa.float64())], names=["features", "weights", "bias"])
    del held, sample, model
    give_back()


def _fitted(sample: pa.Table) -> Model:
    y = np.asarray(sample.column("y").combine_chunks()).astype(np.float64)
    if len(set(y.tolist())) < 2:
        return _constant(y.mean())
    reader, words, sentences, owners, n = Sentences(keep=True), [], [], [], 0
    for a, _, data, offsets in groups(sample.column("t").combine_chunks(), 1 << 18):
        w, s, o, _, _ = reader.of(data, offsets)
        words.append(w)
        sentences.append((s + n).astype(np.int32))
        owners.append((o + a).astype(np.int32))
        n += len(o)
    words, sentences, owners = np.concatenate(words), np.concatenate(sentences), np.concatenate(owners)
    found, many = (np.concatenate(x) for x in zip(*reader.lists, strict=True)) if reader.lists else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    del reader
    give_back()
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    return fit(words, sentences, owners, found, many, y, weight)


def fit(words: np.ndarray, sentence: np.ndarray, owner: np.ndarray, found: np.ndarray, many: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Adam on the weighted log loss of the worst passages' noisy-or, with weights shrunk towards 0 at each step.

    ``words`` and ``sentence`` hold each word's number and sentence, ``owner`` each sentence's text; word k has the next
    ``many[k]`` of the features ``found``.  Without weights no passage is worse than another, so the first START
    rounds go through whole texts.
    """
    n, vocabulary = len(y), len(many)
    pairs = np.unique(owner[sentence].astype(np.int64) * vocabulary + words)  # a text and a word in it
    in_texts = np.bincount(pairs % max(vocabulary, 1), minlength=vocabulary)
    del pairs
    of_word = np.repeat(np.arange(vocabulary, dtype=np.int32), many)
    often = np.bincount(found, in_texts[of_word], FEATURES) >= LEAST_DOCS
    used = np.flatnonzero(often)
    at = np.full(FEATURES, -1, np.int32)
    at[used] = np.arange(len(used), dtype=np.int32)
    kept = often[found]
    f, of_word = at[found[kept]], of_word[kept]
    del kept, at, often
    # words without any of these weigh nothing
    some = np.zeros(vocabulary, bool)
    some[of_word] = True
    new = np.cumsum(some, dtype=np.int32) - 1
    sentence, words, of_word, vocabulary = sentence[some[words]], new[words[some[words]]], new[of_word], int(some.sum())
    whole = (owner, np.arange(n))
    parts = _passages(owner)
    theta, bias = np.zeros(len(used)), -4.0
    m1, m2, b1, b2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        grad, gb = gradient(theta, bias, words, sentence, owner, f, of_word, vocabulary, whole if t <= START else parts, y, weight)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        step = RATE / (1 - 0.9**t) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        theta = theta - step * m1
        theta = np.sign(theta) * np.maximum(np.abs(theta) - step * SHRINK, 0)
        bias -= RATE * b1 / (1 - 0.9**t) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-8)
    some = np.flatnonzero(theta)
    return Model(used[some].astype(np.int32), theta[some], float(bias))


def gradient(theta: np.ndarray, bias: float, words: np.ndarray, sentence: np.ndarray, owner: np.ndarray, f: np.ndarray, of_word: np.ndarray, vocabulary: int, passages: tuple[np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the mean weighted log loss of each text's worst passage, by the features' weights and the bias."""
    n, m = len(y), len(owner)
    z = bias + np.bincount(sentence, np.bincount(of_word, theta[f], vocabulary)[words], m)
    p = np.exp(-np.logaddexp(0, -z))
    passage, of = passages
    each = _noisy_or(z, passage, len(of))
    first = np.flatnonzero(np.diff(of, prepend=-1))  # each text's first passage
    worst = np.zeros(len(of), bool)
    worst[np.lexsort((-each, of))[first]] = True  # the first of a text's worst passages
    doc = np.zeros(n)
    doc[of[worst]] = each[worst]
    g = np.where(worst[passage], p * (weight * (1 - y / np.clip(doc, 1e-6, 1.0)))[owner] / n, 0.0)
    return np.bincount(f, np.bincount(words, g[sentence], vocabulary)[of_word], len(theta)), float(g.sum())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted, sentences, and the worst sentence's score, start and end (code points) of every whole text.

    A null or empty text has no sentence, scores 0 and has no place.  Repeated rows each give a row, a null
    key is kept (its fold is that of an empty text); an empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            n = batch.num_rows
            scores, many, worst, place = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros((2, n), np.int64)
            for a, b, data, offsets in groups(batch.column(2)):
                f, s, owner, starts, ends = reader.of(data, offsets)
                z = model.logits(f, s, len(owner))
                scores[a:b] = _scores(z, owner, b - a)
                many[a:b] = np.bincount(owner, minlength=b - a)
                full = np.flatnonzero(many[a:b])
                if len(full):
                    first = np.lexsort((np.arange(len(z)), -z, owner))[np.searchsorted(owner, full)]  # the first of a text's worst sentences
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    worst[a + full] = 1 / (1 + np.exp(-z[first]))
                    place[:, a + full] = points[np.stack([starts[first], ends[first]])] - points[offsets[full]]
            scores = np.clip(scores, 0.0, 1.0)
            none = many == 0
            cells = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(many), pa.array(worst), pa.array(place[0], mask=none), pa.array(place[1], mask=none)]
            yield pa.RecordBatch.from_arrays(cells, names=[key, "held_out", "score", "predicted", "sentences", "worst_score", "worst_start", "worst_end"])
        give_back()

    rows = docs.select(key, held_out(F.col(key)).alias("held_out"), text)
    return rows.mapInArrow(rate, f"`{key}` {kind}, held_out boolean, score double, predicted int, sentences bigint, worst_score double, worst_start bigint, worst_end bigint")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end (code points) and score of every sentence that scores ``least`` or more."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            for a, _, data, offsets in groups(batch.column(1)):
                f, s, owner, starts, ends = reader.of(data, offsets)
                p = 1 / (1 + np.exp(-model.logits(f, s, len(owner))))
                bad = np.flatnonzero(p >= least)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = points[offsets[owner[bad]]]
                cells = [batch.column(0).take(pa.array(owner[bad] + a)), pa.array(points[starts[bad]] - base), pa.array(points[ends[bad]] - base), pa.array(p[bad])]
                yield pa.RecordBatch.from_arrays(cells, names=[key, "start", "end", "score"])

    return docs.select(key, text).mapInArrow(locate, f"`{key}` {kind}, start bigint, end bigint, score double")


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under ``least``, all columns as they were."""
    bound_batches(docs.sparkSession)
    names, where = docs.columns, docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, b, data, offsets in groups(batch.column(where)):
                f, s, owner, _, _ = reader.of(data, offsets)
                clean[a:b] = _scores(model.logits(f, s, len(owner)), owner, b - a) < least
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(clean))
        give_back()

    return docs.mapInArrow(keep, docs.schema)
