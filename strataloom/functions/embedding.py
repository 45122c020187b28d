"""Embedding ports: text to unit vectors."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .arrow import bound_batches, give_back

DIMENSION = 384
#: Words that a worker remembers, and places of their trigrams; words of texts that are put together at once.
_WORDS, _PLACES, _AT_ONCE = 100_000, 2_000_000, 100_000


class Words(dict):
    """Numbers of words, and the places and signs of each word and its letter trigrams, one word's after the other's.

    A place is doubled and has the sign as its last bit.  A worker's memory of words: ``trim`` empties it once it is large.
    """

    def __init__(self, dimension: int = DIMENSION) -> None:
        self.dimension = dimension
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.codes, self.ends = array("q"), array("q", [0])

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def _code(self, grams: Iterable[str]) -> np.ndarray:
        hashes = np.fromiter((zlib.crc32(g.encode()) for g in grams), np.int64)
        return hashes % self.dimension << 1 | hashes >> 31

    def learn(self) -> None:
        """Work out the words that are new since the last time, each distinct trigram of theirs once."""
        if not self.fresh:
            return
        marked = [f"^{w}$" for w in self.fresh]
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        inside = np.ones(len(points), bool)  # where a trigram begins: not at a word's last two points
        last = np.cumsum(sizes) - 1
        inside[last] = inside[last - 1] = False
        at = np.flatnonzero(inside)
        # a code point has 21 bits
        grams, which = np.unique(points[at] << 42 | points[at + 1] << 21 | points[at + 2], return_inverse=True)
        trigrams = self._code(chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in grams.tolist())
        sizes -= 1  # the word itself and its trigrams
        ends = np.cumsum(sizes)
        codes, first = np.empty(ends[-1], np.int64), np.zeros(ends[-1], bool)
        first[ends - sizes] = True
        codes[first], codes[~first] = self._code(marked), trigrams[which]
        self.ends.frombytes((ends + len(self.codes)).tobytes())
        self.codes.frombytes(codes.tobytes())
        self.fresh = []

    def trim(self) -> None:
        if len(self) > _WORDS or len(self.codes) > _PLACES:
            self._clear()


def _add(out: np.ndarray, rows: np.ndarray, words: array, known: Words) -> None:
    """Add what the numbers of ``words`` stand for to their ``rows`` (one each word) of ``out``."""
    keys, counts = np.unique(rows * len(known) + np.frombuffer(words, np.int64), return_counts=True)
    row, word = np.divmod(keys, len(known))
    ends = np.frombuffer(known.ends, np.int64)
    starts, sizes = ends[word], ends[word + 1] - ends[word]
    # the codes of each pair of row and word stand together: a place among all is one in the word and where the word starts
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    codes = np.frombuffer(known.codes, np.int64)[at]
    weights = np.where(codes & 1, 1.0, -1.0) * np.repeat(counts, sizes)
    first, dimension = row[0], out.shape[1]
    n = row[-1] - first + 1
    places = np.repeat(row - first, sizes) * dimension + (codes >> 1)
    out[first : first + n] += np.bincount(places, weights, n * dimension).reshape(n, dimension)


def hashed_vectors(texts: list[str | None], dimension: int = DIMENSION, known: Words | None = None) -> np.ndarray:
    """Signed hashing of words and their letter trigrams, normalised; no model is needed.  Zeros for a null or blank text."""
    known = Words(dimension) if known is None else known
    out = np.zeros((len(texts), dimension))
    rows, words = [], array("q")

    def put() -> None:
        nonlocal rows, words
        if words:
            known.learn()
            _add(out, np.repeat(*np.array(rows, np.int64).T), words, known)
            rows, words = [], array("q")
        known.trim()

    for at, text in enumerate(texts):
        split = iter((text or "").lower().split())
        while some := list(islice(split, _AT_ONCE - len(words))):
            words.extend(map(known.__getitem__, some))
            rows.append((at, len(some)))
            if len(words) >= _AT_ONCE:
                put()
    put()
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=out, where=norms > 0).astype(np.float32)


def hashed_vector(text: str | None, dimension: int = DIMENSION) -> list[float]:
    return hashed_vectors([text], dimension)[0].tolist()


def hashed_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """``hashed_vectors`` over Arrow batches.

    A stand-in for a sentence model behind the same interface: any function of the same shape
    may take its place.  Null or blank text gives the zero vector.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Words(dimension)
        for batch in batches:
            yield pd.Series(list(hashed_vectors([t if isinstance(t, str) else None for t in batch], dimension, known)))
        give_back()

    if (spark := SparkSession.getActiveSession()) is not None:
        bound_batches(spark)
    return embed(text)
