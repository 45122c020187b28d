"""Token ids of whole texts, a batch at a time, through the tokenizers library.

The tokenizer (``word_bpe_49k.json``) drops white space, lowers the case and cuts texts into pieces - runs of
letters, single digits, runs of other signs - that never merge.  So the ids of a text are the ids
of its pieces in turn.  Texts repeat most of their pieces; each distinct one goes through
the library once a worker, and the texts are put together from these with
array operations.  Words that hold anything but Latin-1 letters, ASCII digits and plain signs go through it whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .arrow import give_back

#: A worker forgets its pieces when it holds so many, or so many of their ids.
MAX_WORDS, MAX_POOL = 700_000, 3 << 20
#: Texts are cut at white space into segments of about so many bytes while pieces are found; new ones are learnt so many at once.
SEGMENT, LEARN = 1 << 20, 1 << 14
#: Longer byte ranges are hashed one by one: sums of powers are too regular for them.
LONG = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Kinds of bytes.
_NONE, _LETTER, _DIGIT, _SIGN, _OTHER = 0, 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _OTHER  # an apostrophe may begin a piece with letters
_KIND[_SPACE] = _NONE


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordHashes:
    """64-bit hashes of byte ranges: sums of random values of the bytes times powers of an odd number; XXH3 beyond LONG bytes."""

    def __init__(self, seed: int = 20240611):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(int(rng.integers(1 << 57, 1 << 60)) * 8 + 5)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, SEGMENT + 1)
            self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, self.base, np.uint64)]))
            self.inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, self.inverse, np.uint64)]))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        got = (sums[ends] - sums[starts]) * self.inverses[starts]
        got += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        got ^= got >> np.uint64(29)
        got *= np.uint64(0xBF58476D1CE4E5B9)
        got ^= got >> np.uint64(32)
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            view = memoryview(np.ascontiguousarray(data))
            got[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        return got | np.uint64(1)  # 0 marks a free place


def words_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; a word also ends at each of ``cuts``."""
    n = len(data)
    inside = np.ones(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    at = cuts[(cuts > 0) & (cuts < n)]
    first[at] |= inside[1:-1][at]
    last[at - 1] |= inside[1:-1][at - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def pieces_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, starts and ends of the pieces in them, and which of these are whole words left as they are.

    A word with a byte of kind _OTHER, or with ``<|``, which may begin a special token, is one piece.
    """
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    kind = _KIND[data]
    lower = data + ((data >= 0x41) & (data <= 0x5A)) * np.uint8(0x20)
    lead = np.flatnonzero(data[:-1] == 0xC3)  # Latin-1 letters, but for the signs of multiplication and division
    if len(lead):
        tail = data[lead + 1]
        lead = lead[(tail != 0x97) & (tail != 0xB7)]
        tail = data[lead + 1]
        kind[lead] = kind[lead + 1] = _LETTER
        lower[lead + 1] = np.where(tail <= 0x9E, tail | 0x20, tail)
    starts, ends = words_of(data, cuts)
    odd = kind == _OTHER
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins[starts] = True
    if odd.any():
        counts = np.concatenate([[0], np.cumsum(odd)])
        whole = np.flatnonzero(counts[ends] > counts[starts])
        mask = np.zeros(len(data) + 1, np.int8)
        mask[starts[whole]] += 1
        mask[ends[whole]] -= 1  # of words that touch, the next one's start undoes it
        inside = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
        lower = np.where(inside, data, lower)
        begins[:-1] &= ~inside
        begins[starts[whole]] = True
    else:
        inside = None
    begins[:-1] &= kind != _NONE
    first = np.flatnonzero(begins[:-1])
    owner = np.searchsorted(starts, first, "right") - 1
    last = np.append(first[1:], len(data))
    return lower, first, np.minimum(last, ends[owner]), inside[first] if inside is not None else np.zeros(len(first), bool)


class Places:
    """An open-addressing table from hashes to numbers, looked up for whole arrays."""

    def __init__(self, bits: int = 16):
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for those that aren't there."""
        mask, at = (1 << self.bits) - 1, (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == hashes, self.numbers[at], -1).astype(np.int32)
        left = np.flatnonzero((got != hashes) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            got = self.keys[at[left]]
            hit = got == hashes[left]
            out[left[hit]] = self.numbers[at[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        while (self.used + len(hashes)) * 2 > 1 << self.bits:
            keys, old = self.keys[self.keys != 0], self.numbers[self.keys != 0]
            self._reset(self.bits + 1)
            if len(keys):
                self.add(keys, old)
        mask, at, left = (1 << self.bits) - 1, (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            place, one = np.unique(at[free], return_index=True)
            self.keys[place], self.numbers[place] = hashes[free[one]], numbers[free[one]]
            left = left[self.keys[at[left]] != hashes[left]]
            at[left] = (at[left] + 1) & mask
        self.used += len(hashes)


class TextIds:
    """Ids of batches of texts; keeps the ids of the pieces that it has met, up to a bound."""

    def __init__(self, path: str):
        self.tokenizer, self.hashes = load_tokenizer(path), WordHashes()
        self._forget()

    def _forget(self) -> None:
        self.places = Places()
        self.starts, self.sizes, self.pool, self.n_words, self.n_ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32), 0, 0

    def _encode(self, words: list[bytes], whole: list[bool]) -> list[bytes]:
        """The ids of each; pieces go through the library many at once, between spaces."""
        ids = [b""] * len(words)
        plain, odd = [k for k, w in enumerate(whole) if not w], [k for k, w in enumerate(whole) if w]
        for i in range(0, len(plain), 256):
            part = plain[i : i + 256]
            encoded = self.tokenizer.encode(" ".join([words[k].decode() for k in part]), add_special_tokens=False)
            owners, got = np.array(encoded.word_ids), np.array(encoded.ids, np.uint32).tobytes()
            edges = [0, *(4 * (np.flatnonzero(np.diff(owners)) + 1)).tolist(), len(got)]
            if len(edges) == len(part) + 1:
                for k, a, b in zip(part, edges, edges[1:], strict=False):
                    ids[k] = got[a:b]
            else:  # a piece that the tokenizer cuts further
                odd += part
        for k, encoded in zip(odd, self.tokenizer.encode_batch([words[k].decode() for k in odd], add_special_tokens=False), strict=True):
            ids[k] = np.array(encoded.ids, np.uint32).tobytes()
        return ids

    def _learn(self, words: list[bytes], whole: list[bool]) -> None:
        """Append the ids of ``words`` to the pool."""
        ids = self._encode(words, whole)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        need_words, need_ids = self.n_words + len(ids), self.n_ids + len(flat)
        if need_words > len(self.sizes):
            self.sizes, self.starts = np.resize(self.sizes, need_words * 5 // 4), np.resize(self.starts, need_words * 5 // 4)
        if need_ids > len(self.pool):
            self.pool = np.resize(self.pool, need_ids * 5 // 4)
        self.sizes[self.n_words : need_words] = sizes
        self.starts[self.n_words : need_words] = self.n_ids + np.cumsum(sizes) - sizes
        self.pool[self.n_ids : need_ids] = flat
        self.n_words, self.n_ids = need_words, need_ids

    def _segment(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces of one segment, and each piece's start and number of ids."""
        data, starts, ends, whole = pieces_of(data, cuts)
        if self.n_words > MAX_WORDS or self.n_ids > MAX_POOL:
            self._forget()
        hashes = self.hashes.of(data, starts, ends)
        numbers = self.places.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            at = missing[first]
            new = np.arange(self.n_words, self.n_words + len(fresh), dtype=np.int32)
            text = memoryview(data.tobytes())
            for i in range(0, len(at), LEARN):
                some = at[i : i + LEARN]
                self._learn([bytes(text[a:b]) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], whole[some].tolist())
            self.places.add(fresh, new)
            numbers[missing] = new[np.searchsorted(fresh, hashes[missing])]
        sizes = self.sizes[numbers].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        ids = self.pool[np.arange(int(sizes.sum())) + np.repeat(self.starts[numbers].astype(np.int64) - first, sizes)]
        return ids, starts, sizes

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of ids of each; ``data`` is UTF-8, ``offsets`` where texts begin and the last ends."""
        counts, parts = np.zeros(len(offsets) - 1, np.int64), []
        a, end = int(offsets[0]), int(offsets[-1])
        while a < end:
            b = min(end, a + SEGMENT)
            if b < end:  # back to the last place where no word is cut, or else on to the next
                text = int(np.searchsorted(offsets, b, "right")) - 1
                if offsets[text] > a:
                    b = int(offsets[text])
                else:
                    spaces = np.flatnonzero(_SPACE[data[a:b]])
                    stop = int(offsets[text + 1])
                    while not len(spaces) and b < stop:
                        step = min(stop, b + SEGMENT)
                        spaces = np.flatnonzero(_SPACE[data[b:step]]) + (b - a)
                        b = step
                    b = a + int(spaces[-1]) + 1 if len(spaces) and b < stop else b
            ids, starts, sizes = self._segment(data[a:b], offsets[(offsets > a) & (offsets < b)] - a)
            owner = np.searchsorted(offsets, starts + a, "right") - 1
            np.add.at(counts, owner, sizes) if len(owner) < 64 else counts.__iadd__(np.bincount(owner, sizes, len(counts)).astype(np.int64))
            parts.append(ids)
            a = b
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), counts

    def of_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for an Arrow string column; null is an empty text."""
        return self(*text_bytes(column))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its texts begin; null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    return np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8), offsets


def groups(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b of a text column at a time, about ``size`` bytes or one text, with their bytes and offsets."""
    data, offsets = text_bytes(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


_LOADED: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """The worker's tokenizer, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = TextIds(path)
    return _LOADED[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, column: str = "text"):
    """Each batch with its texts' ids, ``end_id`` behind each text, and where each text's ids begin and the last end."""
    encoder = text_ids(path)
    for batch in batches:
        ids, counts = encoder.of_column(batch.column(column))
        bounds = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts + 1, out=bounds[1:])
        out = np.full(int(bounds[-1]), end_id, np.uint32)
        kept = np.ones(len(out), bool)
        kept[bounds[1:] - 1] = False
        out[kept] = ids
        yield batch, out, bounds
    give_back()
