"""Token ids against the library on whole texts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = tokens.load_tokenizer(PATH)
ENCODER = tokens.TextIds(PATH)


def against_library(texts):
    ids, counts = ENCODER.of_column(pa.array(texts, pa.string()))
    want = [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_plain_and_odd_texts():
    against_library([
        "It's the cat's 12 hats!!", None, "", "  \n\t ", "Élan ÉLAN straße İstanbul ΟΔΟΣ", "a\x1cb\x85c\xa0d e", "éte ́x",
        "<|endoftext|> and <|startoftext|>x", "don't'd'LL WE'RE", "日本語 テキスト 🙂🙂", "x" * 5000, "﻿BOM \x00nul", "µ ª º × ÷ ÿŸ",
    ])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="abS'tdé 1.\n<|>́", max_size=30)), max_size=6))
def test_any_texts(texts):
    against_library(texts)


def test_segments_and_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    monkeypatch.setattr(tokens, "MAX_WORDS", 20)
    rng = np.random.default_rng(1)
    against_library([" ".join("".join(rng.choice(list("abcé."), rng.integers(1, 9))) for _ in range(rng.integers(0, 80))) for _ in range(30)] + ["y" * 400 + " tail"])


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_places(n):
    rng, table = np.random.default_rng(2), tokens.Places(4)
    hashes = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
    for part in np.array_split(hashes, 7):
        table.add(part, np.searchsorted(hashes, part).astype(np.int32))
    assert table.find(hashes).tolist() == list(range(len(hashes)))
    assert (table.find(rng.integers(1, 1 << 63, 50, dtype=np.uint64) | np.uint64(1 << 63)) == -1).all()


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [64, 65, 512, 1024, 2048, 4096])
@pytest.mark.parametrize("letters", ["ab", "1!", "é."])
def test_regular_words_are_told_apart(n, letters):
    """Sums of powers of an odd number modulo 2^64 are equal for these words and their complements."""
    against_library([f"{thue_morse(n, letters)} {thue_morse(n, letters[::-1])}", thue_morse(n, letters[::-1])])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAÉé×÷ß1.'<|> \n日", max_size=60))
def test_pieces_of_mixed_signs(text):
    against_library([text, text + "'s", "x" + text])
