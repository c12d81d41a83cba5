"""Texts are cut as the vocabulary's split pattern cuts them, and a batch asks the memo for a distinct piece once."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from tidewater.llm import tokens

PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_½]+| ?[0-9½]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SIGNS = ["'", "'", "s", "t", "re", "ve", "m", "ll", "d", "l", "e", "r", " ", " ", "\n", "\t", "\r", "a", "Z", "9", "½", "é", "–", "€", "!", "_"]


def test_pieces_and_ids_of_random_texts():
    encode, rnd = tokens.Encoder(tokens.vocabulary()), random.Random(5)
    for _ in range(400):
        texts = ["".join(rnd.choices(SIGNS, k=rnd.randint(1, 14))) for _ in range(rnd.randint(1, 9))]
        joined, edges = "".join(texts), np.cumsum([0, *map(len, texts)])
        at = tokens.cuts(np.frombuffer(joined.encode("utf-32-le"), "<u4"), edges).tolist()
        assert [joined[a:b] for a, b in zip(at, at[1:])] == [x for text in texts for x in PATTERN.findall(text)]
        mixed = [*texts, None, "", "日本 " + texts[0], texts[0] + "<|endoftext|>"]
        want = encode.library.encode_batch([x or "" for x in mixed], add_special_tokens=False)
        assert [x.tolist() for x in encode.batch(mixed)] == [x.ids for x in want]


def test_memo_that_overflows(monkeypatch):
    monkeypatch.setattr(tokens, "_KEEP", 3)
    encode = tokens.Encoder(tokens.vocabulary())
    for text in ("one two three four", "four five", "two six one seven"):
        assert encode(text).tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_a_piece_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    encode = tokens.Encoder(tokens.vocabulary())
    encode.memo = Counted()
    encode.batch([" the same words" * 1000] * 3)
    assert encode.memo.asked <= 2 * 3
