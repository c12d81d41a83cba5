"""Exact byte-level BPE ids from the tokenizers library, with a memo of pieces.

Byte-level BPE first cuts a text into pieces by a pattern and then encodes each piece alone. The memo therefore asks
the library for each distinct piece only once in a while; texts with characters for which two pattern engines might
disagree, or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_KEEP = 1 << 19  # pieces remembered by a worker, some 100 MB
_AT_ONCE = 1 << 21  # characters encoded at once, about
_OPEN: dict[str, Encoder] = {}
#: Letters, digits, punctuation and white space that every Unicode version classes alike.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ–—‘-„…€]")
#: Kinds of those characters for the vocabulary's split pattern ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+):
#: white space 0, letters 1, digits 2, others 3.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_KIND = np.array([0 if x in "\t\n\r " else 1 if re.match(f"[{_L}]", x) else 2 if re.match(f"[{_N}]", x) else 3 for x in map(chr, range(ord("€") + 1))], np.uint8)
#: Pieces of one space and letters: a run of them splits in the same places again.
_JOINABLE = re.compile(f" [{_L}]+").fullmatch


def cuts(code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the split pattern's pieces start, and the end: of code points, all of known kinds, of texts between the edges."""
    kind, first = _KIND[code], np.zeros(len(code) + 3, bool)
    first[edges] = True
    start = first.copy()
    start[1 : len(code)] |= kind[1:] != kind[:-1]
    # the last of a text's white space before other characters stands alone, a space with them
    after = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0)) + 1
    after = after[~first[after]]
    start[after - 1] = True
    start[after[code[after - 1] == 32]] = False
    # an apostrophe that starts a piece takes one or two certain letters of its text with it, and no more
    mark = np.flatnonzero(code == 39)
    mark = mark[start[mark]]
    next_, second = (np.where(first[mark + i], 0, np.append(code, [0, 0])[mark + i]) for i in (1, 2))
    one = np.isin(next_, [115, 116, 109, 100])
    two = ((next_ == 114) | (next_ == 118)) & (second == 101) | (next_ == 108) & (second == 108)
    start[mark[one | two] + 1] = False
    start[mark[one] + 2] = start[mark[two] + 3] = True
    return np.flatnonzero(start[: len(code) + 1])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to arrays of ids. Make it by Encoder.at(path), once in a worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": spec["pre_tokenizer"].get("use_regex", True)}
        self.memo: dict[str, bytes] | None = {} if plain else None
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.leading = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leading[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Ask for new pieces; those that can stand in one text go together."""
        run = [x for x in pieces if _JOINABLE(x)]
        rest = [x for x in pieces if not _JOINABLE(x)]
        for i in range(0, len(run), 1000):
            part = run[i : i + 1000]
            raw = self._ask(["".join(part)])[0]
            # each piece starts with its only space, so a token with a leading space starts a piece
            starts = np.flatnonzero(self.leading[np.frombuffer(raw, self.dtype)]) * self.dtype.itemsize
            if len(starts) == len(part):
                at = [*starts.tolist(), len(raw)]
                self.memo.update(zip(part, map(raw.__getitem__, map(slice, at, at[1:])), strict=True))
            else:
                rest += part
        if rest:
            self.memo.update(zip(rest, self._ask(rest), strict=True))

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without special tokens; a null text is empty. What the memo lacks is asked for at once."""
        whole = [bool(x) and (self.memo is None or bool(_ODD.search(x)) or any(y in x for y in self.special)) for x in texts]
        ask = iter(self._ask([x for x, alone in zip(texts, whole, strict=True) if alone]))
        cut = self._by_pieces(["" if alone else x or "" for x, alone in zip(texts, whole, strict=True)])
        return [np.frombuffer(next(ask), self.dtype) if alone else x for x, alone in zip(cut, whole, strict=True)]

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts: each distinct piece is looked up once, Arrow puts the pieces' ids in the texts' order."""
        text = "".join(texts)
        if not text:
            return [np.empty(0, self.dtype)] * len(texts)
        edges = np.cumsum([0, *map(len, texts)])
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = cuts(code, edges)
        places = at if text.isascii() else np.cumsum(np.concatenate([[0], 1 + (code >= 0x80) + (code >= 0x800)]))[at]
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(text.encode())).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [*map(self.memo.get, distinct)]
        new = [x for x, ids in zip(distinct, known, strict=True) if ids is None]
        if new:
            if len(self.memo) + len(new) > _KEEP:
                self.memo.clear()
                new = distinct
            self._learn(new)
            known = [*map(self.memo.__getitem__, distinct)] if new is distinct else [self.memo[x] if ids is None else ids for x, ids in zip(distinct, known, strict=True)]
        _, ends, ids = pa.array(known, pa.large_binary()).take(pieces.indices).buffers()
        ends = np.frombuffer(ends, np.int64)[np.searchsorted(at, edges)] // self.dtype.itemsize
        return np.split(np.frombuffer(ids, self.dtype, ends[-1]), ends[1:-1])

    def groups(self, batch):
        """(doc_id, ids) of an Arrow batch's rows, some texts at once."""
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()) // _AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            yield from zip(part.column("doc_id").to_pylist(), self.batch(part.column("text").to_pylist()), strict=True)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]
