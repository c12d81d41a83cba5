"""Vectorised word and shingle hashing used inside tasks.

Words are maximal runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return of the
UTF-8 text. A word's hash is a polynomial over random 64-bit values of its bytes, taken from running sums, so a text
costs a few array passes and no Python object for a word.
"""

from __future__ import annotations

import numpy as np

_R = 0x9FB21C651E98DF25
_INVERSE = pow(_R, -1, 1 << 64)
_M, _N = np.uint64(0xD6E8FEB86659FD93), np.uint64(_R)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 18
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _R), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table)
    return _POWERS["up"], _POWERS["down"]


def encoded(text: str | None, lower: bool = False) -> bytes:
    """UTF-8 of a text; lower: A-Z become a-z, other letters stay."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return raw.lower() if lower else raw


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word."""
    space = np.ones(len(raw) + 2, bool)
    np.take(_SPACE, np.frombuffer(raw, np.uint8), out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word."""
    starts, ends = spans(raw)
    return hashed(raw, starts, ends)


def hashed(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # whole words, about _CHUNK bytes at once
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        first, last = int(starts[i]), int(ends[j - 1])
        up, down = _powers(last - first + 1)
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_VALUE[np.frombuffer(raw, np.uint8, last - first, first)] * up[: last - first], out=total[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (total[b] - total[a]) * down[a]
        i = j
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _N
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive items; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _N
        out += h[j : j + n]
    return mixed(out)


def shingles(raw: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; a shorter text is one shingle, an empty one has none."""
    h = hashes(raw)
    if not len(h):
        return h
    return np.unique(windows(h, k) if len(h) >= k else windows(h, len(h)) + np.uint64(len(h)))


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the n positions that lie in one of the runs of length k at the given starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:n]) > 0
