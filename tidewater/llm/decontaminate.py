"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted Jaccard similarity.

A benchmark item is compared with windows of as many words as it has, or with the whole document if that is shorter.
Windows and items have fingerprints of BITS bits, the signs of their shingles' weighted bit sums, which running sums give
for all windows of a size. Fingerprints are cut into BLOCKS blocks; an item is filed under every value of a block that
differs from its own in at most RADIUS // BLOCKS bits, so a window's own values lead to every item within RADIUS bits.
The exact weighted Jaccard similarity of the shingle multisets, the best upper bound first, decides about those.

At a similarity of PERCENT two fingerprints differ in about 18 of 120 bits with a deviation of 4, so RADIUS 39 loses
about one such window in 10**7; the tests compare with all windows. Windows without any shingle of an item (similarity 0)
get no fingerprint.

A shingle of an item weighs log(1 + items / items that have it), counted over the whole benchmark, so text shared by many
items counts less; a window's shingles that the item lacks weigh log(1 + items). Items go to the tasks in blocks of at
most BLOCK_ITEMS items and BLOCK_SHINGLES shingles, a pass over the documents for each block; the weights, and so the
similarities, do not depend on the blocks.

Words are lower-cased (A-Z) with ASCII punctuation as space, so re-wrapped or re-punctuated copies match.

Edge cases: null, empty and wordless texts and items match nothing; an item of fewer than five words is one shingle and
matches only as a whole; a document of fewer words than an item's shingle does not match it; items that repeat are
reported each; each row of a document is judged by itself, whatever its doc_id, null included; of equally similar windows
the first counts; long texts are searched in parts of PART windows; an empty benchmark leaves all; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words as W
from tidewater.llm.store import discard, written

SHINGLE = 5
BLOCKS, BLOCK_BITS = 10, 12
BITS = BLOCKS * BLOCK_BITS
RADIUS = 39
PERCENT = 80
BLOCK_ITEMS, BLOCK_SHINGLES = 1000, 500_000
PART = 2048
_PLAIN = bytes(32 if chr(i) in string.punctuation else ord(chr(i).lower()) if i < 128 else i for i in range(256))
#: Values of a block that differ from 0 in few enough bits.
_NEAR = np.array([sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)])
_SHIFTS = np.arange(BITS // 2, dtype=np.uint64)


def plain(text: str | None) -> bytes:
    return W.encoded(text).translate(_PLAIN)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Shingle hashes in order; sizes below SHINGLE do not mix with others."""
    return W.windows(h, size) + np.uint64(size)


def blocks(fingerprint: int) -> list[tuple[int, int]]:
    """(block, value) under which an item with this fingerprint is filed."""
    values = [(fingerprint >> (BLOCK_BITS * i)) & ((1 << BLOCK_BITS) - 1) for i in range(BLOCKS)]
    return [(i, v ^ int(x)) for i, v in enumerate(values) for x in _NEAR]


def bit_sums(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums of the shingles' weighted bits, a row more than there are shingles."""
    signs = np.concatenate([(x[:, None] >> _SHIFTS) & np.uint64(1) for x in (s, W.mixed(s + np.uint64(1)))], axis=1).astype(np.float64) * 2 - 1
    return np.concatenate([np.zeros((1, BITS)), np.cumsum(signs * weights[:, None], axis=0)])


def _values(bits: np.ndarray) -> np.ndarray:
    """Values of the blocks of fingerprints given as rows of bits."""
    return bits.reshape(len(bits), BLOCKS, BLOCK_BITS) @ (1 << np.arange(BLOCK_BITS))


class Items:
    """A block of benchmark items: their fingerprints' index, and what the exact similarity needs."""

    def __init__(self, rows: list[tuple[int, str]], frequent: dict[int, int] | None = None, total: int | None = None):
        """frequent: in how many items of the whole benchmark a shingle is, where that is more than one; total: how many items there are."""
        self.ids, self.words, self.sizes, self.shingles = [], [], [], []
        for item_id, text in rows:
            h = W.hashes(plain(text))
            if len(h):
                self.ids.append(item_id)
                self.words.append(len(h))
                self.sizes.append(min(SHINGLE, len(h)))
                self.shingles.append(shingles(h, self.sizes[-1]))
        df = Counter(x for s in self.shingles for x in set(s.tolist()))
        if frequent is not None:
            df = {x: frequent.get(x, 1) for x in df}
        total = len(self.ids) if total is None else total
        self.default = math.log(1 + total)
        self.weight = {x: math.log(1 + total / n) for x, n in df.items()}
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.total = [sum(self.weight[x] * n for x, n in c.items()) for c in self.counts]
        self.known = np.sort(np.array(list(df), np.uint64))
        self.maybe = np.zeros(1 << 20, bool)  # a quick no for most shingles
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.classes: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (size, words) in enumerate(zip(self.sizes, self.words, strict=True)):
            self.classes[size][words].append(i)
        self.prints = np.array([bit_sums(s, self.weights(s))[-1] > 0 for s in self.shingles]).reshape(-1, BITS)
        self.index = {}
        for size, by_words in self.classes.items():
            for words, members in by_words.items():
                table = np.zeros((BLOCKS, 1 << BLOCK_BITS, len(members)), bool)
                for j, value in enumerate(_values(self.prints[members])):
                    table[np.arange(BLOCKS)[:, None], value[:, None] ^ _NEAR, j] = True
                self.index[size, words] = table

    def weights(self, s: np.ndarray) -> np.ndarray:
        return np.array([self.weight.get(x, self.default) for x in s.tolist()])

    def similarity(self, i: int, s: np.ndarray) -> float:
        """Weighted Jaccard of an item's and a window's shingle multisets."""
        window, item = Counter(s.tolist()), self.counts[i]
        same = sum(self.weight[x] * min(n, item[x]) for x, n in window.items() if x in item)
        return same / (self.total[i] + sum((self.weight[x] if x in item else self.default) * n for x, n in window.items()) - same)

    def hits(self, s: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[(s >> np.uint64(44)).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
            at = at[self.known[k] == s[at]]
        return at

    def near(self, s: np.ndarray, size: int, words: int, width: int, starts: np.ndarray):
        """(item, start) of the windows within RADIUS bits of an item of this class."""
        members, table = self.classes[size][words], self.index[size, words]
        for part in np.split(starts, np.flatnonzero((np.diff(starts) > width) | (np.diff(starts // PART) != 0)) + 1):
            low = int(part[0])
            region = s[low : int(part[-1]) + width]
            sums = bit_sums(region, self.weights(region))
            bits = sums[part - low + width] - sums[part - low] > 0
            value = _values(bits)
            filed = np.zeros((len(part), len(members)), bool)
            for j in range(BLOCKS):
                filed |= table[j, value[:, j]]
            window, item = np.nonzero(filed)
            for a in range(0, len(window), 1 << 16):
                w, i = window[a : a + (1 << 16)], item[a : a + (1 << 16)]
                close = (bits[w] != self.prints[members][i]).sum(axis=1) <= RADIUS
                yield from zip(np.array(members)[i[close]].tolist(), part[w[close]].tolist(), strict=True)

    def search(self, text: str | None):
        """(item, first word, words, similarity) of the best window of each item that the text contains."""
        h = W.hashes(plain(text))
        for size, by_words in sorted(self.classes.items()):
            if len(h) < size:
                continue
            s = shingles(h, size)
            at = self.hits(s)
            if not len(at):
                continue
            for words in sorted(by_words):
                n_words = min(words, len(h))
                width = n_words - size + 1
                # windows that hold a shingle of some item
                step = np.zeros(len(s) + 1, np.int32)
                np.add.at(step, np.maximum(at - width + 1, 0), 1)
                np.add.at(step, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(step)[: len(s) - width + 1])
                found = defaultdict(list)
                for i, start in self.near(s, size, words, width, starts) if len(starts) else ():
                    found[i].append(start)
                for i, places in sorted(found.items()):
                    if best := self._best(i, s, at, width, np.array(places)):
                        yield self.ids[i], best[0], n_words, best[1]

    def _best(self, i: int, s: np.ndarray, hits: np.ndarray, width: int, starts: np.ndarray) -> tuple[int, float] | None:
        """(start, similarity) of the most similar of these windows, if it is similar enough."""
        low, high = np.searchsorted(hits, [starts.min(), starts.max() + width])
        at = hits[low:high]
        item = self.counts[i]
        weight = np.array([self.weight[x] if (x := int(s[p])) in item else 0.0 for p in at])
        total = np.concatenate([[0], np.cumsum(weight)])
        count = np.concatenate([[0], np.cumsum(weight > 0)])
        a, b = np.searchsorted(at, starts), np.searchsorted(at, starts + width)
        inside = total[b] - total[a]
        # what a window can share at most, and the similarity that this would be
        others = (width - (count[b] - count[a])) * self.default
        shared = np.minimum(inside, self.total[i])
        bound = shared / (self.total[i] + inside + others - shared)
        best = None
        for k in np.lexsort((starts, -np.round(bound, 9))).tolist():
            if bound[k] < PERCENT / 100 - 1e-9 or (best is not None and bound[k] < best[1] - 1e-9):
                break
            start = int(starts[k])
            alike = self.similarity(i, s[start : start + width])
            if alike >= PERCENT / 100 - 1e-9 and (best is None or (round(alike, 9), -start) > (round(best[1], 9), -best[0])):
                best = start, alike
        return best


def _item_blocks(benchmark: DataFrame):
    """The items in blocks of bounded size, one after another: (rows, frequent shingles, number of all items)."""
    table = written(benchmark.where("text is not null").select("item_id", "text", F.monotonically_increasing_id().alias("row")), "items")

    def scan(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = W.hashes(plain(text))
                if len(h):
                    s = np.unique(shingles(h, min(SHINGLE, len(h)))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), row)), pa.array(s)], ["row", "shingle"])

    pairs = written(table.select("row", "text").mapInArrow(scan, "row long, shingle long"), "item-shingles")
    total = pairs.agg(F.count_distinct("row")).first()[0]
    frequent = pairs.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    frequent = pairs.join(frequent, "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "n")).alias("frequent"))
    block, known, size = [], {}, 0
    for row in table.join(frequent, "row", "left").orderBy("item_id", "text", "row").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        known |= {x["shingle"] % (1 << 64): x["n"] for x in row["frequent"] or ()}
        size += len(row["text"].split())
        if size >= BLOCK_SHINGLES or len(block) >= BLOCK_ITEMS:
            yield block, known, total
            block, known, size = [], {}, 0
    if block:
        yield block, known, total
    discard(table, pairs)


def _shared(docs: DataFrame, benchmark: DataFrame) -> list:
    return [docs.sparkSession.sparkContext.broadcast(block) for block in _item_blocks(benchmark)]


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window for each item that a document contains."""
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    found = docs.sparkSession.createDataFrame([], schema)
    for shared in _shared(docs, benchmark):

        def scan(batches, shared=shared):
            items = Items(*shared.value)
            for batch in batches:
                rows = [(d, *x) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for x in items.search(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(scan, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that contain no benchmark item, with all their columns, decided in the scan itself."""
    for shared in _shared(docs, benchmark):

        def scan(batches, shared=shared):
            items = Items(*shared.value)
            for batch in batches:
                yield batch.filter(pa.array([next(items.search(text.as_py()), None) is None for text in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
