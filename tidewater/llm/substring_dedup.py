"""Substring dedup with suffix automata of reference shards.

A window is WINDOW consecutive words. A word goes if a window that covers it also starts in a document with a smaller
doc_id. Automata of the whole corpus, broadcast to stream every document through each, would cost the square of the
corpus. So they are not broadcast; Spark brings references and documents together by shard, after it has found what can
match at all:

1. later rows with a whole text of a smaller document are found by a 128-bit hash and go no further;
2. every window selects an anchor, the least hash of its SEED-word runs; equal windows select equal anchors. Anchors of
   a single document are dropped by an exact join;
3. the document with the least id for an anchor is its reference. Windows with shared anchors are cut into pieces of
   at most PIECE windows. The references' pieces form shards by document and range of RANGE words, so that a long
   reference is several shards; a suffix automaton is built for each shard, its references in ascending order, so that
   a state's owner is the least document with that text. Pieces of other documents are sent to their anchors' shards
   (hot shards in several salted parts, each with its copy of the automaton) and streamed through it: matching
   statistics of at least WINDOW words by a smaller document mark a window;
4. windows whose reference does not have them may still be in a later document. Their hashes settle the least document
   exactly.

Overlapping windows make up the maximal spans that are removed.

Edge cases: a null text has no words; texts shorter than the window lose nothing; rows that share a doc_id do not
remove each other's words; a null doc_id neither removes nor loses words; a text of any length is cut into pieces, its
anchors being the only thing gathered for it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words as W
from tidewater.llm.store import discard, with_ids, written

WINDOW = 13
SEED = 5
PIECE = 256  # windows in a piece
GAP = 24  # windows between those of a piece that other shards judge, at most
RANGE = 16_384  # words of a reference in a shard, about
SHARD_PIECES = 200  # pieces of references in an automaton, about
PART_PIECES = 5_000  # pieces streamed through one copy of it, about
_ROW = ["doc_id", "key"]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text); the key tells rows of one doc_id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of the anchor of the window that starts at each word); both empty for a short text."""
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    runs = (W.windows(h, SEED) >> np.uint64(16)).view(np.int64)
    span = WINDOW - SEED + 1
    place = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)
    return runs, place


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of rows whose whole text a document with a smaller id has too."""
    every = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("two"))
    first = every.groupBy("key", "two").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    return every.join(first, ["key", "two"]).where("doc_id > lo").select(*_ROW).distinct()


def _anchors_of(rows: DataFrame) -> DataFrame:
    """(token, doc_id, key, pos): every anchor of every row."""

    def scan(batches):
        for batch in batches:
            tokens, places, lengths = [], [], []
            for text in batch.column("text"):
                runs, place = anchors(W.hashes(W.encoded(text.as_py())))
                at = np.unique(place)
                tokens.append(runs[at])
                places.append(at.astype(np.int32))
                lengths.append(len(at))
            if not sum(lengths):
                continue
            owner = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
            columns = [pa.array(np.concatenate(tokens)), *(batch.column(x).take(owner) for x in _ROW), pa.array(np.concatenate(places))]
            for i in range(0, len(owner), 1 << 18):
                yield pa.RecordBatch.from_arrays([x.slice(i, 1 << 18) for x in columns], ["token", *_ROW, "pos"])

    return rows.mapInArrow(scan, "token long, doc_id long, key long, pos int")


_PIECES = pa.schema([("reference", pa.bool_()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("at", pa.list_(pa.int32())), ("words", pa.binary())])


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of the rows (doc_id, key, text, routes of (pos, lo, shard)), once for each shard that they go to, as reference or to be judged.

    at: the anchors (places in the row) of the windows that the shard judges.
    """

    def scan(batches):
        for batch in batches:
            out = []
            for doc_id, key, text, routes in zip(*(batch.column(x) for x in ("doc_id", "key", "text", "routes")), strict=True):
                doc_id, key, raw, routes = doc_id.as_py(), key.as_py(), W.encoded(text.as_py()), routes.values
                first, past = W.spans(raw)
                _, place = anchors(W.hashed(raw, first, past))
                by = np.argsort(routes.field("pos").to_numpy())
                at, lo, shard = (routes.field(x).to_numpy()[by] for x in ("pos", "lo", "shard"))
                k = np.minimum(np.searchsorted(at, place), len(at) - 1)
                starts = np.flatnonzero(at[k] == place)
                mine, where = lo[k[starts]] == doc_id, shard[k[starts]]
                by = np.lexsort((starts, mine, where))
                starts, mine, where = starts[by], mine[by], where[by]
                # a new piece for another shard or role, after a gap, and after PIECE windows
                cut = (np.diff(where) != 0) | (np.diff(mine) != 0) | (np.diff(starts) > GAP)
                run = np.concatenate([[0], np.cumsum(cut)])
                inside = np.arange(len(starts)) - np.searchsorted(run, run)
                edges = [*np.flatnonzero(inside % PIECE == 0).tolist(), len(starts)]
                for i, j in zip(edges, edges[1:], strict=False):
                    a, b = int(starts[i]), int(starts[j - 1]) + WINDOW
                    judged = None if mine[i] else np.unique(place[starts[i:j]])
                    out.append((bool(mine[i]), int(where[i]), doc_id, key, a, judged, raw[first[a] : past[b - 1]]))
            for i in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 2000], strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    return rows.mapInArrow(scan, "reference boolean, shard long, doc_id long, key long, start int, at array<int>, words binary")


class SuffixAutomaton:
    """Suffix automaton of several word sequences; owner[state] is the document that first had the state's text."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]
        self.last = 0

    def _state(self, length: int, link: int, edges: dict, owner) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def add(self, words: list[int], owner: int) -> None:
        """Add a sequence on its own; sequences come in ascending order of owner."""
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            p = last
            if w in nexts[p]:  # the text is known: reuse or split its state
                q = nexts[p][w]
                last = q if length[q] == length[p] + 1 else self._split(p, w, q)
                continue
            new = self._state(length[p] + 1, 0, {}, owner)
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w: int, q: int) -> int:
        nexts, link = self.next, self.link
        clone = self._state(self.length[p] + 1, link[q], dict(nexts[q]), self.owner[q])
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def windows(self, words: list[int], size: int, before: int) -> list[int]:
        """Starts of the windows of this size that a document with an id below ``before`` has."""
        nexts, link, length, owner = self.next, self.link, self.length, self.owner
        state, matched, found = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w in nexts[state]:
                state = nexts[state][w]
                matched += 1
            while state and length[link[state]] >= size:  # keep to the window's own state
                state = link[state]
                matched = length[state]
            if matched >= size and owner[state] < before:
                found.append(i - size + 1)
        return found


_FOUND = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("hash", pa.int64())])


def _match(references: pa.Table, queries: pa.Table) -> pa.Table:
    """Matched windows as runs (start, n), unmatched ones singly with their hash; each window is judged in its anchor's shard."""
    automaton = SuffixAutomaton()
    for doc_id, _, raw in sorted(zip(*(references[f"r_{x}"].to_pylist() for x in ("doc_id", "start", "words")), strict=True)):
        automaton.add(W.hashes(raw).tolist(), doc_id)
    found_rows, out = [], []
    at = queries["at"]
    for i, (doc_id, start, raw) in enumerate(zip(*(queries[x].to_pylist() for x in ("doc_id", "start", "words")), strict=True)):
        h = W.hashes(raw)
        mine = np.isin(anchors(h)[1], at[i].values.to_numpy() - start)
        found = np.zeros(len(mine), bool)
        found[automaton.windows(h.tolist(), WINDOW, doc_id)] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], found & mine, [False]]).astype(np.int8)))
        rest = np.flatnonzero(mine & ~found)
        firsts = np.concatenate([edge[::2], rest])
        found_rows.append(np.full(len(firsts), i))
        hashed = W.windows(h, WINDOW).view(np.int64)[rest] if len(rest) else rest
        out.append(np.stack([firsts + start, np.concatenate([edge[1::2] - edge[::2], np.ones(len(rest), np.int64)]), np.concatenate([np.zeros(len(edge) // 2, np.int64), hashed]), np.arange(len(firsts)) < len(edge) // 2]))
    if not out:
        return _FOUND.empty_table()
    start, n, hashed, matched = np.concatenate(out, axis=1)
    rows = queries.select(_ROW).take(pa.array(np.concatenate(found_rows)))
    return pa.Table.from_arrays([rows["doc_id"], rows["key"], pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(hashed, mask=matched.astype(bool))], schema=_FOUND)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, key, start, n): runs of n windows, from a word on, that a document with a smaller id also has; n is null for a whole copy."""
    copies = written(_copies(docs), "copies")
    rows = with_ids(_rows(docs).where("doc_id is not null and text is not null"), copies, _ROW, "left_anti")
    every = written(_anchors_of(rows), "anchors")
    shared = every.groupBy("token").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("pos", "doc_id").alias("where")).where("lo < hi")
    shared = shared.select("token", "lo", F.xxhash64("lo", F.floor(F.col("where") / RANGE)).alias("shard"))
    routes = every.join(shared.hint("merge"), "token").groupBy(*_ROW).agg(F.collect_list(F.struct("pos", "lo", "shard")).alias("routes"))
    pieces = written(_pieces(rows.join(routes.hint("merge"), _ROW)), "pieces")
    discard(every)
    shards = max(8, pieces.where("reference").count() // SHARD_PIECES)
    pieces_ = pieces.withColumn("shard", F.pmod("shard", F.lit(shards)))
    load = written(pieces_.where("not reference").groupBy("shard").agg(F.ceil(F.count("*") / PART_PIECES).alias("salts")), "load")
    # a row for each of the shards, a PIECE * SHARD_PIECES-th of the corpus
    dealt = pieces_.join(load, "shard")
    queries = dealt.where("not reference").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), "salts")).select("shard", "salt", *_ROW, "start", "at", "words")
    references = dealt.where("reference").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    references = references.select(*(F.col(x).alias(f"r_{x}") for x in ("shard", "salt", "doc_id", "start", "words")))
    found = references.groupBy("r_shard", "r_salt").cogroup(queries.groupBy("shard", "salt")).applyInArrow(_match, "doc_id long, key long, start int, n int, hash long")
    found = written(found, "matches")
    discard(pieces, load)
    # windows that their reference does not have: the least document by hash
    rest = found.where("hash is not null").select("hash", *_ROW, "start")
    least = rest.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash", "lo")
    late = rest.join(least.hint("merge"), "hash").where("doc_id > lo").select(*_ROW, "start", F.lit(1).alias("n"))
    runs = written(found.where("hash is null").select(*_ROW, "start", "n").unionByName(late), "runs")
    discard(found)
    return runs.unionByName(copies.select(*_ROW, F.lit(0).alias("start"), F.lit(None).cast("int").alias("n")))


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (the kept words joined by spaces)."""
    runs = repeated(docs).groupBy(*_ROW).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]

    def scan(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                words = W.encoded(text.as_py()).split()
                n = len(words)
                if runs.is_valid:
                    step = np.zeros(n + 1, np.int64)
                    start, many = runs.values.field("start").to_numpy(), runs.values.field("n").to_numpy(zero_copy_only=False)
                    past = np.where(np.isnan(many), n if n >= WINDOW else 0, start + many + WINDOW - 1).astype(np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, past, -1)
                    words = list(compress(words, (np.cumsum(step[:n]) == 0).tolist()))
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if with_text else ())))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    joined = _rows(docs).join(runs.hint("merge"), _ROW, "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(scan, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
