"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Shingles are ordered by an estimate of their document frequency (a fixed-size count sketch of all documents) and then
by hash, so rare ones come first. A document of n shingles shares at least t = ceil(threshold * n) of them with any
partner; if its prefix holds its first n - t + m shingles, then m of the shared ones lie in both prefixes (for two
documents: the smaller of their m). A document whose short prefix is expected to bring many candidates gets a longer
one and so asks for more common shingles: m minimises (expected candidates of the prefix) / m + its extra length.

Candidates are never expanded into all pairs of a group. The documents of a shared prefix shingle are first compared
with the group's most central document only (first each document with the one it shares most with), the links found are merged
into components, and only pairs of different
components that still share enough prefix shingles are compared with each other. That loses no link between
components, and verified links are exact.

Edge cases: text null, empty or blank has no shingle and no link; a text shorter than k words is one shingle; exact
copies meet by the hash of their set; rows that repeat a doc_id count as one document; a null doc_id gets a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words as W
from tidewater.llm.components import components
from tidewater.llm.store import discard, only, with_ids, written

SKETCH_BITS = 18
MOST_MATCHES = 4
SIGNATURE = 128  # a set's counts by hash class: the sum of two sets' lesser counts bounds their overlap
_SHARED = np.uint64(16)  # postings carry 48-bit shingle keys; verification compares whole hashes


def _sets(batch: pa.RecordBatch, k: int):
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        yield doc_id, W.shingles(W.encoded(text.as_py(), lower=True), k)


def profile(docs: DataFrame, k: int = 5, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, np.ndarray]:
    """One scan: (doc_id, n_shingles, set_key, signature) of each document, and the count sketch of all shingles."""
    shift = np.uint64(64 - sketch_bits)
    names = ["document", "doc_id", "n", "key", "signature"]

    def scan(batches):
        counts = np.zeros(1 << sketch_bits, np.int64)
        for batch in batches:
            rows = []
            for doc_id, s in _sets(batch, k):
                counts += np.bincount((s >> shift).astype(np.int64), minlength=1 << sketch_bits) if len(s) >> 12 else 0
                rows.append((doc_id, len(s), xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None, s))
            if rows:
                short = [r[3] for r in rows if not len(r[3]) >> 12]
                if short:
                    counts += np.bincount((np.concatenate(short) >> shift).astype(np.int64), minlength=1 << sketch_bits)
                marks = np.concatenate([np.bincount((r[3] & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) for r in rows])
                ends = np.arange(0, SIGNATURE * len(rows) + 1, SIGNATURE, dtype=np.int32)
                signatures = pa.ListArray.from_arrays(pa.array(ends), pa.array(marks.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([True] * len(rows)), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), signatures], names)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            empty = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(part), bool)), pa.array(part), pa.array(counts[part]), empty, pa.nulls(len(part), pa.list_(pa.int32()))], names
            )

    table = written(docs.select("doc_id", "text").mapInArrow(scan, "document boolean, doc_id long, n long, key long, signature array<int>"), "profile")
    got = table.where("not document").groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()  # 2**sketch_bits rows at most
    sketch = np.zeros(1 << sketch_bits, np.int64)
    sketch[got["doc_id"].to_numpy()] = got["n"].to_numpy()
    return table.where("document").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("set_key"), "signature"), sketch


class Prefix:
    """Adaptive prefix of a set under the sketch's order."""

    def __init__(self, sketch: np.ndarray, percent: int):
        self.sketch, self.percent = sketch, percent
        self.shift = np.uint64(64 - int(np.log2(len(sketch))))
        self.floor = sketch.mean() + 3 * np.sqrt(sketch.mean()) if len(sketch) else 0

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """(48-bit keys of the prefix in their order, shared keys that it asks for)."""
        n = len(s)
        overlap = -(-self.percent * n // 100)
        most = min(MOST_MATCHES, overlap)
        weight = self.sketch[(s >> self.shift).astype(np.int64)]
        reach = n - overlap + most
        order = np.lexsort((s, weight))[:reach]
        cost = np.cumsum(np.maximum(weight[order] - self.floor, 0))
        need = min(range(1, most + 1), key=lambda m: cost[n - overlap + m - 1] / m + m - 1)
        return (s[order[: n - overlap + need]] >> _SHARED).view(np.int64), need


def _postings(docs: DataFrame, prefix: Prefix, k: int) -> DataFrame:
    """(token, doc_id, size, need, pos): the keys of all prefixes with the document's size, the matches it asks for and the key's position."""
    shared = docs.sparkSession.sparkContext.broadcast(prefix)
    names = ["token", "doc_id", "size", "need", "pos"]

    def scan(batches):
        prefix = shared.value
        for batch in batches:
            keys, owners = [], []
            for doc_id, s in _sets(batch, k):
                if doc_id is not None and len(s):
                    found, need = prefix(s)
                    keys.append(found)
                    owners.append((doc_id, len(s), need))
            if keys:
                lengths = [len(x) for x in keys]
                ids, sizes, needs = (np.repeat(np.array(x, np.int64), lengths) for x in zip(*owners, strict=True))
                pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
                columns = [np.concatenate(keys), ids, sizes.astype(np.int32), needs.astype(np.int32), pos]
                for i in range(0, len(ids), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in columns], names)

    return docs.select("doc_id", "text").mapInArrow(scan, "token long, doc_id long, size int, need int, pos int")


_POS_BITS, _NEED_BITS = 30, 3  # a text of 2**31 bytes has fewer than 2**30 words; need is MOST_MATCHES at most


def _place(size: str, need: str, pos: str):
    """Size, need and position in one long, so that a shuffled posting is short."""
    return F.shiftleft(F.shiftleft(F.col(size).cast("long"), _NEED_BITS).bitwiseOR(F.col(need)), _POS_BITS).bitwiseOR(F.col(pos))


def _unplaced(rows: DataFrame, side: str, place: str = "place") -> DataFrame:
    """The rows with the columns n, m and p of a side (size, need and position) in place of a ``_place``."""
    low = lambda column, bits: column.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    found = {f"n{side}": F.shiftright(place, _NEED_BITS + _POS_BITS).cast("int"), f"m{side}": low(F.shiftright(place, _POS_BITS), _NEED_BITS), f"p{side}": low(F.col(place), _POS_BITS)}
    return rows.withColumns(found).drop(place)


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the documents with these ids."""

    def scan(batches):
        for batch in batches:
            rows = [(d, s.view(np.int64)) for d, s in _sets(batch, k)]
            for i in range(0, len(rows), 1000):
                doc_ids, sets = zip(*rows[i : i + 1000], strict=True)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["doc_id", "shingles"])

    return with_ids(docs.select("doc_id", "text"), ids, ["doc_id"]).mapInArrow(scan, "doc_id long, shingles array<long>")


def _verified(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough. Sets are only fetched where the signatures allow it."""
    left, right = (signatures.select(F.col("doc_id").alias(x), F.col("size").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab")
    most = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    pairs = pairs.join(left, "a").join(right, "b").where(100 * most >= percent * (F.col("na") + F.col("nb") - most)).select("a", "b")
    pairs = written(pairs, "candidates")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked")
    sets = _sets_of(docs, asked, k)
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    same = F.size(F.array_intersect("sa", "sb"))
    same = pairs.join(right, "b").join(left, "a").select("a", "b", same.alias("same"), (F.size("sa") + F.size("sb")).alias("both"))
    found = written(same.where(100 * F.col("same") >= percent * (F.col("both") - F.col("same"))).select("a", "b"), "verified")
    discard(pairs, asked)
    return found


def _possible(percent: int):
    """Sizes, and the positions of one of the first shared shingles, that allow the similarity."""
    overlap = F.ceil((F.col("na") + F.col("nb")) * (percent / (100 + percent)) - 1e-6)
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return near & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= overlap - F.least("ma", "mb") + 1)


def _open_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough of their prefixes.

    a is the smaller set. The m-th shared shingle of a similar pair lies so early that, of each set, at least
    T - m + 1 shingles are left from there on, T = percent / (100 + percent) * (size a + size b) being the overlap that
    the pair needs. So a shingle of b at some position only serves partners below a certain size, and the join is by
    shingle and class of size: sets that differ from a common text in many shingles of their own, and so share only
    late ones, do not meet at all.
    """
    share = percent / (100 + percent)
    # a wider class adds few pairs at its ends, and far fewer copies of each posting
    tier = lambda size: F.floor(F.log(size) / np.log(1.1))
    named = lambda rows, x, *more: rows.select("token", *more, F.col("doc_id").alias(x), F.col("root").alias(f"r{x}"), F.col("place").alias(f"place{x}"))
    sized = _unplaced(placed.withColumn("at", F.col("place")), "x", "at")
    rest = F.col("nx") - F.col("px") + F.col("mx") - 1
    # T >= 2 * share * size for the smaller set
    left = named(sized.where(rest >= F.ceil(F.col("nx") * (2 * share) - 1e-6)), "a", tier(F.col("nx")).alias("tier"))
    most = F.least(F.floor(rest / share + 1e-6) - F.col("nx"), F.col("nx"))
    least = F.ceil(F.col("nx") * (percent / 100) - 1e-6)
    right = named(sized.withColumn("most", most).where(F.col("most") >= least), "b", F.explode(F.sequence(tier(least), tier(F.col("most")))).alias("tier"))
    once = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    fits = once & (F.col("ra") != F.col("rb")) & _possible(percent)
    met = _unplaced(_unplaced(left.join(right, ["token", "tier"]), "a", "placea"), "b", "placeb")
    return met.where(fits).groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.least("ma", "mb")).alias("need")).where("n >= need").select("a", "b")


def links(docs: DataFrame, k: int = 5, percent: int = 80, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(profile of every document, links (a, b) that connect each class of similar documents)."""
    base, sketch = profile(docs, k, sketch_bits)
    prefix = Prefix(sketch, percent)

    # copies: a star around the least document of each set, which alone goes on
    known = base.where("set_key is not null and doc_id is not null")
    first = known.groupBy("set_key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("hi")).where("a < hi").drop("hi")
    copies = written(known.join(first, "set_key").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "copies")
    # an id that stands for several sets goes on with all of them
    single = known.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo = hi")
    settled = written(copies.select(F.col("b").alias("doc_id")).distinct().join(single, "doc_id", "left_semi"), "settled")
    firsts = with_ids(docs.select("doc_id", "text"), settled, ["doc_id"], "left_anti")

    # keys of more than one posting, counted partly before the shuffle; postings go to their keys as two longs
    prefixes = written(_postings(firsts, prefix, k), "prefixes")
    shared = prefixes.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    packed = prefixes.select("token", "doc_id", _place("size", "need", "pos").alias("place"))
    postings = written(packed.join(shared.hint("merge"), "token"), "postings")
    discard(prefixes, settled)
    open_ids = postings.select("doc_id").distinct()
    signatures = written(base.select("doc_id", F.col("n_shingles").alias("size"), "signature").join(open_ids, "doc_id", "left_semi"), "signatures")

    # the most central document of a token: most of its prefix is shared
    central = postings.groupBy("doc_id").agg(F.count("*").alias("degree"))
    hub = postings.join(central, "doc_id").groupBy("token").agg(F.max(F.struct("degree", -F.col("doc_id"), "place")).alias("hub"))
    hub = hub.select("token", (-F.col("hub.col2")).alias("a"), F.col("hub.place").alias("placea"))
    star = postings.select("token", F.col("doc_id").alias("b"), F.col("place").alias("placeb")).join(hub, "token").where("a <> b")
    star = _unplaced(_unplaced(star, "a", "placea"), "b", "placeb")
    star = star.where(_possible(percent)).groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.least("ma", "mb")).alias("need"))
    # pairs that share fewer keys of this hub than their prefixes ask for wait for the open pairs, where all keys count
    star = written(star.where("n >= need"), "star")

    # first each document with the hub that it shares most with, then the hubs that are not yet in its component
    best = star.groupBy("b").agg((-F.max(F.struct("n", -F.col("a")))["col2"]).alias("a")).select("a", "b")
    roots = written(components(_verified(best, signatures, docs, k, percent).unionByName(copies)), "roots")
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    rest = star.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    found = written(_verified(rest, signatures, docs, k, percent).unionByName(_edges(roots)), "links")
    discard(star, roots)
    roots = written(components(found), "roots")

    # what the stars leave: pairs of different components
    placed = postings.join(roots, postings["doc_id"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "doc_id"))
    open_tokens = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    placed = written(placed.join(open_tokens, "token"), "open-postings")
    discard(postings)
    more = written(_verified(_open_pairs(placed, percent), signatures, docs, k, percent).unionByName(_edges(roots)), "links")
    discard(placed, signatures, found, roots, copies)
    return base.drop("signature"), more


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id: the least doc_id that the document reaches by links, itself included."""
    base, found = links(docs, k, percent)
    roots = components(found)
    return base.join(roots, base["doc_id"] == roots["node"], "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def one_per_class(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the first of their class; documents without an id stay, and so do all rows of a first document's id."""
    with only(docs.sparkSession, "away") as keep:
        away = keep(near_duplicates(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct())
    return with_ids(docs, away, ["doc_id"], "left_anti")
