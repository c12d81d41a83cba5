"""Character similarity of texts of a family: twice the characters in recursively longest matching blocks, by both lengths.

Texts meet in products of a panel of queries with a slice of their family, both of bounded size; small families share a
product. Two upper bounds come first: the lengths (no more characters than the shorter text has can match) and the
characters' counts. Only pairs that both leave above the floor are compared, very many at once, and a pair is given up as
soon as the parts that are left cannot lift it to the floor.

Edge cases: null texts and ids take no part; two empty texts have the ratio 1; equal ratios go by id; a null family is a
family.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.storage import importable, written

PANEL, SLICE = 64, 512
#: Runs of two texts that are kept, some 16 MB; equal characters of pairs that are compared at once, about; a length that fits into 21 bits.
CELLS, TOGETHER, LONGEST = 1 << 22, 1 << 19, (1 << 21) - 1
#: In a text of so many characters, those that make up more than a hundredth of it begin no block.
LONG = 200


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _popular(b: np.ndarray) -> np.ndarray:
    values, place, n = np.unique(b, return_inverse=True, return_counts=True)
    return (n > len(b) // 100 + 1)[place] if len(b) >= LONG else np.zeros(len(b), bool)


def _runs(a: np.ndarray, part: np.ndarray, free: np.ndarray):
    """For each character of a: lengths of the common runs that end at it and at each character of the other text."""
    run = np.zeros(len(part) + 1, np.int32)
    for x in a:
        run[1:] = np.where((part == x) & free, run[:-1] + 1, 0)
        yield run[1:]


def matching(a: np.ndarray, b: np.ndarray) -> int:
    """Characters in matching blocks: the longest one (first in a, then in b), then the same left and right of it.

    The runs of the whole texts are kept if they fit into CELLS; a part of them is then one look at a rectangle, whose
    edges cut runs short. Of longer texts every part makes its runs again, row by row.
    """
    popular = _popular(b)
    held = np.array([r.copy() for r in _runs(a, b, ~popular)], np.int32) if 0 < len(a) * len(b) <= CELLS else None

    def longest(a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """Size, and where it begins in a and in b."""
        if held is not None:
            inside = np.minimum(held[a0:a1, b0:b1], np.arange(1, b1 - b0 + 1, dtype=np.int32))
            np.minimum(inside, np.arange(1, a1 - a0 + 1, dtype=np.int32)[:, None], out=inside)
            i, j = divmod(int(inside.argmax()), b1 - b0)
            size = int(inside[i, j])
            return size, a0 + i - size + 1, b0 + j - size + 1
        size, at_a, at_b = 0, a0, b0
        for i, run in enumerate(_runs(a[a0:a1], b[b0:b1], ~popular[b0:b1])):
            if (most := int(run.max())) > size:
                size, at_a, at_b = most, a0 + i - most + 1, b0 + int(run.argmax()) - most + 1
        return size, at_a, at_b

    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        size, at_a, at_b = longest(a0, a1, b0, b1)
        if not size:
            at_a, at_b = a0, b0
        while at_a > a0 and at_b > b0 and a[at_a - 1] == b[at_b - 1]:
            at_a, at_b, size = at_a - 1, at_b - 1, size + 1
        while at_a + size < a1 and at_b + size < b1 and a[at_a + size] == b[at_b + size]:
            size += 1
        if size:
            total += size
            todo += [(a0, at_a, b0, at_b), (at_a + size, a1, at_b + size, b1)]
    return total


def ratio(a: np.ndarray, b: np.ndarray) -> float:
    return 2.0 * matching(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0


class _Texts:
    """Texts one after the other, as places in an alphabet, with an ``end`` after each that equals no character of the other side."""

    def __init__(self, texts: list[np.ndarray], alphabet: np.ndarray, end: int):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.first = 1 + np.cumsum(self.lengths + 1) - self.lengths - 1
        self.flat = np.full(1 + int((self.lengths + 1).sum()), end, np.int32)
        own = np.repeat(np.arange(len(texts)), self.lengths)
        at = np.arange(len(own)) + own + 1
        self.flat[at] = np.searchsorted(alphabet, np.concatenate([*texts, np.empty(0, np.uint32)]))
        count = lambda rows: np.bincount(own[rows] * len(alphabet) + self.flat[at[rows]], minlength=len(texts) * len(alphabet)).reshape(len(texts), -1)
        self.counts = count(slice(None))
        # which characters may begin a block, and their places by text and character
        rare = np.where(self.lengths[:, None] >= LONG, self.counts <= self.lengths[:, None] // 100 + 1, True)
        free = np.flatnonzero(rare[own, self.flat[at]])
        self.free = np.zeros(len(self.flat), bool)
        self.free[at[free]] = True
        self.free_counts = count(free)
        self.places = at[free[np.argsort(own[free] * len(alphabet) + self.flat[at[free]], kind="stable")]]
        self.ends = np.cumsum(self.free_counts.ravel())


def _spans(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n[0] + n[1] + ... things: which span it is of, and its place there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _all_matching(mine: _Texts, theirs: _Texts, q: np.ndarray, t: np.ndarray, need: np.ndarray) -> np.ndarray:
    """``matching`` of the pairs (q, t), all at once; a pair that cannot reach ``need`` has some number below it.

    The common runs of a pair are made once. A round takes the longest run inside each open part, as its edges cut it,
    and goes on with the parts left and right of it.
    """
    a, b, free = mine.flat, theirs.flat, theirs.free
    of, i = _spans(mine.lengths[q])
    i += mine.first[q][of]
    cell = t[of] * theirs.counts.shape[1] + a[i]
    n = theirs.free_counts.ravel()[cell]
    which, nth = _spans(n)
    pair, i, j = of[which], i[which], theirs.places[(theirs.ends[cell] - n)[which] + nth]
    begins = ~((a[i - 1] == b[j - 1]) & free[j - 1])
    part, i, j = pair[begins], i[begins], j[begins]
    n, on = np.ones(len(i), np.int64), np.arange(len(i))
    while len(on):
        x, y = i[on] + n[on], j[on] + n[on]
        on = on[(a[x] == b[y]) & free[y]]
        n[on] += 1

    total, pair = np.zeros(len(q), np.int64), np.arange(len(q))
    a0, b0 = mine.first[q], theirs.first[t]
    a1, b1 = a0 + mine.lengths[q], b0 + theirs.lengths[t]
    while len(pair):
        skip = np.maximum(np.maximum(a0[part] - i, b0[part] - j), 0)
        size = np.minimum(np.minimum(n, a1[part] - i), b1[part] - j) - skip
        inside = np.flatnonzero(size > 0)
        i, j, n, part, skip, size = i[inside], j[inside], n[inside], part[inside], skip[inside], size[inside]
        # the longest, then the first in a, then the first in b
        x, y, best = a0.copy(), b0.copy(), np.zeros(len(pair), np.int64)
        if len(part):
            key = size << 42 | (LONGEST - (i + skip - a0[part])) << 21 | (LONGEST - (j + skip - b0[part]))
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            key, at = np.maximum.reduceat(key, heads), part[heads]
            best[at], x[at], y[at] = key >> 42, a0[at] + LONGEST - (key >> 21 & LONGEST), b0[at] + LONGEST - (key & LONGEST)
        u, v = x + best, y + best
        on = np.flatnonzero(best)
        while len(on := on[(x[on] > a0[on]) & (y[on] > b0[on]) & (a[x[on] - 1] == b[y[on] - 1])]):
            x[on], y[on] = x[on] - 1, y[on] - 1
        on = np.arange(len(pair))
        while len(on := on[(u[on] < a1[on]) & (v[on] < b1[on]) & (a[u[on]] == b[v[on]])]):
            u[on], v[on] = u[on] + 1, v[on] + 1
        total += np.bincount(pair, u - x, len(q)).astype(np.int64)
        left, right = (u > x) & (x > a0) & (y > b0), (u > x) & (a1 > u) & (b1 > v)
        most = np.where(left, np.minimum(x - a0, y - b0), 0) + np.where(right, np.minimum(a1 - u, b1 - v), 0)
        alive = (total + np.bincount(pair, most, len(q)) >= need)[pair]
        left, right = left & alive, right & alive
        # runs go to the parts that they may reach into; left parts first, so they stay in order
        to_left, to_right = np.cumsum(left) - 1, np.cumsum(right) - 1 + left.sum()
        in_left, in_right = np.flatnonzero(left[part] & (i < x[part]) & (j < y[part])), np.flatnonzero(right[part] & (i + n > u[part]) & (j + n > v[part]))
        part = np.r_[to_left[part[in_left]], to_right[part[in_right]]]
        i, j, n = (np.r_[z[in_left], z[in_right]] for z in (i, j, n))
        pair, a0, a1, b0, b1 = np.r_[pair[left], pair[right]], np.r_[a0[left], u[right]], np.r_[x[left], a1[right]], np.r_[b0[left], v[right]], np.r_[y[left], b1[right]]
    return total


def _near(mine: list[np.ndarray], theirs: list[np.ndarray], may: list[np.ndarray], floor: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of mine: which of the texts it may meet reach the floor, and their ratios."""
    alphabet = np.unique(np.concatenate([*mine, *theirs]))
    a, b = _Texts(mine, alphabet, -1), _Texts(theirs, alphabet, -2)
    q, t = [], []
    for k, some in enumerate(may):
        both = a.lengths[k] + b.lengths[some]
        some = some[np.where(both > 0, 2.0 * np.minimum(a.lengths[k], b.lengths[some]) / np.maximum(both, 1), 1.0) >= floor]
        both = a.lengths[k] + b.lengths[some]
        some = some[np.where(both > 0, 2.0 * np.minimum(a.counts[k], b.counts[some]).sum(axis=1) / np.maximum(both, 1), 1.0) >= floor]
        q.append(np.full(len(some), k))
        t.append(some)
    q, t = np.concatenate(q), np.concatenate(t).astype(np.int64)
    both = a.lengths[q] + b.lengths[t]
    # equal characters of a pair, and the pair's own places
    cells = np.concatenate([b.free_counts[some] @ a.counts[k] for k, some in enumerate(np.split(t, np.searchsorted(q, np.arange(1, len(mine)))))]) + a.lengths[q]
    found = np.zeros(len(q), np.int64)
    large = (cells > CELLS) | (np.maximum(a.lengths[q], b.lengths[t]) >= LONGEST)
    for k in np.flatnonzero(large):
        found[k] = matching(mine[q[k]], theirs[t[k]])
    small = np.flatnonzero(~large)
    for some in np.split(small, np.flatnonzero(np.diff(np.cumsum(cells[small]) // TOGETHER)) + 1):
        # one less, as the floor is compared after a division
        found[some] = _all_matching(a, b, q[some], t[some], np.floor(floor * both[some] / 2) - 1)
    ratios = np.where(both > 0, 2.0 * found / np.maximum(both, 1), 1.0)
    kept = ratios >= floor
    ends = np.searchsorted(q[kept], np.arange(1, len(mine)))
    return list(zip(np.split(t[kept], ends), np.split(ratios[kept], ends), strict=True))


def similar(rows: DataFrame, asked: Column, floor: float) -> DataFrame:
    """(id, similar, other, ratio) for each row (id long, family, text) that fulfils ``asked``: how many other rows of its
    family reach ``floor``, and the best of them."""
    spark = rows.sparkSession
    importable(spark)
    rows = written(rows.where("id is not null and text is not null").select("id", "family", "text", F.coalesce(asked, F.lit(False)).alias("asked")), "texts")
    key = F.coalesce(F.concat(F.lit("="), F.col("family").cast("string")), F.lit(""))
    sizes = rows.groupBy("family").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SLICE).alias("slices"), F.ceil(F.count_if("asked") / PANEL).alias("panels")).where("panels > 0")
    # families of one panel and one slice share products of about a slice
    alone = F.expr("slices > 1 OR panels > 1")
    bins = sizes.where(~alone).agg(F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / SLICE)).first()[0] or 1
    sizes = sizes.select(F.col("family").alias("of"), "slices", "panels", F.when(alone, key).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64(key), F.lit(bins)).cast("string"))).alias("product"))
    sized = rows.join(sizes, F.col("family").eqNullSafe(F.col("of"))).drop("of").withColumn("family", key)
    dealt = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = sized.where("asked").select("product", "family", "id", "text", dealt("panel", "panels").alias("panel"), every("slices").alias("slice"))
    right = sized.select("product", "family", "id", "text", dealt("slice", "slices").alias("slice"), every("panels").alias("panel"))
    right = right.toDF("product_of", "other_family", "other", "other_text", "slice_of", "panel_of")
    schema = pa.schema([("id", pa.int64()), ("similar", pa.int64()), ("other", pa.int64()), ("ratio", pa.float64())])

    def product(panel: pa.Table, part: pa.Table) -> pa.Table:
        if not panel.num_rows or not part.num_rows:
            return schema.empty_table()
        mine, theirs = [codes(t) for t in panel.column("text").to_pylist()], [codes(t) for t in part.column("other_text").to_pylist()]
        asked_ids, ids, out = panel.column("id").to_pylist(), part.column("other").to_numpy(), []
        families = part.column("other_family").combine_chunks().dictionary_encode()
        members = {f: np.flatnonzero(families.indices.to_numpy() == k) for k, f in enumerate(families.dictionary.to_pylist())}
        may = [m[ids[m] != id_] for id_, f in zip(asked_ids, panel.column("family").to_pylist(), strict=True) for m in [members[f]]]
        for id_, (at, ratios) in zip(asked_ids, _near(mine, theirs, may, floor), strict=True):
            if len(at):
                best = np.lexsort((ids[at], -ratios))[0]
                out.append((id_, len(at), int(ids[at[best]]), float(ratios[best])))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else schema.empty_table()

    # few bytes, much work: the groups are spread whatever their size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    left, right = left.repartition(parts, "product", "slice", "panel"), right.repartition(parts, "product_of", "slice_of", "panel_of")
    pairs = left.groupBy("product", "slice", "panel").cogroup(right.groupBy("product_of", "slice_of", "panel_of"))
    found = pairs.applyInArrow(product, "id long, similar long, other long, ratio double")
    best = F.struct(-F.col("ratio"), "other")
    merged = found.groupBy("id").agg(F.sum("similar").alias("similar"), F.min_by("other", best).alias("other"), F.max("ratio").alias("ratio"))
    return rows.where("asked").select("id").join(merged, "id", "left").withColumn("similar", F.coalesce("similar", F.lit(0)))
