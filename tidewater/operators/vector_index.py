"""An inverted-file vector index as a partitioned table, for top-k search and for similarity above a floor.

Centroids are fitted on a bounded sample chosen by hash; every row is filed under its nearest one, sorted by its angle to
it, and packed into blocks of bounded size that know the least and the greatest angle of their rows (a ring). By the
triangle inequality of angles, a row within ``reach`` of a query lies in a ring that meets the query's own angle +- reach.
So a search above a floor reads only such rings and loses nothing. A top-k search first reads the lists nearest to the
query; its k-th score is then a reach, and reading the rings within it makes the result exact. Without that second step
recall depends on the number of probes, which ``probes_for`` measures.

Consecutive blocks make a slice of bounded size. A query travels to a slice once, whatever it reads of it, in a panel of
its scope; a task multiplies parts of a panel with the blocks that any of them meets, and no more than the top-k of a query
in a slice leaves it. A list that holds a third of all rows is only more slices.

Edge cases: rows and queries with a null vector or a non-finite entry take no part; a zero vector has the score 0 with
everything and is kept in a list of its own, which every query reads; equal scores go by id; a null scope of a query
meets all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import pi

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidewater.storage import SMALL_ROWS, importable, new_path, written

#: Bounds: rows that centroids are fitted on, rows of a block and of a slice (of small tables and at most), queries of a panel (about) and of a product, angles of a ring (radians).
SAMPLE_ROWS, BLOCK_ROWS, SLICE_ROWS, SLICE_MOST, PANEL_ROWS, PART_ROWS, RING = 16384, 2048, 8192, 65536, 4096, 256, 0.05
#: Rounded scores (4 digits) and angles in doubles: what a reach is widened by.
SLACK = 1e-4
_ZERO = -1
_BLOCK = "slice long, list int, scope string, lo double, hi double, n int, ids binary, copies binary, vectors binary"


@dataclass(frozen=True)
class Index:
    """Where the blocks are, the centroids, the ring of each list (least and greatest angle), and the type of the vectors' entries."""

    path: str
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    item: str = "<f8"

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"block long, {_BLOCK}").parquet(self.path)


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ centroids.T, -1.0, 1.0))


def spherical_means(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors; an empty one is begun again from the vector that is furthest from its own."""
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.ones((1, x.shape[1])) / np.sqrt(x.shape[1])
    centroids = np.unique(x, axis=0)
    centroids = centroids[np.random.default_rng(1).permutation(len(centroids))[:lists]]
    for _ in range(rounds):
        near = x @ centroids.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.linalg.norm(sums, axis=1) < 1e-12
        sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: empty.sum()]]
        centroids = _unit(sums)
    return centroids


def build(rows: DataFrame, lists: int | None = None, path: str | None = None, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> Index:
    """Index of rows (id long, vector array, optionally scope string and copies long); about the root of their number of lists."""
    spark = rows.sparkSession
    importable(spark)
    path = path or new_path(spark, "vector-index")
    for name, default in (("scope", F.lit(None).cast("string")), ("copies", F.lit(1).cast("long"))):
        rows = rows if name in rows.columns else rows.withColumn(name, default)
    rows = rows.where(usable("vector") & F.col("id").isNotNull()).select("id", "scope", "copies", "vector")
    n = rows.count()
    at = F.xxhash64("id", F.lit(5))
    # the bound from the ids alone: a sample of vectors of every part would be shuffled
    most = rows.select(at.alias("at")).orderBy("at").limit(sample_rows).agg(F.max("at")).first()[0]
    sample = rows.where(at <= F.lit(most).cast("long")).orderBy(at, "id").limit(sample_rows).select("vector").toArrow()
    x = _unit(_matrix(sample.column("vector").combine_chunks())) if sample.num_rows else np.ones((1, 1))
    centroids = spherical_means(x, lists or max(1, min(round(n**0.5), len(x) // 8)))

    def filed(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"))
                angle = angles(x, centroids)
                own = angle.argmin(axis=1)
                zero = ~x.any(axis=1)
                least = np.where(zero, 0.0, angle[np.arange(len(x)), own])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(zero, _ZERO, own), pa.int32()), pa.array(least)], [*batch.schema.names, "list", "angle"])

    # entries are written as wide as they came, and slices grow with the table, so that queries travel to no more of them
    item = "<f4" if rows.schema["vector"].dataType.elementType == FloatType() else "<f8"
    slice_rows = max(SLICE_ROWS, min(SLICE_MOST, n // (2 * spark.sparkContext.defaultParallelism)))
    kinds = f"id long, scope string, copies long, vector {rows.schema['vector'].dataType.simpleString()}, list int, angle double"
    order = ["scope", "list", "angle", "id"]
    schema = pa.schema([("slice", pa.int64()), ("list", pa.int32()), ("scope", pa.string()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])

    def packed(batches):
        """Blocks of consecutive rows: full, or at the end of their list, scope or ring. Slices end with their scope."""
        held: list[tuple] = []
        task, scope_of, filled = TaskContext.get().partitionId() << 32, "", slice_rows

        def block():
            nonlocal task, scope_of, filled
            if held[0][0][1] != scope_of or filled + len(held) > slice_rows:
                task, scope_of, filled = task + 1, held[0][0][1], 0
            filled += len(held)
            key, first, last, ids, copies, x = held[0][0], held[0][1], held[-1][1], *zip(*(h[2:] for h in held), strict=True)
            row = (task, key[0], key[1], first, last, len(held), np.array(ids, "<i8").tobytes(), np.array(copies, "<i8").tobytes(), np.array(x, item).tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            x = _matrix(batch.column("vector")) if batch.num_rows else ()
            for list_, scope, angle, id_, copies, v in zip(*(batch.column(c).to_pylist() for c in ("list", "scope", "angle", "id", "copies")), x, strict=True):
                if held and (held[0][0] != (list_, scope) or len(held) >= block_rows or angle > held[0][1] + RING):
                    yield block()
                held.append(((list_, scope), angle, id_, copies, v))
        if held:
            yield block()

    blocks = rows.mapInArrow(filed, kinds).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, _BLOCK)
    found = written(blocks.withColumn("block", F.monotonically_increasing_id()).select("block", *[c.split()[0] for c in _BLOCK.split(", ")]), "vector-index", path)
    low, high = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf)
    for r in found.groupBy("list").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # a row for each list
        if r["list"] != _ZERO:
            low[r["list"]], high[r["list"]] = r["lo"], r["hi"]
    return Index(path, centroids, low, high, item)


def _met(index: Index, x: np.ndarray, reach: np.ndarray, probes: int | None, blocks: pa.Table) -> np.ndarray:
    """Which blocks each query reads: those of its ``probes`` nearest lists, or whose ring its reach meets; zero vectors meet and are met by all."""
    angle, lists = angles(x, index.centroids), blocks.column("list").to_numpy()
    own = angle[:, np.maximum(lists, 0)]
    if probes is None:
        near = (blocks.column("lo").to_numpy() <= own + reach[:, None]) & (blocks.column("hi").to_numpy() >= own - reach[:, None]) | ~x.any(axis=1)[:, None]
    else:
        chosen = np.zeros(angle.shape, bool)
        np.put_along_axis(chosen, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
        near = chosen[:, np.maximum(lists, 0)]
    return near | (lists == _ZERO)


def _scored(index: Index, queries: DataFrame, probes: int | None, pick: Callable, kinds: str) -> DataFrame:
    """``pick`` (query ids, scores, ids, copies, lists) over the products of panels of queries with slices; what a query does not meet scores -inf."""
    spark = queries.sparkSession
    importable(spark)
    blocks = index.blocks(spark)
    slices = blocks.select("slice", F.col("scope").alias("theirs")).distinct()
    schema = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[t]) for n, t in (x.split() for x in kinds.split(", "))])
    scoped = queries.withColumn("scope_key", F.coalesce(F.concat(F.lit("="), "scope"), F.lit("")))
    panels = scoped.groupBy("scope_key").agg(F.ceil(F.count("*") / PANEL_ROWS).alias("panels"))
    dealt = written(scoped.join(panels, "scope_key").withColumn("panel", F.concat_ws(":", F.pmod(F.xxhash64("query_id"), F.col("panels")).cast("string"), "scope_key")).drop("panels", "scope_key"), "panels")
    meets = F.col("scope").isNull() | (F.col("scope") == F.col("theirs"))
    groups = dealt.select("panel", "scope").distinct().join(slices, meets).select("panel", "slice")
    # a row for a product; while they are few they go to the tasks, so that blocks are shuffled once
    groups = F.broadcast(groups) if groups.count() <= SMALL_ROWS else groups
    left = dealt.join(groups, "panel").select("slice", "panel", "query_id", "vector", "reach")
    right = blocks.join(groups, "slice").select("slice", "panel", "list", "lo", "hi", "n", "ids", "copies", "vectors").withColumnsRenamed({"slice": "slice_of", "panel": "panel_of"})

    def product(panel: pa.Table, part: pa.Table) -> pa.Table:
        if not panel.num_rows or not part.num_rows:
            return schema.empty_table()
        flat = lambda name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind)
        sizes = part.column("n").to_numpy()
        ids, copies, of = flat("ids", "<i8"), flat("copies", "<i8"), np.repeat(np.arange(len(sizes)), sizes)
        rows, lists = flat("vectors", index.item).astype(np.float64).reshape(len(ids), -1), part.column("list").to_numpy()
        norms, asked = np.linalg.norm(rows, axis=1), panel.column("query_id").to_numpy()
        x, reach = _matrix(panel.column("vector").combine_chunks()), panel.column("reach").to_numpy()
        met, out = _met(index, x, reach, probes, part), []
        for first in range(0, len(x), PART_ROWS):
            some = first + np.flatnonzero(met[first : first + PART_ROWS].any(axis=1))
            on = np.flatnonzero(met[some].any(axis=0)[of]) if len(some) else some
            if not len(on):
                continue
            length = np.linalg.norm(x[some], axis=1)[:, None] * norms[on][None, :]
            score = np.divide(x[some] @ rows[on].T, length, out=np.zeros_like(length), where=length > 0)
            score = np.floor(score * 1e4 + 0.5) / 1e4
            score[~met[np.ix_(some, of[on])]] = -np.inf
            out.append(pick(asked[some], score, ids[on], copies[on], lists[of[on]]))
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    # few bytes, much work: the groups are spread whatever their size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    left, right = left.repartition(parts, "slice", "panel"), right.repartition(parts, "slice_of", "panel_of")
    return left.groupBy("slice", "panel").cogroup(right.groupBy("slice_of", "panel_of")).applyInArrow(product, kinds)


def _queries(queries: DataFrame, reach: Column) -> DataFrame:
    queries = queries if "scope" in queries.columns else queries.withColumn("scope", F.lit(None).cast("string"))
    return queries.where(usable("vector") & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "scope", "vector", reach.alias("reach"))


def _reach(score: Column) -> Column:
    """The angle within which every row of at least this rounded score lies."""
    low = score - SLACK
    return F.when(low <= -1, F.lit(pi)).otherwise(F.acos(F.least(low, F.lit(1.0)))) + 1e-7


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """(query_id, id, score, list, rank): each query's best k rows by cosine; exact, or from its nearest ``probes`` lists alone."""

    def best(query_ids, score, ids, _, lists):
        by_id = np.argsort(ids, kind="stable")
        # one whole number for each place: score first, then id
        place = np.where(np.isfinite(score[:, by_id]), np.rint((1 - np.maximum(score[:, by_id], -1)) * 1e4), 1e5) * len(ids) + np.arange(len(ids))
        few = min(k, len(ids))
        first = np.sort(np.partition(place, few - 1, axis=1)[:, :few], axis=1).astype(np.int64)
        order = by_id[first % len(ids)]
        found = np.take_along_axis(score, order, 1).ravel()
        kept = np.isfinite(found)
        columns = np.repeat(query_ids, few)[kept], ids[order].ravel()[kept], found[kept], lists[order].ravel()[kept].astype(np.int32)
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["query_id", "id", "score", "list"])

    def top(found):
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    kinds = "query_id long, id long, score double, list int"
    asked = _queries(queries, F.lit(pi))
    first = top(_scored(index, asked, probes, best, kinds))
    if not exact:
        return first
    kth = written(first.where(F.col("rank") == k).select("query_id", _reach(F.col("score")).alias("kth")), "kth")
    asked = written(asked.join(kth, "query_id", "left").withColumn("reach", F.coalesce("kth", "reach")).drop("kth"), "asked")
    return top(_scored(index, asked, None, best, kinds))


def above(index: Index, queries: DataFrame, floor: float, but: tuple[str, str] = ("query_id", "id")) -> DataFrame:
    """(query_id, links, other, score): how many rows (copies counted) of another id reach ``floor``, and the best of them."""

    def linked(query_ids, score, ids, copies, _):
        hit = (score >= floor) & (query_ids[:, None] != ids[None, :])
        some = np.flatnonzero(hit.any(axis=1))
        score, hit = np.where(hit, score, -np.inf)[some], hit[some]
        best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, 0] if len(some) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(query_ids[some]), pa.array((hit * copies).sum(axis=1)), pa.array(ids[best]), pa.array(score[np.arange(len(some)), best])], ["query_id", "links", "other", "score"])

    found = _scored(index, _queries(queries, _reach(F.lit(float(floor)))), None, linked, "query_id long, links long, other long, score double")
    place = F.struct(-F.col("score"), "other")
    return found.groupBy("query_id").agg(F.sum("links").alias("links"), F.min_by("other", place).alias("other"), F.max("score").alias("score"))


def probes_for(index: Index, queries: DataFrame, k: int, target: float = 0.95, most: int = 256) -> int:
    """Lists to read for a recall of ``target``, by the true neighbours of up to ``most`` queries chosen by hash."""
    sample = queries.orderBy(F.xxhash64("query_id", F.lit(9)), "query_id").limit(most)
    true = search(index, sample, k).where(F.col("list") >= 0).join(sample.select("query_id", "vector"), "query_id").select("query_id", "vector", "list").toArrow()  # at most k * most rows
    if not true.num_rows:
        return 1
    angle = angles(_matrix(true.column("vector").combine_chunks()), index.centroids)
    lists = true.column("list").to_numpy()
    place = (angle < angle[np.arange(len(lists)), lists][:, None]).sum(axis=1)
    return int(np.quantile(place, target, method="higher")) + 1


def duplicates(rows: DataFrame, asked: Column, floor: float = 0.95, lists: int | None = None) -> DataFrame:
    """(id, similar, other, score) for each row (id, scope, vector) that fulfils ``asked``: how many other rows of its scope
    reach ``floor``, and the best of them; null without one.

    Copies are one row of the index with their number, so a vector that a third of all rows have is one row. A null scope
    is a scope of its own.
    """
    scope = F.coalesce(F.concat(F.lit("="), "scope"), F.lit(""))
    same = rows.where(usable("vector") & F.col("id").isNotNull()).withColumn("asked", F.coalesce(asked, F.lit(False))).withColumn("scope", scope)
    copies = written(same.groupBy("scope", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.bool_or("asked").alias("asked")), "vector-copies")
    index = build(copies, lists)
    found = above(index, copies.where("asked").select(F.col("id").alias("query_id"), "scope", "vector"), floor)
    mine = same.where("asked").select("id", "scope", "vector").join(copies.select("scope", "vector", F.col("id").alias("first"), "copies"), ["scope", "vector"])
    # among copies the least other id: the first one, or for that one the second
    ids = same.select("scope", "vector", "id").join(mine.where("copies > 1 and id = first").select("scope", "vector", "first"), ["scope", "vector"]).where("id > first")
    second = ids.groupBy("first").agg(F.min("id").alias("second"))
    joined = mine.join(found.select(F.col("query_id").alias("first"), "links", F.col("other").alias("near"), "score"), "first", "left").join(second, "first", "left")
    copy = F.when(F.col("copies") > 1, F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    zero = ~F.exists("vector", lambda x: x != 0)
    best = F.array_min(F.array_compact(F.array(F.when(copy.isNotNull() & ~zero, F.struct(F.lit(-1.0).alias("minus"), copy.alias("other"))), F.when(F.col("near").isNotNull(), F.struct((-F.col("score")).alias("minus"), F.col("near").alias("other"))))))
    own = F.when(zero, 0).otherwise(F.col("copies") - 1)
    return joined.select("id", (F.coalesce("links", F.lit(0)) + own).alias("similar"), best["other"].alias("other"), (-best["minus"]).alias("score"))
