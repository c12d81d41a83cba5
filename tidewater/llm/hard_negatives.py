"""Hard negatives by a two-dimensional block matrix product (SUMMA).

Rows are sharded into blocks of bounded size and their components into chunks. The tile of an anchor block and a row block
stays in one task: the two blocks' panels come to it chunk by chunk and their products are added there, so that panels are
shuffled and scores never are. Of the tiles of one anchor block in a task only one top-k leaves it. The first product, over
blocks that share labels, gives each anchor's positives; the second, over all blocks, the best negatives inside each
positive's window of scores. Labels are dealt to groups and every group to as many blocks as its rows need, so a label that
holds a third of all rows is only more blocks. A task holds one tile and one batch of panels at a time.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; missing trailing
components count as 0; a row that repeats another's id, label and components is the same row; rows that share an id alone
are rows of their own, and one is never its own positive; equal scores go by id; an anchor without positives, and a
positive without negatives in its window, return nothing; an empty table gives an empty result; other columns are
ignored. Components whose scores could leave 63 bits raise ArithmeticError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.store import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this many hundredths of the positive's.
FLOOR = 80
#: Bounds of a tile: anchors, rows, and the components of a panel; anchors whose products and sorted cells are held at once.
ANCHOR_BLOCK, ROW_BLOCK, PANEL_CELLS, PART_ROWS = 1024, 4096, 1 << 19, 256
#: Labels are dealt to so many groups; chunks hold at least LEAST_CHUNK components, and there are at most CHUNKS of them.
GROUPS, LEAST_CHUNK, CHUNKS = 64, 32, 4

_PANEL = pa.schema([("block", pa.int32()), ("grp", pa.int32()), ("k", pa.int32()), ("n", pa.int32()), ("most", pa.int64()), ("kind", pa.string()), ("x", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary()), ("labels", pa.binary()), ("windows", pa.binary())])
_HEAD = ("ids", "keys", "labels", "windows")
_FOUND = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("place", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])
_NONE = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, x array<long>, key, grp) of the rows that take part."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    rows = rows.select("id", "label", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    return rows.withColumn("key", F.xxhash64("label", "x")).withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))


def panels(rows: DataFrame, block: Column, width: int, chunk: int) -> DataFrame:
    """The rows of each block as one panel a chunk; ids, labels and windows go with the first chunk."""

    def packed(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        ids, keys, labels = column("id").astype("<i8"), column("key").astype("<i8"), column("label").astype("<i8")
        order = np.lexsort((keys, ids))
        same = (ids[order][1:] == ids[order][:-1]) & (keys[order][1:] == keys[order][:-1])
        order = order[np.r_[True, ~same]] if len(order) else order

        def matrix(name: str, columns: int, fill: int) -> np.ndarray:
            lists = table.column(name).combine_chunks()
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            out = np.full((len(size), columns), fill, "<i8")
            at = np.arange(columns)[None, :] < size[:, None]
            out[at] = flat[(start[:, None] + np.arange(columns)[None, :])[at]]
            return out[order]

        x, windows = matrix("x", width, 0), matrix("windows", POSITIVES, _NONE)
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"  # panels travel as narrow as they may
        number, grp = int(column("block")[0]), int(column("grp")[0])
        head = (ids[order].tobytes(), keys[order].tobytes(), labels[order].tobytes(), windows.tobytes())
        out = [(number, grp, k, len(order), most, kind, np.ascontiguousarray(x[:, s : s + chunk], kind).tobytes(), *(head if k == 0 else (None,) * 4)) for k, s in enumerate(range(0, width, chunk))]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), _PANEL.types, strict=True)], schema=_PANEL)

    if "windows" not in rows.columns:
        rows = rows.withColumn("windows", F.lit(None).cast("array<long>"))
    rows = rows.select(block.cast("int").alias("block"), "grp", "id", "key", "label", "x", "windows")
    kinds = "block int, grp int, k int, n int, most long, kind string, x binary, ids binary, keys binary, labels binary, windows binary"
    return rows.groupBy("block").applyInArrow(packed, kinds)


def _sorted(score: np.ndarray, mask: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of the cells under the mask, by anchor, falling score and id."""
    a, b = np.nonzero(mask)
    found = score[a, b]
    order = np.lexsort((ids[b], -found, a))
    return a[order], b[order], found[order]


def _positives(score, head, most):
    a, b, found = _sorted(score, (head["a_labels"][:, None] == head["b_labels"][None, :]) & ~((head["a_ids"][:, None] == head["b_ids"][None, :]) & (head["a_keys"][:, None] == head["b_keys"][None, :])), head["b_ids"])
    first = np.arange(len(a)) - np.searchsorted(a, a)
    at = first < most
    return a[at], np.zeros(at.sum(), np.int32), b[at], found[at]


def _negatives(score, head, most, floor):
    windows = head["a_windows"].reshape(len(score), -1)
    least = np.where(windows >= 0, windows, np.iinfo(np.int64).max).min(axis=1)
    top = windows.max(axis=1)
    # a negative positive's window is empty
    some = (top >= 0)[:, None]
    inside = some & (100 * score >= np.where(some, floor * np.where(some[:, 0], least, 0)[:, None], 0)) & (score <= top[:, None])
    a, b, found = _sorted(score, inside & (head["a_labels"][:, None] != head["b_labels"][None, :]), head["b_ids"])
    starts = np.searchsorted(a, np.arange(len(score) + 1))
    picked, places = [], []
    for i in np.flatnonzero(np.diff(starts)):
        falling = found[starts[i] : starts[i + 1]]
        for place, positive in enumerate(windows[i].tolist()):
            if positive < 0:
                continue
            low = int(np.searchsorted(-falling, -positive))
            near = np.flatnonzero(100 * falling[low : low + most] >= floor * positive) + low + starts[i]
            picked.append(near)
            places.append(np.full(len(near), place + 1, np.int32))
    at = np.concatenate(picked) if picked else np.empty(0, np.int64)
    return a[at], np.concatenate(places) if places else np.empty(0, np.int32), b[at], found[at]


def _first(found: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Of the found (anchor, place, id, score) the first ``most`` of each anchor and place."""
    anchor, place, other, score = found
    order = np.lexsort((other, -score, place, anchor))
    group = anchor[order] * (POSITIVES + 1) + place[order]
    order = order[np.arange(len(order)) - np.searchsorted(group, group) < most]
    return [x[order] for x in found]


def multiplied(anchors: DataFrame, rows: DataFrame, tiles: int, anchor_blocks: int, chunks: int, select, most: int) -> DataFrame:
    """``select`` takes the top-k of each tile of the grid; both sides have their panels' partners in an array ``to``, of
    ``tiles`` pairs in all. Tiles of one anchor block in a task leave their common top-k alone."""
    spark = anchors.sparkSession
    parts = max(1, min(tiles, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    # few bytes, much work: tiles are spread whatever their size, those of a task being of as few anchor blocks as may be
    spread = -(-2 * parts // anchor_blocks)
    panel = ["k", "n", "most", "kind", "x", *_HEAD]
    left = anchors.select(F.col("block").alias("a"), F.explode("to").alias("b"), F.lit(0).alias("side"), *panel)
    right = rows.select(F.explode("to").alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"), *panel[:-1], F.lit(None).cast("binary").alias("windows"))

    def product(x: np.ndarray, y: np.ndarray, bound: int) -> np.ndarray:
        # a double holds each partial sum exactly below 2^53
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if bound < 1 << 53 else x.astype(np.int64) @ y.T.astype(np.int64)

    def total(batches):
        at, panels, tile, heads, found, names = None, {}, None, {}, None, None

        def ended():
            """The top-k of the tile, with those of the anchor block's tiles before it."""
            best = [] if found is None else [found]
            for first in range(0, len(tile), PART_ROWS):
                head = {f"a_{x}": heads[0][x].reshape(len(tile), -1)[first : first + PART_ROWS] for x in _HEAD} | {f"b_{x}": heads[1][x] for x in _HEAD[:3]}
                head |= {f"a_{x}": head[f"a_{x}"][:, 0] for x in _HEAD[:3]}
                a, place, b, score = select(tile[first : first + PART_ROWS], head)
                best.append([a + first, place.astype(np.int64), heads[1]["ids"][b], score])
            return _first([np.concatenate(x) for x in zip(*best, strict=True)], most)

        def leave():
            anchor, place, other, score = found
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((names["ids"][anchor], names["keys"][anchor], place, other, score), _FOUND.types, strict=True)], schema=_FOUND)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if (row["a"], row["b"]) != at:
                    if tile is not None:
                        found, names, tile = ended(), heads[0], None
                    if found is not None and at[0] != row["a"]:
                        yield leave()
                        found = None
                    at, panels, heads = (row["a"], row["b"]), {}, {}
                if row["k"] == 0:
                    heads[row["side"]] = {x: np.frombuffer(row[x] or b"", "<i8") for x in _HEAD}
                panels = {row["side"]: row} | {s: p for s, p in panels.items() if p["k"] == row["k"] and s != row["side"]}
                if len(panels) < 2:
                    continue
                x, y = (np.frombuffer(panels[s]["x"], panels[s]["kind"]).reshape(panels[s]["n"], -1) for s in (0, 1))
                bound = panels[0]["most"] * panels[1]["most"] * x.shape[1]
                if 100 * bound * chunks >= 1 << 63:
                    raise ArithmeticError("components too large for scores of 63 bits")
                tile = np.zeros((len(x), len(y)), np.int64) if tile is None else tile
                for first in range(0, len(x), PART_ROWS):
                    tile[first : first + PART_ROWS] += product(x[first : first + PART_ROWS], y, bound)
        if tile is not None:
            found, names = ended(), heads[0]
        if found is not None:
            yield leave()

    kinds = "anchor_id long, anchor_key long, place int, other_id long, score long"
    dealt = left.unionByName(right).withColumn("share", F.pmod(F.xxhash64("b"), F.lit(spread)))
    return dealt.repartition(parts, "a", "share").drop("share").sortWithinPartitions("a", "b", "k", "side").mapInArrow(total, kinds)


def _best(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(embeddings: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """For each row of ``embeddings`` (vec_id, label, embedding) that fulfils ``anchor`` (a condition on ``id``) and each of
    its positives, the best rows of other labels whose score is between ``floor`` % of the positive's and the positive's."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    # one row for each of at most GROUPS groups of labels
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.max(F.size("x")).alias("width")).collect()
    width = max([1, *(r["width"] for r in sizes)])
    if positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives")
    row_block, anchor_block = (max(1, min(n, PANEL_CELLS // width)) for n in (row_block, anchor_block))
    chunk = max(LEAST_CHUNK, -(-width // CHUNKS))
    chunks = -(-width // chunk)
    blocks = lambda n, size: -(-n // size)
    count, first, a_count, a_first, total, a_total = [0] * GROUPS, [0] * GROUPS, [0] * GROUPS, [0] * GROUPS, 0, 0
    for r in sizes:
        g = r["grp"]
        count[g], first[g], a_count[g], a_first[g] = blocks(r["n"], row_block), total, blocks(r["anchors"], anchor_block), a_total
        total, a_total = total + count[g], a_total + a_count[g]
    if not a_total:
        return spark.createDataFrame([], RESULT)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("grp") + 1)
    dealt = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    span = lambda start, n: F.when(n > 0, F.sequence(start, start + n - 1)).otherwise(F.array().cast("array<int>"))

    row_panels = written(panels(rows, of(first) + dealt("row", F.greatest(of(count), F.lit(1))), width, chunk), "row-panels")
    anchors = rows.where(anchor)
    own = panels(anchors, of(a_first) + dealt("anchor", F.greatest(of(a_count), F.lit(1))), width, chunk)
    found = multiplied(own.withColumn("to", span(of(first), of(count))), row_panels.withColumn("to", span(of(a_first), of(a_count))), sum(map(int.__mul__, count, a_count)), a_total, chunks, lambda score, head: _positives(score, head, positives), positives)
    ranked = _best(found, positives)
    places = written(ranked.select("anchor_id", "anchor_key", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = places.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("w"))
    windows = windows.select(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key"), F.col("w.positive_score").alias("windows"))
    every = blocks(sum(r["anchors"] for r in sizes), anchor_block)
    wide = panels(anchors.join(windows, ["id", "key"]), dealt("all", F.lit(every)), width, chunk)
    all_rows, all_anchors = F.sequence(F.lit(0), F.lit(total - 1)), F.sequence(F.lit(0), F.lit(every - 1))
    found = multiplied(wide.withColumn("to", all_rows), row_panels.withColumn("to", all_anchors), total * every, every, chunks, lambda score, head: _negatives(score, head, negatives, floor), negatives)
    found = _best(found, negatives)
    return found.join(places, ["anchor_id", "anchor_key", "place"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
