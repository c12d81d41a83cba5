"""Best-fit packing of tokenized documents into fixed-length sequences, by large-item matching.

Pieces above one third of the capacity are large: a sequence takes at most two of them, and each (longest first) is
paired with the longest large piece that still fits. Smaller pieces then go, longest first, to the sequence with the
smallest gap that takes them. Both rules only look at lengths, and there are at most ``capacity`` of those. The plan is
therefore made on the histogram of lengths, in groups of equal sequences: its size is bounded by the capacity, not by
the corpus. Spark then deals the pieces of a length out to the plan's places by their rank.

Edge cases: a null or empty text is just the end id; documents over the capacity are cut, the first piece taking the
remainder; repeated document ids are packed as separate documents; an empty table packs to nothing; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.store import written
from tidewater.llm.tokens import Encoder

CAPACITY = 2048
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (of the little-endian
    unsigned 32-bit ids) and, if asked for, ids (little-endian, of the tokenizer's item size)."""
    shape = pa.schema(list(_PIECES)[: 5 + with_ids])

    def cut(batches):
        encode = Encoder.at(tokenizer)
        end = np.array([end_id], encode.dtype)
        out = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), shape.types, strict=True)], schema=shape)
            out.clear()
            return batch

        for batch in batches:
            for doc_id, ids in encode.groups(batch):
                ids = np.concatenate([ids, end])
                first = len(ids) % capacity or capacity
                start = 0
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    part = ids[start:stop]
                    out.append((doc_id, k, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), *((part.tobytes(),) if with_ids else ())))
                    start = stop
                if len(out) >= 2000:
                    yield flush()
        if out:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for the pieces of each length: rows (length, first rank, ranks, per sequence, first sequence, offset).

    The piece of rank r in its length goes to sequence first + (r - rank) // per, at offset + (r - rank) % per * length.
    """
    left = {k: v for k, v in histogram.items() if v and 0 < k <= capacity}
    groups: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # gap: (sequences, ((length, per sequence), ...))
    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for a in large:
        for b in large:
            if b > a or a + b > capacity or not left[a]:
                continue
            if n := left[a] // 2 if a == b else min(left[a], left[b]):
                left[a] -= n
                left[b] -= n
                groups[capacity - a - b].append((n, ((a, 2),) if a == b else ((a, 1), (b, 1))))
        if left[a]:
            groups[capacity - a].append((left[a], ((a, 1),)))
            left[a] = 0
    for s in sorted((x for x in left if left[x]), reverse=True):
        gaps = [g for g in groups if g >= s and groups[g]]
        heapq.heapify(gaps)
        n = left[s]
        while n and gaps:
            gap = heapq.heappop(gaps)
            while n and groups[gap]:
                count, inside = groups[gap].pop()
                per = min(gap // s, n)
                take = min(count, n // per)
                if count > take:
                    groups[gap].append((count - take, inside))
                groups[gap - per * s].append((take, (*inside, (s, per))))
                n -= take * per
        if n:
            per = capacity // s
            if n >= per:
                groups[capacity - per * s].append((n // per, ((s, per),)))
            if n % per:
                groups[capacity - n % per * s].append((1, ((s, n % per),)))
    rows, rank, sequence = [], defaultdict(int), 0
    for gap in sorted(groups):
        for count, inside in groups[gap]:
            offset = 0
            for length, per in inside:
                rows.append((length, rank[length], count * per, per, sequence, offset))
                rank[length] += count * per
                offset += length * per
            sequence += count
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, rows_per_salt: int = 100_000, with_ids: bool = True) -> DataFrame:
    """Pieces with their place: the columns of ``pieces`` with sequence_id and offset.

    Pieces of one length are ranked in salted parts, whose first ranks come from the parts' counts, so a very common
    length is no single task's work.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places = spark.createDataFrame(
        plan(counts, capacity), "length long, rank0 long, ranks long, per long, sequence0 long, offset0 long"
    )
    salts = max(8, sum(counts.values()) // rows_per_salt)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("rank", F.col("inside") + F.col("before"))
    k = F.col("rank") - F.col("rank0")
    return (
        # the plan has a few rows for each of at most `capacity` lengths
        ranked.join(F.broadcast(places), "length").where((k >= 0) & (k < F.col("ranks")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("sequence0") + F.expr("(rank - rank0) div per")).alias("sequence_id"),
            (F.col("offset0") + F.expr("(rank - rank0) % per") * F.col("length")).alias("offset"), *(["ids"] if with_ids else []),
        )
    )
