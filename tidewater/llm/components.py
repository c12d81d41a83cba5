"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import discard, written


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, root), root the least id that a node reaches; isolated nodes have no row.

    Null ends and loops are dropped, repeated edges count once. Each step aggregates by node before it joins, so a node
    with very many neighbours is pre-aggregated, and the joins are split where they are skewed.
    """
    now = written(_pairs(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = _pairs(large)
        # small star: each node's smaller neighbours meet at the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        last, now = now, written(_pairs(small.select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
        discard(last)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
