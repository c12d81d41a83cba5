"""Hybrid retrieval over batches of queries: exact cosine, Okapi BM25, weighted reciprocal rank fusion, source cap, parents.

Every ranking has a total order, and scores are rounded before they order. Filters stand where they are observable: the
vector route filters before its cut, access and score floor after it; the lexical route filters after its own cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import lexical_index as L
from tidewater.storage import written

QUERY_BLOCK = 1024


@dataclass(frozen=True)
class Config:
    """Parameters of the hybrid plan."""

    today: int
    k: int = 60
    vector_weight: float = 1.0
    lexical_weight: float = 1.0
    recall: int = 10
    pool: int = 0
    source_cap: int = 2
    min_score: float = 0.5
    top_k: int = 5
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    """Row numbers within keys; a limit reaches below the shuffle as a group limit."""
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return df.where(F.col(name) <= most) if most else df


def usable_by_vector(today: int) -> Column:
    """Pre-filter of the vector route; a missing status or date excludes."""
    return (F.col("status") == "active") & (F.coalesce("chunk_type", F.lit("")) != "parent") & (F.col("valid_to") >= today)


def usable_by_terms(today: int) -> Column:
    """Post-filter of the lexical route; a missing status or date passes."""
    return (
        readable() & (F.col("status").isNull() | (F.col("status") == "active")) & (F.coalesce("chunk_type", F.lit("")) != "parent")
        & (F.col("valid_to").isNull() | (F.col("valid_to") == 0) | (F.col("valid_to") >= today))
    )


def readable() -> Column:
    """Unlabelled or for employees."""
    return F.col("access").isNull() | (F.col("access") == "employee")


def _blocks(queries: DataFrame) -> Iterator[list]:
    block = []
    for row in queries.orderBy("query_id").toLocalIterator():
        block.append((row["query_id"], row["vector"], row["scenario"]))
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def vector_scores(queries: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """query_id, chunk_id, score (cosine, 4 digits): each query's best chunks.

    The query set goes out in blocks. A task multiplies whole batches and passes on no more than each query's best of
    the batch, so the exact ranking that follows moves few rows. A query with a scenario only sees its chunks.
    """
    found = chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    usable = chunks.where("embedding is not null").select(F.col("chunk_id").cast("long"), "scenario", "embedding")
    for block in _blocks(queries.where("vector is not null")):
        shared = chunks.sparkSession.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            ids = np.array([q[0] for q in shared.value], np.int64)
            asked = np.array([q[1] for q in shared.value], np.float64)
            scenarios = np.array([q[2] or "" for q in shared.value])
            norms = np.linalg.norm(asked, axis=1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                length = norms[:, None] * np.linalg.norm(rows, axis=1)[None, :]
                score = np.divide(asked @ rows.T, length, out=np.zeros_like(length), where=length > 0)
                theirs = np.array([x or "" for x in batch.column("scenario").to_pylist()])
                score[(scenarios[:, None] != "") & (scenarios[:, None] != theirs[None, :])] = -np.inf
                chunk_ids = batch.column("chunk_id").to_numpy()
                score = np.where(np.isfinite(score), np.floor(score * 1e4 + 0.5) / 1e4, score)
                best = np.lexsort((np.broadcast_to(chunk_ids, score.shape), -score), axis=1)[:, :most]
                picked = np.take_along_axis(score, best, 1)
                ok = np.isfinite(picked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.broadcast_to(ids[:, None], best.shape)[ok]), pa.array(chunk_ids[best][ok]), pa.array(picked[ok])], ["query_id", "chunk_id", "score"]
                )

        found = found.unionByName(usable.mapInArrow(scan, "query_id long, chunk_id long, score double"))
    best = ranked(found, ["query_id"], [F.desc("score"), F.col("chunk_id")], most=most).select("query_id", "chunk_id", "score")
    return written(best, "best")  # few rows, which several readers of a plan take


def vector_route(queries: DataFrame, chunks: DataFrame, config: Config) -> DataFrame:
    """query_id, chunk_id, score, rank of the vector route: pre-filter, cut, then access and score floor."""
    best = vector_scores(queries, chunks.where(usable_by_vector(config.today)), config.recall)
    kept = best.join(chunks.select("chunk_id", "access"), "chunk_id").where(readable() & (F.col("score") >= config.min_score))
    return ranked(kept, ["query_id"], [F.desc("score"), F.col("chunk_id")]).select("query_id", "chunk_id", "score", "rank")


def indexed(chunks: DataFrame, config: Config) -> L.LexicalIndex:
    return L.build(chunks, config.k1, config.b, config.epsilon)


def lexical_route(queries: DataFrame, chunks: DataFrame, config: Config, index: L.LexicalIndex | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the lexical route: best 2 * recall, filter, best recall."""
    best = L.topk(index or indexed(chunks, config), queries, 2 * config.recall)
    meta = chunks.select("chunk_id", "access", "status", "chunk_type", "valid_to", F.col("scenario").alias("theirs"))
    asked = queries.select("query_id", "scenario")
    kept = best.join(meta, "chunk_id").join(asked, "query_id").where(usable_by_terms(config.today) & (F.col("scenario").isNull() | (F.col("scenario") == F.col("theirs"))))
    return ranked(kept, ["query_id"], [F.desc("score"), F.col("chunk_id")], most=config.recall).select("query_id", "chunk_id", "score", "rank")


def fused(vector: DataFrame, lexical: DataFrame, config: Config) -> DataFrame:
    """Weighted reciprocal rank fusion on the chunk: query_id, chunk_id, fused, score (vector's first), routes, rank."""
    route = lambda df, order, name, weight: df.select("query_id", "chunk_id", "score", F.col("rank").alias("place"), F.lit(order).alias("route"), F.lit(name).alias("name"), (weight / (config.k + F.col("rank"))).alias("part"))
    both = route(vector, 0, "vector", config.vector_weight).unionByName(route(lexical, 1, "bm25", config.lexical_weight))
    grouped = both.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("part"), 12).alias("fused"), F.min_by("score", "route").alias("score"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("routes"),
        F.min("route").alias("route"), F.min_by("place", "route").alias("place"),
    )
    pool = max(2 * config.top_k, config.pool)
    return ranked(grouped, ["query_id"], [F.desc("fused"), F.col("route"), F.col("place"), F.col("chunk_id")], most=pool).drop("route", "place")


def pool_size(config: Config, rerank: bool, candidates: int = 16) -> int:
    """Hits that fusion passes on: twice what is asked for; a reranker gets at least ``candidates``."""
    return max(2 * config.top_k, candidates) if rerank else max(2 * config.top_k, config.pool)


def reranked(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """The pool in the order of a reranker's scores (query_id, chunk_id, relevance), before any source is capped. Hits without
    a score follow in their old order; ``rank`` is the new place, ``fused_rank`` the old one."""
    scored = hits.withColumnRenamed("rank", "fused_rank").join(scores.select("query_id", "chunk_id", "relevance"), ["query_id", "chunk_id"], "left")
    return ranked(scored, ["query_id"], [F.desc_nulls_last("relevance"), F.col("fused_rank")])


def hop_scenario(hop: Column, scenario: Column, registered: list[str]) -> Column:
    """The scenario that filters a search: on the first hop and if it is registered; null is no filter."""
    return F.when((hop == 1) & scenario.isin(*registered), scenario)


def capped(hits: DataFrame, chunks: DataFrame, config: Config, rank: str = "rank") -> DataFrame:
    """At most source_cap hits of a source, in the global order, then the first top_k."""
    sources = hits.join(chunks.select("chunk_id", F.coalesce("source_url", F.col("chunk_id").cast("string")).alias("source")), "chunk_id")
    inside = ranked(sources, ["query_id", "source"], [F.col(rank)], "of_source", config.source_cap)
    return ranked(inside, ["query_id"], [F.col(rank)], "final_rank", config.top_k).drop("of_source")


def allowed(hits: DataFrame, chunks: DataFrame, denied: DataFrame) -> DataFrame:
    """Without hits of denied documents."""
    return hits.join(denied.select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_anti")


def with_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Left join of each hit's parent text, if the parent is readable."""
    parents = chunks.where((F.col("chunk_type") == "parent") & readable()).select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id").join(parents, "parent_id", "left")


def served(chunks: DataFrame, denied: DataFrame) -> DataFrame:
    """The chunks that reads may see: those of documents that are not denied."""
    return allowed(chunks, chunks, denied)


def hybrid(queries: DataFrame, chunks: DataFrame, denied: DataFrame, config: Config, index: L.LexicalIndex | None = None) -> DataFrame:
    """The whole plan: both routes without denied documents, fusion, cap, and the deny list once more. A query without a vector has the lexical route alone."""
    seen = served(chunks, denied)
    lexical = lexical_route(queries, seen, config, index or indexed(chunks, config))
    hits = fused(vector_route(queries, seen, config), lexical, config)
    return allowed(capped(hits, chunks, config), chunks, denied)


def concatenated(route: DataFrame, order: list[Column]) -> DataFrame:
    """Ranks over several collections, whose lists follow one another: the second one's best comes after all of the first."""
    return ranked(route, ["query_id"], order)
