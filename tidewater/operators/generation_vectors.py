"""Vectors of a new generation: copied where nothing changed, taken from a cache, and embedded once for each distinct rest.

Edge cases: a vector of another dimension or with a null or non-finite entry is worth nothing and is made again; chunks
with equal inputs are embedded once; a null text is embedded as an empty one; repeated chunk ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.storage import importable, spread, written

#: Inputs of one call of an embedding service.
CALL = 64


def valid(vector: str, dimension: int) -> Column:
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def input_key(text: Column, profile: str) -> Column:
    """What a cached vector is found by: the profile of the model and the text."""
    return F.sha2(F.concat(F.lit(profile), F.lit("\n"), F.coalesce(text, F.lit(""))), 256)


def embedded(inputs: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """key and vector of inputs (key, text), in calls of CALL texts; a call that returns another number of vectors fails."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CALL):
                part = batch.slice(i, CALL)
                vectors = embed(part.column("text").to_pylist())
                if len(vectors) != part.num_rows or any(len(v) != dimension for v in vectors):
                    raise ValueError("the service returned another number of vectors, or of components")
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(vectors, pa.list_(pa.float64()))], ["key", "vector"])

    return spread(inputs.select("key", "text")).mapInArrow(call, "key string, vector array<double>")


def generation_vectors(chunks: DataFrame, previous: DataFrame, cache: DataFrame, embed: Callable, profile: str, dimension: int) -> DataFrame:
    """chunks (chunk_id, text, metadata) with vector and origin: copied, cached or embedded.

    previous: chunk_id, text, metadata, vector of the generation before; cache: key, vector.
    """
    importable(chunks.sparkSession)
    old = previous.where(valid("vector", dimension)).select(F.col("chunk_id").alias("of"), F.col("text").alias("old_text"), F.col("metadata").alias("old_metadata"), F.col("vector").cast("array<double>").alias("old_vector"))
    same = (F.col("chunk_id") == F.col("of")) & F.col("text").eqNullSafe(F.col("old_text")) & F.col("metadata").eqNullSafe(F.col("old_metadata"))
    looked = written(chunks.select("chunk_id", "text", "metadata", input_key(F.col("text"), profile).alias("key")).join(old.dropDuplicates(["of", "old_text", "old_metadata"]), same, "left").drop("of", "old_text", "old_metadata"), "chunks")
    changed = looked.where("old_vector is null").drop("old_vector")
    known = cache.where(valid("vector", dimension)).select("key", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["key"])
    wanted = changed.groupBy("key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    misses = embedded(wanted.join(known, "key", "left_anti"), embed, dimension).withColumn("origin", F.lit("embedded"))
    made = written(misses.unionByName(wanted.select("key").join(known, "key").withColumn("origin", F.lit("cached")).select("key", "vector", "origin")), "vectors")
    copied = looked.where("old_vector is not null").select("chunk_id", "text", "metadata", F.col("old_vector").alias("vector"), F.lit("copied").alias("origin"))
    return copied.unionByName(changed.join(made, "key").select("chunk_id", "text", "metadata", "vector", "origin"))


def reuse_report(generation: DataFrame, profile: str) -> DataFrame:
    """Chunks by origin, and how many distinct inputs they have."""
    return generation.groupBy("origin").agg(F.count("*").alias("chunks"), F.count_distinct(input_key(F.col("text"), profile)).alias("inputs"))
