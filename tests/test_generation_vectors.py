"""Vector reuse: copies, cache and distinct misses; rerank pool, lost labels and failure rules on odd rows."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import generation_vectors as G
from tidewater.operators import lifecycle as L
from tidewater.operators import retrieval as R

NAN = float("nan")


def test_generation_vectors(spark, tmp_path):
    calls = str(tmp_path)

    def embed(texts):
        import os
        import uuid

        with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    chunks = spark.createDataFrame([(1, "same", "m"), (2, "new text", "m"), (3, "same", "other"), (4, "cached", "m"), (5, None, None), (6, "broken", "m"), (7, "new text", "x"), (8, "short", "m")], "chunk_id long, text string, metadata string")
    old = spark.createDataFrame([(1, "same", "m", [9.0, 9.0]), (2, "old", "m", [9.0, 9.0]), (3, "same", "m", [9.0, 9.0]), (5, None, None, [8.0, 8.0]), (6, "broken", "m", [NAN, 1.0]), (8, "short", "m", [1.0]), (1, "same", "m", [9.0, 9.0])], "chunk_id long, text string, metadata string, vector array<double>")
    cache = chunks.where("chunk_id in (4, 6)").select(G.input_key(F.col("text"), "p").alias("key"), F.when(F.col("chunk_id") == 4, F.array(F.lit(7.0), F.lit(7.0))).otherwise(F.array(F.lit(7.0))).alias("vector"))
    found = G.generation_vectors(chunks, old, cache, embed, "p", 2).collect()
    got = {r["chunk_id"]: (r["origin"], r["vector"]) for r in found}
    assert len(found) == 8
    assert got == {1: ("copied", [9.0, 9.0]), 2: ("embedded", [8.0, 1.0]), 3: ("embedded", [4.0, 1.0]), 4: ("cached", [7.0, 7.0]), 5: ("copied", [8.0, 8.0]), 6: ("embedded", [6.0, 1.0]), 7: ("embedded", [8.0, 1.0]), 8: ("embedded", [5.0, 1.0])}
    asked = [t for p in tmp_path.iterdir() for t in p.read_text().split("\n")]
    assert sorted(asked) == ["broken", "new text", "same", "short"]  # each distinct input once
    with pytest.raises(Exception, match="another number"):
        G.generation_vectors(chunks, old, cache, lambda t: [[1.0]] * len(t), "p", 2).collect()
    assert G.generation_vectors(chunks.where("false"), old, cache, embed, "p", 2).collect() == []


def test_deny_changes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "source string, doc_id long")
    found = L.deny_changes(frame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 3)]), frame([("a", 1)]), frame([("b", 3), ("c", 9)]), frame([("a", 7), ("c", 9)]), ["source", "doc_id"])
    assert sorted(map(tuple, found.collect())) == [("a", 2), ("a", 7), ("b", 1)]


def test_rerank(spark):
    config = R.Config(today=0, top_k=3)
    assert (R.pool_size(config, True), R.pool_size(config, False), R.pool_size(R.Config(today=0, top_k=10), True)) == (16, 6, 20)
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4)], "query_id long, chunk_id long, rank int")
    scores = spark.createDataFrame([(1, 11, 0.5), (1, 13, 0.5), (1, 12, 0.9), (2, 10, 1.0)], "query_id long, chunk_id long, relevance double")
    assert [(r["chunk_id"], r["fused_rank"]) for r in R.reranked(hits, scores).orderBy("rank").collect()] == [(12, 3), (11, 2), (13, 4), (10, 1)]
