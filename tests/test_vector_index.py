"""The inverted-file index against exhaustive search: ties, copies, zero and odd vectors, one list of a third of all rows."""

import hashlib

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tidewater.operators import vector_index as I
from tidewater.plans import adapt as A
from tidewater.plans import index_queries


def rows_of(seed=1, clusters=12, n=900, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    rows = [(i, "ab"[i % 2], [float(x) for x in centres[rng.integers(clusters)] + 0.15 * rng.normal(size=d)]) for i in range(n)]
    rows += [(n + i, "a", [1.0] * d) for i in range(n // 2)]  # copies: a third of all
    rows += [(3000, "a", [0.0] * d), (3001, "b", [0.0] * d), (3002, None, [2.0] * d), (3003, "a", None), (3004, "a", [float("nan")] * d), (3005, "a", [None] * d), (None, "a", [1.0] * d), (3100, None, [2.0] * d)]
    return rows


def score(a, b):
    length = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.floor((np.dot(a, b) / length if length else 0.0) * 1e4 + 0.5) / 1e4)


def usable(rows):
    return [(i, s, np.array(v)) for i, s, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(), "id long, scope string, vector array<double>").repartition(6)


def test_exact_search(spark, table):
    rows = usable(rows_of())
    asked = table.where("id % 100 = 0")
    index = I.build(table, block_rows=64)
    assert index.blocks(spark).agg(F.sum("n")).first()[0] == len(rows)
    # a query with a scope meets its rows, one without meets all
    found = {}
    for r in I.search(index, asked.withColumnRenamed("id", "query_id"), 7, probes=1).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for i, s, v in rows:
        if i % 100 == 0:
            want = sorted((-score(v, w), j) for j, t, w in rows if s is None or s == t)[:7]
            assert [(x[1], x[2]) for x in sorted(found[i])] == [(j, -m) for m, j in want], i


def test_rows_travel_once_to_a_slice(spark, table):
    """All rows as queries: a panel and a slice meet once, not each query and each block."""
    index = I.build(table, block_rows=8)
    queries = I._queries(table.withColumnRenamed("id", "query_id"), F.lit(3.2))
    width = lambda query_ids, score, ids, copies, lists: I.pa.RecordBatch.from_arrays([I.pa.array([len(query_ids)]), I.pa.array([score.shape[1]])], ["queries", "rows"])
    products = I._scored(index, queries, None, width, "queries long, rows long").collect()
    blocks = index.blocks(spark)
    assert blocks.groupBy("slice").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= I.SLICE_ROWS
    assert len(products) < blocks.count() / 2 and max(r["rows"] for r in products) > 100


def test_recall_of_probes(spark, table):
    bare = table.drop("scope")
    index = I.build(bare)
    tried = bare.withColumnRenamed("id", "query_id")
    probes = I.probes_for(index, tried.where("query_id % 3 = 1"), 10)
    asked = tried.where("query_id % 10 = 0")
    exact = {(r["query_id"], r["id"]) for r in I.search(index, asked, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in I.search(index, asked, 10, probes, exact=False).collect()}
    assert probes < len(index.centroids) / 2 and len(exact & near) >= 0.9 * len(exact)


def test_duplicates(spark, table):
    rows = usable(rows_of())
    got = {r["id"]: (r["similar"], r["other"], r["score"]) for r in I.duplicates(table, F.col("id") % 10 == 0, 0.95).collect()}
    want = {}
    for i, s, v in rows:
        if i % 10 == 0:
            near = sorted((-x, j) for j, t, w in rows if j != i and s == t and (x := score(v, w)) >= 0.95)
            want[i] = (len(near), near[0][1] if near else None, -near[0][0] if near else None)
    assert got == want and sum(n > 0 for n, _, _ in want.values()) > 50


def test_duplicate_report_of_odd_documents(spark, tmp_path):
    """Unknown languages, copies, texts without words and words that cancel out, against the statement."""
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 128
    words = [f"w{i}" for i in range(900)]
    zero = next(f"{a} {b}" for a in words[:200] for b in words if abs(place(a) - place(b)) == 64)
    texts = ["w1 w2 w3 w4", "w1 w2 w3 w4", zero, "", None, "w1 w2 w3 w4 w5", " ".join(words[:300]), " ".join(words[:301])]
    rows = [(100 * i + j, t, lang) for i, t in enumerate(texts) for j, lang in enumerate(["en", "en", None, None, "de"])]
    rows += [(1000 + 100 * i, t, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.differences(index_queries.duplicate_report(spark, str(tmp_path)), index_queries.SQL["duplicate_report"], con) == ""


def test_duplicate_report_reads_texts_once(spark, tmp_path, monkeypatch):
    """Words are tokenized once and added up where they lie; what is shuffled is rows of documents, also of repeated ids."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 250)) for _ in range(300)]
    rows = [(i, texts[i % 300] + " w1" * (i % 7), "ab"[i % 2]) for i in range(600)] + [(i, texts[i], "ab"[i % 2]) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    read, real = [], A.table
    monkeypatch.setattr(A, "table", lambda spark, at, name: read.append(name) or real(spark, at, name))
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.Collections.emptyList()

    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    found = index_queries.duplicate_report(spark, str(tmp_path))
    assert oracle.differences(found, index_queries.SQL["duplicate_report"], con) == ""
    assert read == ["documents"] and "documents.parquet" not in found._jdf.queryExecution().toString()
    assert sum(n for stage, n in shuffled().items() if stage not in before) < 20 * len(rows)


def test_empty(spark, table):
    none = table.where("false")
    index = I.build(none)
    assert I.search(index, table.withColumnRenamed("id", "query_id"), 3).collect() == []
    assert I.search(I.build(table), none.withColumnRenamed("id", "query_id"), 3).collect() == []
    assert I.duplicates(none, F.col("id") % 10 == 0).collect() == []


def test_floats_stay_narrow(spark):
    x = np.random.default_rng(3).normal(size=(500, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    index = I.build(rows)
    blocks = index.blocks(spark).agg(F.sum("n").alias("n"), F.sum(F.length("vectors")).alias("bytes")).first()
    assert blocks["bytes"] == blocks["n"] * 8 * 4
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 500, 100) for i in np.lexsort((np.arange(500), -np.floor(unit[q] @ unit.T * 1e4 + 0.5)))[:5]}
    assert {(r.query_id, r.id) for r in I.search(index, asked, 5).collect()} == want
