"""The lexical index: top-k equal to whole scores and to a plain version, over many slices too."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import lexical_index as L

WORDS = [f"w{i}" for i in range(300)]


def texts(n=400):
    rng = np.random.default_rng(6)
    p = 1 / np.arange(1, len(WORDS) + 1)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 60), p=p / p.sum()))) for i in range(n)]
    rows += [(1000 + i, "w5 w7 w9 w200") for i in range(150)]  # copies: ties by id
    return rows + [(2000, None), (2001, ""), (2002, "!!"), (2003, "w250 " * 3000), (2004, "防火墙 w1 错误码"), (None, "w1")]


def plain(rows, queries, k1=1.5, b=0.75, epsilon=0.25):
    split = lambda t: re.findall(r"[a-z0-9]+", t or "") + [r[i : i + 2] for r in re.findall(r"[一-鿿]+", t or "") for i in range(max(1, len(r) - 1))]
    docs = {i: Counter(split(t)) for i, t in rows if i is not None}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = epsilon * sum(raw.values()) / len(raw)
    out = {}
    for q, text in queries:
        for i, c in docs.items():
            s = sum((floor if raw[t] < 0 else raw[t]) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * sum(c.values()) / mean)) for t in split(text) if c[t])
            if round(s, 6) > 0:
                out[(q, i)] = round(s, 6)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_topk(spark, small, monkeypatch):
    if small:  # many blocks, slices and panels, so that the first slices' threshold and the bounds take part
        for name, value in (("BLOCK_DOCS", 4), ("SLICE_BLOCKS", 2), ("PANEL_QUERIES", 3)):
            monkeypatch.setattr(L, name, value)
    rows = texts()
    queries = [(1, "w5 w7 w9"), (2, "w250 w1 w1"), (3, "nothing here"), (4, ""), (5, None), (6, "防火墙"), *[(10 + i, rows[i * 7][1]) for i in range(20)]]
    index = L.build(spark.createDataFrame(rows, "chunk_id long, text string").repartition(7))
    asked = spark.createDataFrame(queries, "query_id long, text string")
    want = plain(rows, queries)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in L.scores(index, asked).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    for k in (1, 10, 200):
        best = {}
        for (q, i), s in got.items():
            best.setdefault(q, []).append((-s, i))
        top = {(q, i) for q, x in best.items() for _, i in sorted(x)[:k]}
        found = L.topk(index, asked, k).collect()
        assert {(r["query_id"], r["chunk_id"]) for r in found} == top and len(found) == len(top)
        assert all(abs(r["score"] - got[(r["query_id"], r["chunk_id"])]) < 1.5e-6 for r in found)


def test_containing(spark):
    rows = [(i, t) for i, t in texts() if i is not None] + [(5000, "xw1 w2 w3y"), (5001, "see: w1 w2 w3."), (5002, "防火墙错误码"), (5003, "a.b c.d")]
    queries = [(1, "w1 w2 w3"), (2, "w2"), (3, "错误"), (4, "w1 nowhere w3"), (5, ".b c."), (6, ""), (7, None), (8, rows[3][1]), (9, rows[8][1][1:-1])]
    frame = lambda x, key: spark.createDataFrame(x, f"{key} long, text string")
    docs = frame(rows, "chunk_id").repartition(4)
    got = sorted(map(tuple, L.containing(L.build(docs), frame(queries, "query_id"), docs).collect()))
    assert got == sorted((q, i) for q, p in queries for i, t in rows if p is not None and t is not None and p in t)


def test_blocks_are_bounded(spark):
    index = L.build(spark.createDataFrame(texts(), "chunk_id long, text string"))
    postings = index.postings(spark)
    assert postings.agg(F.max(F.size("ids"))).first()[0] <= L.BLOCK_DOCS
    # an impact bounds every share of its block
    over = postings.withColumn("most", F.array_max(F.zip_with("tfs", "lengths", lambda tf, n: index.share(tf.cast("double"), n.cast("double"))))).where("abs(most - impact) > 1e-9")
    assert over.count() == 0


def test_term_stats_write_no_postings(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "chunk_id long, text string").repartition(5)
    want = {r["term"]: (r["df"], round(r["idf"], 9)) for r in L.build(docs).terms(spark).collect()}
    monkeypatch.setattr(L, "build", None)
    assert {r["term"]: (r["df"], round(r["idf"], 9)) for r in L.term_stats(docs).collect()} == want
    assert L.term_stats(docs.where("false")).collect() == []


def test_empty(spark):
    none = spark.createDataFrame([], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    index = L.build(none)
    assert L.scores(index, asked).collect() == [] and L.topk(index, asked, 3).collect() == []
    assert L.topk(L.build(spark.createDataFrame([(1, "a b")], none.schema)), asked.where("false"), 3).collect() == []


@pytest.mark.parametrize("panels", [16, 1])
def test_topk_of_groups_shuffles_no_postings(spark, panels, monkeypatch):
    """The best of each group without the scores of all pairs; nothing but results is exchanged."""
    for name, value in (("BLOCK_DOCS", 8), ("PANEL_QUERIES", 3), ("BROADCAST_PANELS", panels)):
        monkeypatch.setattr(L, name, value)
    rows = [(i, t, "ab"[i % 3 == 0]) for i, t in texts() if i is not None]
    index = L.build(spark.createDataFrame(rows, "chunk_id long, text string, group string").repartition(5))
    asked = spark.createDataFrame([(1, "w5 w7 w9"), (2, "w250 w1 w1"), *[(10 + i, rows[i * 7][1]) for i in range(8)]], "query_id long, text string")
    best = {}
    for r in L.scores(index, asked).collect():
        best.setdefault((r["query_id"], "ab"[r["chunk_id"] % 3 == 0]), []).append((-r["score"], r["chunk_id"]))
    found = L.topk(index, asked, 4, grouped=True)
    assert sorted(r[:3] for r in map(tuple, found.collect())) == sorted((*key, i) for key, x in best.items() for _, i in sorted(x)[:4])
    # what several readers take was made once
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
