"""Order statistics by narrowing and as-of joins by carried maxima, with one key that holds half of all rows."""

import numpy as np
from pyspark.sql import functions as F

from tidewater.operators import selection as S
from tidewater.operators import service_desk as D


def groups():
    rng = np.random.default_rng(3)
    rows = [("hot", float(np.round(x, 2))) for x in rng.exponential(100, 6000)]
    rows += [("tied", 5.0)] * 300 + [("tied", 7.0)] + [("one", -1.5)] + [(None, float(i)) for i in range(10)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323, -0.0, 1.0, 1.0000000000000002)] + [("null", None), ("nan", float("nan"))]
    return rows + [("wide", float("nan")), ("hot", None)]


def test_percentiles(spark):
    df = spark.createDataFrame(groups(), "g string, x double").repartition(7)
    kinds = {"p50": ("nearest", 50), "p95": ("nearest", 95), "p99": ("nearest", 99), "f90": ("floor", 90), "l95": ("linear", 95), "median": ("linear", 50), "least": ("floor", 0), "most": ("nearest", 100)}
    got = {r["g"]: r for r in S.percentiles(df, "g", "x", kinds).collect()}
    by = {}
    for g, x in groups():
        if x is not None and not np.isnan(x):
            by.setdefault(g, []).append(x)
    assert got.keys() == by.keys()
    for g, values in by.items():
        v, n = sorted(values), len(values)
        r = got[g]
        assert r["n"] == n and (r["least"], r["most"]) == (v[0], v[-1])
        assert [r["p50"], r["p95"], r["p99"]] == [v[-(-n * p // 100) - 1] for p in (50, 95, 99)] and r["f90"] == v[(n - 1) * 90 // 100]
        if g != "wide":
            assert np.isclose(r["l95"], np.percentile(v, 95), rtol=1e-12) and np.isclose(r["median"], np.median(v), rtol=1e-12)
    assert S.percentiles(df.where("false"), "g", "x", kinds).collect() == []


def test_as_of_with_a_hot_conversation(spark):
    rng = np.random.default_rng(4)
    of = lambda i: 7 if i % 2 else int(rng.integers(40))
    traces = [(i, of(i), int(rng.integers(2000)), ("rag_query", "other")[i % 3 == 0], int(rng.integers(3))) for i in range(5000)]
    messages = [(10**6 + i, of(i), int(rng.integers(2000))) for i in range(2000)] + [(5, 99, 10), (6, 7, -1), (8, None, 3)]
    t = spark.createDataFrame(traces, "id long, conversation_id long, at long, node string, n_sources int")
    m = spark.createDataFrame(messages, "id long, conversation_id long, at long")
    got = {r["id"]: (r["trace_id"], r["n_sources"]) for r in D.last_trace_before(m, t, "rag_query").collect()}
    by = {}
    for i, c, at, node, n in traces:
        if node == "rag_query":
            by.setdefault(c, []).append((i, at, n))
    for i, c, at in messages:
        before = [(j, n) for j, a, n in by.get(c, []) if a <= at]
        assert got[i] == (max(before) if before else (None, None))
    assert len(got) == len(messages)


def test_running_max_over_ranges(spark):
    rows = [(1 if i % 3 else i % 5, i, int((i * 7919) % 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, at long, x long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r["at"]: r["best"] for r in S.running_max(df, "key", [F.col("at")], "x", "best").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    best = {}
    for key, at, x in sorted(rows, key=lambda r: r[1]):
        best[key] = max(best.get(key, -1), x)
        assert got[at] == best[key]
