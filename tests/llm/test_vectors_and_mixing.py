"""Hard negatives, whitening and mixing against plain versions, on odd rows too."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import hard_negatives, mixing, queries, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
CLASH = "1 as id, 2 as key, 3 as grp, 4 as block, 5 as x, 6 as k, 7 as n, 8 as a, 9 as b, 10 as place, 11 as score, 12 as windows, 13 as to, 14 as rank"


def odd_vectors():
    """Nulls, non-finite entries, ties, repeats, short and negative vectors, one label of a third of all rows."""
    rng = np.random.default_rng(3)
    rows = [(i, int(0 if i % 3 == 0 else i % 5), [float(x) for x in rng.normal(size=7)]) for i in range(300)]
    rows += [(i, 2, [0.5] * 7) for i in range(300, 340)] + [(i, 3, [0.5] * 7) for i in range(340, 380)]  # ties
    rows += [(400, None, [1.0] * 7), (500, 1, None), (600, 1, [1.0, None, 1.0]), (700, 1, [NAN] * 7), (701, 2, [INF] + [0.0] * 6), (None, 1, [0.25] * 7)]
    rows += [(800, 1, [1.0, 2.0]), (900, 1, []), (1000, 4, [-0.3] * 7), (1001, 4, [0.3] * 7)]
    return rows + [rows[100], rows[100], (200, 4, [0.1] * 7)]


def plain_negatives(rows):
    usable = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        usable[(vec_id, label, tuple(int(np.floor(256 * float(c))) for c in v))] = 1
    usable = sorted(usable)
    out = []
    for anchor in usable:
        if anchor[0] % 100:
            continue
        dot = lambda o: sum(p * q for p, q in zip(anchor[2], o[2], strict=False))
        ranked = sorted(((-dot(o), o[0], o) for o in usable if o != anchor))
        for p, positive_id, _ in [x for x in ranked if x[2][1] == anchor[1]][:5]:
            near = [(n, i) for n, i, o in ranked if o[1] != anchor[1] and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(anchor[0], positive_id, k, i, -p, -n) for k, (n, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_vectors(), "vec_id long, label int, embedding array<float>").selectExpr("vec_id", "label", "embedding", *CLASH.split(", ")).repartition(5)


def test_hard_negatives_on_odd_rows(spark, odd):
    rows = [(r[0], r[1], r[2]) for r in odd.select("vec_id", "label", "embedding").collect()]
    want = plain_negatives(rows)
    assert len(want) > 60
    for sizes in ({}, {"row_block": 16, "anchor_block": 2}):  # one tile, and many
        assert sorted(tuple(r) for r in hard_negatives.mine(odd, F.col("id") % 100 == 0, **sizes).collect()) == want


def test_hard_negatives_query(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_hard_negatives(spark, SF).collect()) == plain_negatives(rows)


def test_many_chunks_and_large_components(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i % 2, [float(x) for x in rng.uniform(-4.4e4, 4.4e4, 300)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 20 == 0, row_block=13).where("anchor_id % 100 = 0").collect()) == plain_negatives(rows)
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1e17]), (1, 1, [1e17])], df.schema), F.col("id") == 0).collect()


def shuffled_bytes(spark):
    """Of all stages that the session remembers, by number."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.Collections.emptyList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_scores_are_not_shuffled(spark):
    """Panels travel, tiles of anchors times rows do not; a task's tiles leave one top-k together."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, [float(x) for x in rng.normal(size=16)]) for i in range(2500)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4).cache()
    df.count()
    before = shuffled_bytes(spark)
    whole = sorted(map(tuple, hard_negatives.mine(df, F.col("id") >= 0).collect()))
    assert sum(n for stage, n in shuffled_bytes(spark).items() if stage not in before) < 2 * 2500**2 // 2
    some = {100 * i for i in range(25)}
    assert [r for r in whole if r[0] in some] == sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 100 == 0, row_block=100, anchor_block=7).collect())) == plain_negatives(rows)


def test_no_vectors(spark, odd):
    for none in (odd.where("false"), odd.where("vec_id = 500"), odd.where("vec_id = 101")):
        assert hard_negatives.mine(none, F.col("id") % 100 == 0).collect() == []
    for none in (odd.where("false"), odd.where("vec_id = 500"), odd.where("vec_id between 310 and 320")):
        assert whitening.whiten(none).collect() == []


def check_whitening(found, rows, components=16):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in usable)
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in usable], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    want = ((n * x - s) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    deviations = ((n * x - s).astype(object) ** 2).sum(axis=1)
    assert len(found) == len(usable) * k and {r["n"] for r in found} == {n}
    assert all(r["identity_error"] < 1e-9 and abs(r["explained"] * values.sum() / values[r["component"] - 1] - 1) < 1e-9 for r in found)
    by = defaultdict(list)
    for r in found:
        by[r["component"]].append((r["vec_id"], r["deviation"], r["whitened"]))
    for component, mine in by.items():
        theirs = [(i, d, w) for (i, _), d, w in zip(usable, deviations.tolist(), want[:, component - 1].tolist(), strict=True)]
        key = lambda t: (t[0] is None, t[0] or 0, t[1])
        a, b = sorted(mine, key=key), sorted(theirs, key=key)
        assert [t[:2] for t in a] == [t[:2] for t in b]
        y, z = np.array([t[2] for t in a]), np.array([t[2] for t in b])
        sign = np.sign(y @ z)
        assert np.abs(y - sign * z).max() < 1e-7


def test_whitening(spark, odd):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    for df, rows in ((table, None), (odd, None)):
        rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
        check_whitening(whitening.whiten(df).collect(), rows)


def test_whitening_of_few_directions(spark):
    """Three directions of variance in ten dimensions, copies by the hundred."""
    rng = np.random.default_rng(2)
    plane = rng.integers(-3, 4, (3, 10))
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 3) @ plane]) for i in range(80)] + [(1000 + i, [1.0] * 10) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(df).collect()} <= {1, 2, 3, 4}
    check_whitening(whitening.whiten(df).collect(), rows)


def test_block_lanczos_restarts_and_breaks_down():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(500, 500)))[0]
    for values in (np.linspace(1, 2, 500) ** 8, np.r_[np.full(20, 5.0), np.full(3, 2.0), np.zeros(477)], np.zeros(500)):
        matrix = turn * values @ turn.T
        passes = []
        found, vectors = whitening.block_lanczos(lambda q, m=matrix, p=passes: (p.append(1), m @ q)[1], 500, 16, basis_blocks=4)
        assert np.allclose(found, np.sort(values)[::-1][:16], atol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-10)
        assert np.linalg.norm(matrix @ vectors - vectors * found) < 1e-9


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = sum(weight[s] for s in order if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / left if left else 0
        more = {s for s in order if s not in full and weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def odd_documents():
    rows = [(i, "w " * (i % 40 + 1), ("big", "ünï", "a", "Z", None, "z\U0001f600", "z￿")[i % 7 if i % 3 else 0]) for i in range(900)]
    rows += [(900, None, "empty"), (901, "", "empty"), (902, " \n ", None), (None, "a b c", "a"), (5, "again", "a"), (5, "again", "a"), (903, "one", "tiny"), (904, "x " * 30000, "long")]
    return rows


@pytest.mark.parametrize("few", [False, True])
def test_mixing(spark, few, monkeypatch):
    if few:
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    rows = odd_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as rate", "3 as target", "4 as seed", "5 as c0", "6 as __of", "7 as copies").repartition(4)
    found = mixing.shares(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        low = int(np.floor(r["rate"] + 1e-12))
        assert r["copies"] in (low, low + 1) and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for source in ("big", "a", "ünï", "Z", None):
        assert abs(taken[source] - want[source]) < 0.02 * want[source] + 40
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.shares(df.repartition(3)).collect()))
    times = defaultdict(int)
    for r in mixing.emitted(df).collect():
        assert (r["size"], r["seed"], r["c0"], r["__of"]) == (1, 4, 5, 6)
        times[(r["doc_id"], r["text"], r["source"])] += 1
    mine = defaultdict(int)
    for r in found:
        mine[r["doc_id"]] += r["copies"]
    theirs = defaultdict(int)
    for (doc_id, _, _), k in times.items():
        theirs[doc_id] += k
    assert {k: v for k, v in mine.items() if v} == dict(theirs)
    assert mixing.shares(df.where("false")).collect() == []


def test_mixing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    found = {r["doc_id"]: r for r in queries.op13_mixing(spark, SF).collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in docs:
        assert found[r["doc_id"]]["size"] == len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += found[r["doc_id"]]["size"]
        taken[r["source"]] += found[r["doc_id"]]["taken"]
    want = plain_targets(sizes)
    assert all(abs(taken[s] - want[s]) < 0.05 * want[s] for s in sizes)
