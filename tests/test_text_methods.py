"""Segmentation, character similarity and JSON objects in answers against plain versions."""

import difflib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import answers
from tidewater.operators import segmentation as G
from tidewater.operators import similarity as S

WORDS = {"证书": 50, "续期": 5, "证": 9, "书": 3, "期": 2, "过期": 20, "防火": 30, "火墙": 30, "防": 1, "中文": 8, "文": 4, "中": 3, "文中": 8, "a": 7, "防火墙a": 3}


def plain_cut(lexicon, run):
    """The best of all cuts, longer words first at equal scores."""
    n, best = len(run), None
    for bits in itertools.product((0, 1), repeat=n - 1):
        edges = [0, *(i + 1 for i, x in enumerate(bits) if x), n]
        words = [run[a:b] for a, b in itertools.pairwise(edges)]
        if all(len(w) == 1 or lexicon.freq.get(w) for w in words):
            score = sum(math.log(lexicon.freq.get(w) or 1.0) - math.log(lexicon.total) for w in words)
            key = (round(score, 9), [len(w) for w in words])
            if best is None or key > best[0]:
                best = key, words
    return best[1]


def texts():
    rng = np.random.default_rng(9)
    runs = ["".join(rng.choice(list("证书续期过防火墙中文错码误"), rng.integers(1, 9))) for _ in range(60)]
    rows = [(i, f"x1 {r}, Zeit{r}!") for i, r in enumerate(runs)]
    return rows + [(100, "证书续期失败"), (101, None), (102, ""), (103, "no han"), (104, "防火墙错误码800"), (None, "中文中")]


@pytest.mark.parametrize("small", [1000, 0])
def test_segmentation(spark, small):
    words = spark.createDataFrame([*WORDS.items(), ("证书", 0), (None, 3), ("坏", None)], "word string, freq long").repartition(3)
    lexicon = G.Lexicon({w: f for w, f in WORDS.items() if all("一" <= c <= "鿿" for c in w)}, sum(f for w, f in WORDS.items() if all("一" <= c <= "鿿" for c in w)), G.TERMS)
    got = {r["id"]: r["terms"] for r in G.segmented(spark.createDataFrame(texts(), "id long, text string").repartition(4), words, small=small).collect()}
    assert got.keys() == {i for i, _ in texts()} and got[101] == got[102] == [] and got[103] == ["no", "han"]
    for i, t in texts():
        want = []
        for m in G._RUNS.finditer(t or ""):
            want += plain_cut(lexicon, m.group()) if m.group("han") else [m.group()]
        assert got[i] == want, t
    assert got[100][0] == "证书续期" and got[104][:2] == ["防火墙", "错误码"]  # custom terms stay whole
    assert G.segmented(spark.createDataFrame([(1, "中文")], "id long, text string"), words.where("false"), small=small, terms=()).collect() == [(1, ["中", "文"])]


def test_large_dictionary_sends_no_other_pieces(spark, monkeypatch):
    """Beyond the common words, only pieces that are words of the dictionary travel, and the cut is the same."""
    monkeypatch.setattr(G, "COMMON_ROWS", 5)
    rng = np.random.default_rng(4)
    han = list("证书续期过防火墙中文错码误拨号连接失败客户端配置路由表")
    words = {"".join(rng.choice(han, n)): int(rng.integers(1, 50)) for n in range(1, 8) for _ in range(60)}
    rows = [(i, "".join([*rng.choice(list(words), 40), " x ", *rng.choice(han, 30)])) for i in range(50)]
    docs, dictionary = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([*words.items()], "word string, freq long")
    sent = G.candidates(docs.select(docs.id.alias("key"), "text"), G.word_filter(dictionary, len(words))).collect()
    true = {(i, t[a:b]) for i, t in rows for a in range(len(t)) for b in range(a + 1, min(len(t), a + G.LONGEST) + 1) if t[a:b] in words}
    assert true <= set(map(tuple, sent)) and len(sent) <= 1.01 * len(true)
    cut = lambda small: {r["id"]: r["terms"] for r in G.segmented(docs, dictionary, small=small).collect()}
    assert cut(100) == cut(1 << 20)


def test_pieces_travel_once_for_a_batch_of_texts(spark, monkeypatch):
    """Texts of few words send them once together, not each, and the cut does not depend on the batches."""
    rng = np.random.default_rng(6)
    han = list("证书续期过防火墙中文错码误拨号连接失败客户端配置路由表")
    words = {"".join(rng.choice(han, n)): int(rng.integers(1, 50)) for n in range(2, 7) for _ in range(40)}
    rows = [(None if i % 50 == 7 else i, None if i % 40 == 3 else "".join([*rng.choice(list(words), 60), "。x ", *rng.choice(han, 20)])) for i in range(400)]
    docs, dictionary = spark.createDataFrame(rows, "id long, text string").repartition(2), spark.createDataFrame([*words.items()], "word string, freq long")
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.Collections.emptyList()

    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    cut = lambda small: sorted((r["id"] or -1, r["terms"]) for r in G.segmented(docs, dictionary, small=small).collect())
    want = cut(1 << 20)
    docs = docs.cache()
    docs.count()
    before = shuffled()
    assert cut(0) == want
    assert sum(n for stage, n in shuffled().items() if stage not in before) < sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(G, "TEXTS", 3)
    monkeypatch.setattr(G, "BATCH_TEXTS", 7)
    assert cut(0) == cut(20) == want
    monkeypatch.setattr(G, "BATCH_CHARS", 1)
    assert cut(0) == want


@pytest.mark.parametrize("cells", [1 << 22, 0])
def test_ratio_is_difflibs(cells, monkeypatch):
    monkeypatch.setattr(S, "CELLS", cells)
    rng = np.random.default_rng(2)
    say = lambda n, k: "".join(rng.choice(list("abcdefghij 证书"[:k]), n))
    pairs = [(say(rng.integers(0, 40), 6), say(rng.integers(0, 40), 6)) for _ in range(150)]
    base = say(120, 13)
    pairs += [(base, base[:50] + "XX" + base[60:]), ("", ""), ("a", ""), ("qabxcd", "abycdf"), (say(260, 12), say(300, 12)), (base * 3, base[5:] * 3), ("é" * 250, "é" * 210)]
    for a, b in pairs:
        assert abs(S.ratio(S.codes(a), S.codes(b)) - difflib.SequenceMatcher(None, a, b).ratio()) < 1e-12, (a, b)


def test_similar(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 8)
    monkeypatch.setattr(S, "PANEL", 3)
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdefgh "), 40)) for _ in range(6)]
    rows = []
    for i in range(90):
        t = list(base[i % 6])
        for p in rng.integers(0, 40, rng.integers(0, 9)):
            t[p] = "z"
        rows.append((i, None if i % 17 == 0 else "hot" if i % 2 else f"f{i % 3}", "".join(t)))
    rows += [(200, "hot", None), (201, "hot", ""), (202, "hot", ""), (None, "hot", "abc")]
    df = spark.createDataFrame(rows, "id long, family string, text string").repartition(5)
    got = {r["id"]: (r["similar"], r["other"], r["ratio"]) for r in S.similar(df, F.col("id") % 3 == 0, 0.7).collect()}
    for i, f, t in rows:
        if i is not None and t is not None and i % 3 == 0:
            near = sorted((-r, j) for j, g, u in rows if j is not None and u is not None and j != i and f == g and (r := difflib.SequenceMatcher(None, t, u).ratio()) >= 0.7)
            assert got.pop(i) == (len(near), near[0][1] if near else None, -near[0][0] if near else None)
    assert not got


def test_first_object(spark):
    cases = {
        'Sure: {"a": 1} and {"b": 2}': '{"a": 1}', '```json\n{"a": {"b": "}"}}\n```': '{"a": {"b": "}"}}', "no": None, "{not json} {\"ok\": true}": '{"ok": true}',
        '{"q": "he said \\"{\\" ok"} x': '{"q": "he said \\"{\\" ok"}', '{ "open {"x": 1}': '{"x": 1}', "{{{{": None, '}{"z":[]}': '{"z":[]}', "": None, '[1, {"in": 2}]': '{"in": 2}', "{" * 50000: None,
    }
    rows = [(i, t) for i, t in enumerate(cases)] + [(99, None)]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i long, t string").select("i", answers.first_json("t").alias("x")).collect()}
    assert got == {i: cases.get(t) for i, t in rows}


def test_strict_types(spark):
    fields = {"enough": "boolean", "missing": "array<string>", "next": "string", "n": "long"}
    rows = [
        ('{"enough": true, "missing": ["a", "b\\"]"], "next": "x", "n": 3}', (True, ["a", 'b"]'], "x", 3)), ('{"enough": "true", "missing": [1], "next": 5, "n": 3.5}', (None, None, None, None)),
        ('{"enough": 1, "missing": [], "next": "", "n": "3"}', (None, [], "", None)), ("{}", (None,) * 4), ("broken", (None,) * 4), (None, (None,) * 4), ('{"enough": false, "missing": "a", "next": null}', (False, None, None, None)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, t string")
    got = {r["i"]: tuple(r["x"]) for r in df.select("i", answers.strict(F.col("t"), fields).alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


@pytest.mark.parametrize("together", [1 << 19, 50])
def test_pairs_are_compared_together(together, monkeypatch):
    """Every pair of a product in few rounds, also those given up early and those too large to keep."""
    monkeypatch.setattr(S, "TOGETHER", together)
    monkeypatch.setattr(S, "CELLS", 20000)
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefghij 证书"[: rng.integers(2, 13)]), rng.integers(0, 260))) for _ in range(24)] + ["", "", "a"]
    mine, may = [S.codes(t) for t in texts], [np.array([j for j in range(len(texts)) if j != i and (i + j) % 3], np.int64) for i in range(len(texts))]
    for floor in (0.0, 0.2, 0.6):
        for a, some, (at, ratios) in zip(texts, may, S._near(mine, mine, may, floor), strict=True):
            want = {int(j): r for j in some if (r := difflib.SequenceMatcher(None, a, texts[j]).ratio()) >= floor}
            assert dict(zip(at.tolist(), ratios.tolist(), strict=True)) == want
