"""Decontamination finds every window that reaches the similarity, and documents shorter than an item."""

import numpy as np

from tidewater.llm import decontaminate
from tidewater.llm import words as W


def best_windows(items, text):
    """{item: similarity} by comparing every window of every item exactly."""
    h, found = W.hashes(decontaminate.plain(text)), {}
    for i, (size, words) in enumerate(zip(items.sizes, items.words, strict=True)):
        if len(h) < size:
            continue
        s = decontaminate.shingles(h, size)
        width = min(words, len(h)) - size + 1
        alike = max(items.similarity(i, s[k : k + width]) for k in range(len(s) - width + 1))
        if alike >= decontaminate.PERCENT / 100 - 1e-9:
            found[items.ids[i]] = alike
    return found


def test_no_window_is_lost():
    rng = np.random.default_rng(4)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 100000, n)]
    texts, docs = [], []
    for i in range(900):
        n, changes = [(50, 1), (150, 3), (200, 4)][i % 3]
        item = say(n)
        doc = item[:]
        for k in range(changes):  # apart, so that the similarity is 0.80 to 0.82
            doc[(k + 1) * n // (changes + 1)] = f"x{i}"
        texts.append((i, " ".join(item)))
        docs.append(" ".join(say(7) + doc + say(9)))
    items = decontaminate.Items(texts)
    for i, doc in enumerate(docs):
        assert i in {x[0] for x in items.search(doc)}, i
    for doc in docs[::60]:
        assert {x[0]: round(x[3], 9) for x in items.search(doc)} == {k: round(v, 9) for k, v in best_windows(items, doc).items()}


def test_repeats_and_shared_text():
    rng = np.random.default_rng(6)
    pool = [f"w{x}" for x in range(12)]
    texts = [(i, " ".join(rng.choice(pool[: 2 + i % 11], 3 + 2 * (i % 9)))) for i in range(60)]
    items = decontaminate.Items(texts)
    for _ in range(40):
        parts = [texts[j][1] for j in rng.integers(0, 60, 3)]
        doc = " ".join([*parts, *rng.choice(pool[:3], 15)])
        assert {x[0]: round(x[3], 9) for x in items.search(doc)} == {k: round(v, 9) for k, v in best_windows(items, doc).items()}


def test_document_shorter_than_an_item(spark):
    item = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(item[:95])), (2, " ".join(item[:60])), (3, "w0 w1 w2"), (4, " ".join(item))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found.keys() == {1, 4} and found[1]["n_words"] == 95 and abs(found[1]["similarity"] - 91 / 96) < 1e-9
