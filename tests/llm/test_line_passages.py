"""Repeated passages of fewer than three lines in line dedup."""

from collections import defaultdict

import brute
import numpy as np

import corpus_pipeline
from tidewater.llm import line_dedup

SF = "/root/testdata/sf0.01"


def passages(rows, run=line_dedup.RUN, words=line_dedup.PASSAGE_WORDS):
    """{doc_id: (n_lines, n_removed, text)}: every window of run lines, or of fewer with so many words, but its first place."""
    places, texts = defaultdict(list), {}
    for d, t in sorted(rows):
        every = [] if t is None else t.split("\n")
        at = [i for i, x in enumerate(every) if brute.WORD.search(x)]
        texts[d] = t, every, at
        for size in range(1, run + 1):
            for k in range(len(at) - size + 1):
                window = tuple(every[i] for i in at[k : k + size])
                if size == run or sum(len(brute.words(x)) for x in window) >= words:
                    places[window].append((d, k))
    gone = defaultdict(set)
    for window, found in places.items():
        for d, k in sorted(found)[1:]:
            gone[d].update(texts[d][2][k : k + len(window)])
    return {d: (len(at), len(gone[d]), None if t is None else "\n".join(x for i, x in enumerate(every) if i not in gone[d])) for d, (t, every, at) in texts.items()}


def planted():
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    single, one, two, short = say(60), say(30), say(25), say(49)
    rows = [(1, single), (2, single), (3, f"{say(9)}\n\n{single}\n{say(5)}"), (4, f"{one}\n{two}"), (5, f"{say(4)}\n{one}\n \n{two}\n{say(6)}"), (6, f"{two}\n{one}")]
    rows += [(7, short), (8, short), (9, f"{single}\nx\n{single}"), (10, None), (11, ""), (12, f"a\nb\n{single}\nb\n{single}\nb")]
    pool = [say(int(n)) for n in rng.integers(1, 70, 12)]  # few lines, so that windows of all sizes recur and overlap
    return rows + [(20 + i, "\n".join(pool[x] for x in rng.integers(0, 12, rng.integers(1, 9)))) for i in range(60)]


def test_single_lines_and_pairs(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["__lines"], r["__removed"], r["text"]) for r in line_dedup.passages(df).collect()}
    assert got[1][1] == 0 and got[2][1] == 1 and got[3][1] == 1  # a single line of 60 words
    assert got[4][1] == 0 and got[5][1] == 2 and got[6][1] == 0  # a pair of 55 words
    assert got[7][1] == got[8][1] == 0
    assert got == passages(rows)


def test_passages_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = passages(rows)
    got = {r["doc_id"]: (r["__lines"], r["__removed"], r["text"]) for r in line_dedup.passages(docs).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {} and got.keys() == want.keys()
    assert want != brute.line_dedup(rows)


def test_pipeline_stage(spark):
    df = spark.createDataFrame(planted()[:3], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    left = {r["doc_id"]: r["text"] for r in stage(spark, df, SF).collect()}
    assert left.keys() == {1, 3} and len(left[3].split()) == 14
