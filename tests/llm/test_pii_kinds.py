"""Recall and precision of each added kind on planted rows, and estimates that few patterns cannot turn round."""

import pytest

from tidewater.llm import pii

PLANTED = {
    "name": ["please contact {} today", "then {} came along", "a letter by {} arrived"], "address": ["she lives at {} now", "address: {} please"], "birth": ["born on {} in spring", "dob: {} noted"],
    "id": ["my ssn {} please", "social security number {} on file"], "tel": ["call {} after noon", "tel: {} or write"], "secret": ["password: {} ok", "api_key={} here"],
}
VALUES = {
    "name": lambda i: f"{['John', 'Mary', 'Thomas', 'Julia'][i % 4]} {['Smith', 'Baker', 'Müller', 'Turner', 'Oakley'][i % 5]}",
    "address": lambda i: f"{100 + i} {['Maple', 'Church', 'Station'][i % 3]} {['Street', 'Road', 'Lane'][i % 3]}", "birth": lambda i: f"{1950 + i % 50}-0{1 + i % 9}-{10 + i % 18}",
    "id": lambda i: f"{100 + i}-{10 + i % 80}-{1000 + i}", "tel": lambda i: f"0{30 + i % 60} {200 + i}-{4000 + i}", "secret": lambda i: f"hunter{i}x!q",
}
DECOYS = {
    "name": ["the John Street corner", "at Mary Lane"], "id": ["part no {id} fits", "order number {id} shipped"], "tel": ["a ratio 12 345-6789 was", "lines 10 200-4000 changed"],
    "birth": ["due 2031-05-11 sharp"], "secret": ["version2 chapter-12 pages"],
}


def rows(kinds):
    out, i = [], 0
    for kind in kinds:
        for t in PLANTED[kind]:
            for j in range(40):
                value = VALUES[kind](j)
                text = f"In row {i} " + t.format(value)
                out.append((i, text, kind, text.index(value), text.index(value) + len(value)))
                i += 1
    for kind, texts in DECOYS.items():
        for t in texts:
            for j in range(40):
                out.append((i, f"In row {i} " + t.format(id=VALUES["id"](j)), None, kind, None))
                i += 1
    return out


def judged(spark, planted, **more):
    df = spark.createDataFrame([(r[0], r[1]) for r in planted], "doc_id long, text string")
    return {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["rank"] >= pii.BASE} for r in pii.find(df, **more).collect()}


def test_every_kind_is_found_and_decoys_are_not(spark):
    planted = rows(PLANTED)
    got = judged(spark, planted)
    for kind in PLANTED:
        mine = [r for r in planted if r[2] == kind]
        found = sum((kind, r[3], r[4]) in got[r[0]] for r in mine)
        assert found >= 0.95 * len(mine), (kind, found, len(mine))
    for kind in DECOYS:
        mine = [r for r in planted if r[2] is None and r[3] == kind]
        assert sum(any(x[0] == kind for x in got[r[0]]) for r in mine) <= 0.05 * len(mine), kind


@pytest.mark.parametrize("kind", ["name", "id", "tel"])
def test_a_kind_alone_is_found(spark, kind):
    """The verdict on one sentence does not turn on what else is in the table."""
    planted = [r for r in rows([kind]) if r[2]]
    got = judged(spark, planted)
    assert sum((kind, r[3], r[4]) in got[r[0]] for r in planted) >= 0.95 * len(planted)


def test_gazetteer_is_a_parameter(spark):
    planted = [(1, "then Zebulon Smith came", "name", 5, 18), (2, "then John Smith came", "name", 5, 15)]
    assert judged(spark, planted) == {1: set(), 2: {("name", 5, 15)}}
    names = spark.createDataFrame([("Zebulon",), (None,), ("",)], "name string")
    assert judged(spark, planted, given=pii.gazetteer(r["name"] for r in names.collect())) == {1: {("name", 5, 18)}, 2: set()}
    assert judged(spark, planted, given=pii.gazetteer([])) == {1: set(), 2: set()}


def test_estimates_are_anchored():
    yes, none, no = (1, 0, 0, 0, 0, 0), (0,) * 6, (0, 0, 0, 0, -1, 0)
    for counts in ({yes: 100}, {none: 1000, yes: 10}, {(1, 0, 1, 0, 0, 0): 10**6, no: 10**6}, {yes: 5, none: 5, no: 5}):
        posterior, chance = pii.estimate(counts)
        assert all(a[0] >= b[0] and a[2] <= b[2] for a, b in chance)
        rank = sorted(posterior, key=posterior.get)
        assert rank == sorted(posterior, key=sum) and posterior.get(none, 0) < 0.5 and posterior.get(no, 0) < 0.5
    assert pii.estimate({yes: 100})[0][yes] > 0.5
