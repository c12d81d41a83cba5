"""Suites of evaluation cases: a good one has no fault, and each rule is found where it is broken."""

import copy
import json

from tidewater.sources import fixtures as X

EXPECTED = {"action": "answer", "required_evidence": ["d1"], "forbidden_evidence": ["d2"], "facts": [{"id": "f1", "pattern": "renew", "evidence": ["d1"]}], "clarify_patterns": [], "answer_excludes": []}
GOOD = {
    "schema_version": 1, "documents": [{"id": "d1", "body": "x"}, {"id": "d2", "body": "y"}],
    "cases": [
        {"id": "c1", "family": "a", "split": "dev", "critical": True, "question": "q", "expected": EXPECTED},
        {"id": "c2", "family": "b", "split": "frozen", "critical": False, "question": "q", "expected": EXPECTED | {"action": "clarify", "clarify_patterns": ["which"]}},
        {"id": "c3", "family": "b", "split": "frozen", "critical": False, "question": "q", "expected": EXPECTED | {"action": "refuse", "required_evidence": [], "facts": []}},
    ],
}


def case(**change):
    def apply(s):
        s["cases"][0].update({k: v for k, v in change.items() if k in ("id", "family", "split", "critical")})
        s["cases"][0]["expected"].update({k: v for k, v in change.items() if k not in ("id", "family", "split", "critical")})

    return apply


BROKEN = {
    "unsupported version": (lambda s: s.update(schema_version=2), None), "no documents": (lambda s: s.update(documents=[]), None), "repeated document": (lambda s: s["documents"].append({"id": "d1"}), "d1"), "repeated case": (case(id="c3"), "c3"),
    "leaked family": (case(family="b"), "b"), "empty split": (case(split="frozen"), None), "unknown split": (case(split="test"), "c1"), "no critical flag": (case(critical=None), "c1"), "unknown action": (case(action="shout"), "c1"),
    "required and forbidden": (case(forbidden_evidence=["d1"]), "c1"), "repeated fact": (case(facts=EXPECTED["facts"] * 2), "c1"), "unsupported fact": (case(facts=[{"id": "f", "pattern": "x", "evidence": []}]), "c1"),
    "answer without evidence": (case(required_evidence=[], facts=[]), "c1"), "clarify without pattern": (case(action="clarify"), "c1"), "empty pattern": (case(answer_excludes=["a*"]), "c1"), "unknown document": (case(forbidden_evidence=["d9"]), "c1"),
}


def test_faults(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(GOOD, indent=1))
    (tmp_path / "no suite.json").write_text("{broken")
    for rule, (change, _) in BROKEN.items():
        suite = copy.deepcopy(GOOD)
        change(suite)
        (tmp_path / f"{rule}.json").write_text(json.dumps(suite, indent=1))
    suites = X.read(spark, str(tmp_path)).cache()
    found = {}
    for r in X.faults(suites).collect():
        found.setdefault(r["suite"].rpartition("/")[2].replace("%20", " ")[:-5], set()).add((r["rule"], r["case_id"]))
    assert "good" not in found and ("no suite", None) in found["no suite"]
    for rule, (_, where) in BROKEN.items():
        assert (rule, where) in found[rule], (rule, found.get(rule))
    good = suites.where("suite like '%good.json'")
    assert X.documents(good).count() == 2 and [r["id"] for r in X.cases(good).orderBy("id").collect()] == ["c1", "c2", "c3"]
