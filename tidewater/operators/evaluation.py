"""Scores of a release: retrieval against gold and forbidden documents, evidence, behaviour and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import citations
from tidewater.functions.text import sentences as cited_sentences


def release_retrieval(hits: DataFrame, gold: DataFrame, forbidden: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per query: recall, mrr, all_gold and hit_rate at k (null without gold), forbidden hits and whether it passed.

    hits: query_id, chunk_id, rank. Passed: all gold found and nothing forbidden.
    """
    top = hits.where(F.col("rank") <= k).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    found = gold.distinct().join(top, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("gold_n"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    bad = top.join(forbidden.distinct(), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("bad"))
    rows = queries.select("query_id").join(found, "query_id", "left").join(bad, "query_id", "left")
    some, bad_n = F.col("gold_n").isNotNull(), F.coalesce("bad", F.lit(0))
    return rows.select(
        "query_id", F.when(some, F.col("found") / F.col("gold_n")).alias("recall"), F.when(some, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(some, F.col("found") == F.col("gold_n")).alias("all_gold"), F.when(some, (F.col("found") > 0).cast("int")).alias("hit_rate"), bad_n.cast("long").alias("forbidden_hits"),
        (F.coalesce(F.col("found") == F.col("gold_n"), F.lit(True)) & (bad_n == 0)).alias("passed"),
    )


def fixed_precision(hits: DataFrame, gold: DataFrame, complete: DataFrame, k: int) -> DataFrame:
    """Precision over exactly k places, only for queries whose relevance is complete; repeated hits count once."""
    top = hits.where(F.col("rank") <= k).select("query_id", "chunk_id").distinct()
    good = top.join(gold.distinct(), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    return complete.select("query_id").join(good, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("precision"))


def parent_coverage(hits: DataFrame, gold: DataFrame, parent: Column) -> DataFrame:
    """Share of the gold's parent documents that some hit belongs to."""
    of = lambda df: df.select("query_id", parent.alias("parent")).distinct()
    found = of(gold).join(of(hits).withColumn("hit", F.lit(1)), ["query_id", "parent"], "left")
    return found.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("coverage"))


def any_hit(hits: DataFrame, gold: DataFrame, at: tuple[int, ...]) -> DataFrame:
    """Share of the queries with gold that have any gold hit among the first k."""
    best = gold.distinct().join(hits, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return best.agg(F.count("*").alias("queries"), *(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("int")).alias(f"hit_{k}") for k in at))


def fact_coverage(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """query_id, facts and covered: a fact (query_id, fact_id, pattern) counts if an allowed segment (query_id, text, allowed) has its text."""
    joined = facts.join(segments.where("allowed").select("query_id", "text"), "query_id", "left")
    each = joined.groupBy("query_id", "fact_id").agg(F.coalesce(F.max(F.contains(F.col("text"), F.col("pattern"))), F.lit(False)).alias("covered"))
    return each.groupBy("query_id").agg(F.count("*").alias("facts"), F.count_if("covered").alias("covered"))


def leaked(denied: Column, *observed: Column) -> Column:
    """Denied items that one of the lists shows, in order."""
    return F.array_sort(F.array_intersect(denied, F.array_distinct(F.concat(*observed))))


def key_coverage(expected: Column, observed: Column) -> Column:
    """Share of the expected keys that were observed; with none expected 1 if none was observed, else 0."""
    found = F.size(F.array_intersect(expected, observed)) / F.size(F.array_distinct(expected))
    return F.when(F.size(expected) == 0, (F.size(observed) == 0).cast("double")).otherwise(found)


#: Phrases that ask for more, and that refuse.
ASKS, REFUSALS = ("could you", "which", "please provide", "?"), ("cannot", "not able", "no information")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def asking(text: Column) -> Column:
    """The sentences that ask the user for something."""
    has = lambda x: F.greatest(*(F.contains(F.lower(x), F.lit(p)) for p in ASKS))
    return F.filter(sentences(text), has)


def behaviour(text: Column) -> Column:
    """clarify, refuse or answer; null for a blank text."""
    refuses = F.exists(sentences(text), lambda x: F.greatest(*(F.contains(F.lower(x), F.lit(p)) for p in REFUSALS)))
    return F.when(F.size(sentences(text)) == 0, None).when(refuses, "refuse").when(F.size(asking(text)) > 0, "clarify").otherwise("answer")


def accuracy_by(rows: DataFrame, expected: str, found: str) -> DataFrame:
    """Per expected value: rows judged (a null verdict is left out) and the share that agrees."""
    return rows.groupBy(expected).agg(F.count(found).alias("judged"), F.avg((F.col(found) == F.col(expected)).cast("int")).alias("accuracy"))


def gate_confusion(rows: DataFrame) -> DataFrame:
    """Unsafe and safe cases that were generated before and after a gate (unsafe, before, after)."""
    n = lambda text, name: F.count_if(F.expr(text)).alias(name)
    return rows.agg(n("unsafe and before", "unsafe_before"), n("unsafe and after", "unsafe_after"), n("not unsafe and before", "safe_before"), n("not unsafe and after", "safe_after"), F.count("*").alias("cases"))


def review_scores(observed: DataFrame, annotated: DataFrame, key: str) -> DataFrame:
    """Per group: claims, ratios of faithful and correct ones (null without claims), and unmatched rows, which make all ratios 0."""
    joined = observed.select(key, "grouped", F.lit(True).alias("seen")).join(annotated.select(key, "faithful", "correct", F.lit(True).alias("reviewed")), key, "full_outer")
    found = joined.groupBy(F.coalesce("grouped", F.lit("none")).alias("grouped")).agg(
        F.count_if(F.col("seen") & F.col("reviewed")).alias("claims"), F.count_if(F.col("seen").isNull() | F.col("reviewed").isNull()).alias("errors"),
        F.sum(F.when(F.col("seen"), F.col("faithful"))).alias("f"), F.sum(F.when(F.col("seen"), F.col("correct"))).alias("c"),
    )
    ratio = lambda x: F.when(F.col("errors") > 0, F.lit(0.0)).otherwise(F.try_divide(x, F.col("claims")))
    return found.select("grouped", "claims", "errors", ratio(F.col("f")).alias("faithful"), ratio(F.col("c")).alias("correct"))


def scored_answers(cases: DataFrame) -> DataFrame:
    """Per case: facts_total, present, supported, cited, unknown and forbidden citations, and passed.

    cases: case_id, answer, behaves, injected array<struct<document_id,text>> in prompt order, facts
    array<struct<pattern,evidence>>, required and forbidden arrays of document ids. A fact is present if a sentence
    matches its pattern, supported if a segment of its evidence does too, and cited if each such sentence cites one
    of those segments. Null answers and arrays are empty ones; a case passes if it behaves, all facts are cited and
    nothing required is missing or forbidden shown. One row holds one case, so nothing is shuffled.
    """
    said, shown = cited_sentences(F.coalesce("answer", F.lit(""))), F.col("injected")
    empty = F.array().cast("array<bigint>")
    rows = cases.select(
        "case_id", F.coalesce("behaves", F.lit(False)).alias("behaves"), F.coalesce("facts", F.array().cast(cases.schema["facts"].dataType)).alias("facts"),
        F.coalesce("injected", F.array().cast(cases.schema["injected"].dataType)).alias("injected"), F.coalesce("required", empty).alias("required"),
        F.coalesce("forbidden", empty).alias("forbidden"), citations(F.coalesce("answer", F.lit(""))).alias("cites"),
        F.transform(said, lambda s: F.struct(F.regexp_replace(s, r"\[证据[1-9][0-9]*\]", "").alias("text"), citations(s).alias("cites"))).alias("said"),
    )
    local = lambda f: F.filter("said", lambda s: F.regexp_like(s["text"], f["pattern"]))
    numbers = lambda f: F.filter(F.transform(shown, lambda d, i: F.when(F.array_contains(f["evidence"], d["document_id"]) & F.regexp_like(d["text"], f["pattern"]), (i + 1).cast("string"))), lambda x: x.isNotNull())
    each = F.transform("facts", lambda f: F.struct(local(f).alias("local"), numbers(f).alias("numbers")))
    judged = rows.withColumn("each", each).withColumn("each", F.transform("each", lambda e: F.struct(
        (F.size(e["local"]) > 0).alias("present"), ((F.size(e["local"]) > 0) & (F.size(e["numbers"]) > 0)).alias("supported"),
        ((F.size(e["local"]) > 0) & F.forall(e["local"], lambda s: F.arrays_overlap(s["cites"], e["numbers"]))).alias("cited"))))
    place = lambda n: F.coalesce(n.try_cast("int"), F.lit(2**31 - 1))
    ids = F.transform("injected", lambda d: d["document_id"])
    at = F.filter(F.transform("cites", lambda n: F.get("injected", place(n) - 1)["document_id"]), lambda x: x.isNotNull())
    count = lambda name: F.size(F.filter("each", lambda e: e[name]))
    scored = judged.select(
        "case_id", "behaves", F.size("facts").alias("facts_total"), count("present").alias("present"), count("supported").alias("supported"), count("cited").alias("cited"),
        F.size(F.filter("cites", lambda n: place(n) > F.size("injected"))).alias("unknown"), F.size(F.array_intersect("forbidden", at)).alias("forbidden_cited"),
        F.size(F.array_intersect("forbidden", ids)).alias("forbidden_shown"), F.size(F.array_except("required", ids)).alias("required_missing"),
    )
    good = F.expr("behaves AND cited = facts_total AND supported = facts_total AND unknown + forbidden_cited + forbidden_shown + required_missing = 0")
    return scored.withColumn("passed", good).drop("behaves")


def release_report(suite: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Per mode: cases, passed, failed and missing ones, and the sums of facts over all cases; a case without a result is missing.

    suite: mode, the key's columns, facts_total; results: mode, the key's columns, passed, facts. Repeated results of a case
    fail it.
    """
    judged = _judged(suite, results, key)
    count = lambda state: F.count_if(F.col("state") == state).alias(state)
    return judged.groupBy("mode").agg(F.count("*").alias("total"), count("passed"), count("failed"), count("missing"), F.sum("facts").alias("facts"), F.sum("facts_total").alias("facts_total"))


def release_failures(suite: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """A row for each case that failed or is missing: mode, the key's columns and state. No list of a mode is gathered."""
    return _judged(suite, results, key).where("state <> 'passed'").select("mode", *key, "state")


def _judged(suite: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    by = ["mode", *key]
    one = results.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"), F.max("facts").alias("facts"))
    state = F.when(F.col("n").isNull(), "missing").when((F.col("n") == 1) & F.col("passed"), "passed").otherwise("failed")
    return suite.select(*by, "facts_total").join(one, by, "left").select(*by, "facts_total", F.coalesce("facts", F.lit(0)).alias("facts"), state.alias("state"))
