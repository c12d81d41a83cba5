"""Evaluation suites as JSON fixtures: their documents and cases as tables, and every rule that a suite breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version that is read, the splits and actions of a case.
VERSION, SPLITS, ACTIONS = 1, ("dev", "frozen"), ("answer", "clarify", "refuse")
_TEXTS = "array<string>"
_EXPECTED = f"struct<action:string,required_evidence:{_TEXTS},forbidden_evidence:{_TEXTS},facts:array<struct<id:string,pattern:string,evidence:{_TEXTS}>>,clarify_patterns:{_TEXTS},answer_excludes:{_TEXTS},refuse_patterns:{_TEXTS}>"
SCHEMA = f"schema_version int, documents array<struct<id:string,title:string,body:string>>, cases array<struct<id:string,family:string,split:string,critical:boolean,question:string,expected:{_EXPECTED}>>, broken string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each suite of a path: suite (its file), schema_version, documents, cases and, where it is no JSON of this shape, ``broken``."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return raw.select(F.input_file_name().alias("suite"), "*")


def documents(suites: DataFrame) -> DataFrame:
    return suites.select("suite", F.explode("documents").alias("d")).select("suite", "d.*")


def cases(suites: DataFrame) -> DataFrame:
    return suites.select("suite", F.explode("cases").alias("c")).select("suite", "c.*")


def faults(suites: DataFrame) -> DataFrame:
    """suite, rule and case_id (null for the whole suite) of every broken rule; no rows for good suites.

    Rules over many rows are groupings of exploded rows, those of a case are expressions over it.
    """
    whole = lambda condition, rule: suites.where(condition).select("suite", F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("case_id"))
    docs, rows = documents(suites), cases(suites)
    repeated = lambda df, rule: df.groupBy("suite", "id").count().where("count > 1").select("suite", F.lit(rule).alias("rule"), F.col("id").alias("case_id"))
    split = lambda name: F.count_if(F.col("split") == name)
    families = rows.groupBy("suite", "family").agg(*(split(x).alias(x) for x in SPLITS))
    leaked = families.where(" and ".join(f"{x} > 0" for x in SPLITS)).select("suite", F.lit("leaked family").alias("rule"), F.col("family").alias("case_id"))
    empty = suites.select("suite").join(rows.groupBy("suite").agg(*(split(x).alias(x) for x in SPLITS)), "suite", "left")
    empty = empty.where(" or ".join(f"coalesce({x}, 0) = 0" for x in SPLITS)).select("suite", F.lit("empty split").alias("rule"), F.lit(None).cast("string").alias("case_id"))

    e = F.col("expected")
    some = lambda x: F.coalesce(x, F.array().cast(_TEXTS))
    gold, forbidden = some(e["required_evidence"]), some(e["forbidden_evidence"])
    facts = F.coalesce(e["facts"], F.array().cast("array<struct<id:string,pattern:string,evidence:array<string>>>"))
    unsupported = F.exists(facts, lambda f: (F.size(some(f["evidence"])) == 0) | (F.size(F.array_except(some(f["evidence"]), gold)) > 0))
    patterns = F.concat(F.transform(facts, lambda f: f["pattern"]), some(e["clarify_patterns"]), some(e["answer_excludes"]), some(e["refuse_patterns"]))
    # a pattern that an empty text meets asserts nothing
    hollow = F.exists(patterns, lambda p: p.isNull() | (p == "") | F.coalesce(F.regexp_like(F.lit(""), p), F.lit(False)))
    rules: list[tuple[str, Column]] = [
        ("unknown split", ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))), ("no critical flag", F.col("critical").isNull()), ("unknown action", ~F.coalesce(e["action"].isin(*ACTIONS), F.lit(False))),
        ("required and forbidden", F.arrays_overlap(gold, forbidden)), ("repeated fact", F.size(F.array_distinct(F.transform(facts, lambda f: f["id"]))) < F.size(facts)), ("unsupported fact", unsupported),
        ("answer without evidence", (e["action"] == "answer") & ((F.size(gold) == 0) | (F.size(facts) == 0))), ("clarify without pattern", (e["action"] == "clarify") & (F.size(some(e["clarify_patterns"])) == 0)), ("empty pattern", hollow),
    ]
    broken = rows.select("suite", F.col("id").alias("case_id"), F.explode(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules)))).alias("rule"))
    used = rows.select("suite", F.col("id").alias("case_id"), F.explode(F.array_union(gold, forbidden)).alias("of"))
    unknown = used.join(docs.select("suite", F.col("id").alias("of")), ["suite", "of"], "left_anti").select("suite", F.lit("unknown document").alias("rule"), "case_id").distinct()
    found = whole("broken is not null", "no suite").unionByName(whole(f"broken is null and coalesce(schema_version, 0) <> {VERSION}", "unsupported version")).unionByName(whole("broken is null and coalesce(size(documents), 0) <= 0", "no documents"))
    for more in (repeated(docs, "repeated document"), repeated(rows, "repeated case"), leaked, empty, broken.select("suite", "rule", "case_id"), unknown):
        found = found.unionByName(more)
    return found
