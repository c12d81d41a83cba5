"""Point reads, deletes and merges by key, catalog listings, request checks and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_of(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with one of these keys."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The table after a delete by key; rows whose key is null stay."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def listing(registry: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """name and n of each registered collection (name, readable); -1 where it cannot be read."""
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    return registry.join(counts, name, "left").select(name, F.when(F.col("readable"), F.coalesce("n", F.lit(0))).otherwise(-1).cast("long").alias("n"))


def ready(failed: Column, count: Column) -> Column:
    """A build may be served if nothing failed and something is there."""
    return (failed == 0) & (count > 0)


def feedback_merge(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """id and feedback after the requests (id, tenant_id, value, at): the last valid one sets, overwrites or (null) clears.

    A request is valid for an assistant's message of the same tenant.
    """
    owners = messages.where("role = 'assistant'").select("id", F.col("tenant_id").alias("owner"))
    valid = requests.join(owners, "id").where("tenant_id = owner")
    last = valid.groupBy("id").agg(F.max_by(F.struct("value"), "at").alias("last"))
    return messages.join(last, "id", "left").select("id", F.when(F.col("last").isNotNull(), F.col("last.value")).otherwise(F.col("feedback")).alias("feedback"))


def backfilled(status: Column, has_messages: Column) -> Column:
    """The old state 'open' becomes 'processing' with messages and 'new' without."""
    return F.when(status == "open", F.when(has_messages, "processing").otherwise("new")).otherwise(status)


def first_failure(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds, else null; a null condition does not hold."""
    found = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        found = F.when(condition, name).otherwise(found)
    return found


def side_effect(reason: Column, known: Column) -> Column:
    """What the ledger of side effects records: a refusal, the earlier outcome of the same key, or a new pending entry."""
    return F.when(reason.isNotNull(), F.concat(F.lit("denied:"), reason)).when(known, "existing").otherwise("pending")


def page(rows: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """The first rows of each group with their position and the group's total before paging."""
    totals = rows.groupBy(*group).agg(F.count("*").alias("total"))
    cut = rows.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= size)
    return cut.join(totals, group)


def judge_valid(judge: Column) -> Column:
    """Strict check of a judge's JSON: booleans ``enough`` and ``answerable``, a list of strings ``missing``; others are invalid."""
    v = F.try_parse_json(judge)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    listed = F.coalesce(kind("$.missing").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    return F.coalesce((kind("$.enough") == "BOOLEAN") & (kind("$.answerable") == "BOOLEAN"), F.lit(False)) & listed


def may_generate(evidence: Column, judge: Column) -> Column:
    """Evidence that is not blank and a valid judge that calls it enough and answerable."""
    says = lambda path: F.coalesce(F.try_variant_get(F.try_parse_json(judge), path, "boolean"), F.lit(False))
    return (F.trim(F.coalesce(evidence, F.lit(""))) != "") & judge_valid(judge) & says("$.enough") & says("$.answerable")


def hit_card(title: Column, source: Column, text: Column) -> tuple[Column, Column]:
    """(label, snippet) that a hit shows."""
    return F.coalesce(F.nullif(title, F.lit("")), source, F.lit("untitled")), F.substring(F.coalesce(text, F.lit("")), 1, 140)


def targets(active: str, configured: list[str], existing: list[str], joint: bool = True, git: bool = False) -> list[str]:
    """Collections that a search reads: the active one, and jointly the configured extras that exist; a git source reads the active one alone."""
    return [active, *(x for x in configured if joint and not git and x in existing and x != active)]


def parents_of(children: DataFrame, parents: DataFrame, first: str) -> DataFrame:
    """chunk_id, parent text and where it came from: the child's own collection, else the first store."""
    p = parents.select(F.col("chunk_id").alias("parent_id"), F.col("collection").alias("source_collection"), F.col("text").alias("parent_text"))
    own = children.select("chunk_id", "parent_id", F.col("collection").alias("source_collection")).join(p, ["parent_id", "source_collection"], "left")
    fallback = p.where(F.col("source_collection") == first).select("parent_id", F.col("parent_text").alias("first_text"))
    return own.join(fallback, "parent_id", "left").select(
        "chunk_id", F.coalesce("parent_text", "first_text").alias("parent_text"),
        F.when(F.col("parent_text").isNotNull(), "own").when(F.col("first_text").isNotNull(), "first").otherwise("none").alias("found_in"),
    )


def suite_errors(report: DataFrame, suite: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a report that are twice or not in its suite, and rows of the suite that it lacks."""
    twice = report.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("duplicate").alias("error"))
    extra = report.select(*key).distinct().join(suite.select(*key), key, "left_anti").withColumn("error", F.lit("unexpected"))
    lack = suite.select(*key).join(report.select(*key), key, "left_anti").withColumn("error", F.lit("missing"))
    return twice.unionByName(extra).unionByName(lack)


def registered(rows: DataFrame, registry: DataFrame, key: str, value: str, default: str = "unregistered") -> DataFrame:
    """The rows with the registry's value for their key, or the default."""
    return rows.join(registry.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def last_of(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group, 1 being the latest."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= n)


def stratified(rows: DataFrame, size: str, key: str, n: int, seed: int, strata: int = 4) -> DataFrame:
    """About n rows: a sixteenth of them from the longest hundredth, the rest dealt evenly to the strata of length by a seeded hash.

    Bounds come from one aggregate, so no window holds the whole table.
    """
    cuts = [i / strata for i in range(1, strata)] + [0.99]
    bounds = rows.agg(F.percentile(size, cuts).alias("cuts"))
    placed = rows.crossJoin(F.broadcast(bounds)).withColumn("stratum", F.when(F.col(size) > F.get("cuts", F.lit(strata - 1)), "tail").otherwise(F.size(F.filter(F.slice("cuts", 1, strata - 1), lambda c: c < F.col(size))).cast("string")))
    quota = F.when(F.col("stratum") == "tail", max(1, n // 16)).otherwise((n - max(1, n // 16)) // strata)
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key))
    return placed.withColumn("nth", nth).where(F.col("nth") <= quota).drop("cuts")
