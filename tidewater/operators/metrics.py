"""Ranking metrics, comparisons, percentiles and answer checks as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Resamples that a task draws from one copy of a group's ratios.
RESAMPLES_AT_ONCE = 10


def ranking(hits: DataFrame, gold: DataFrame, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per query: gold_n, recall@k, first gold rank, mrr, all_gold@max, precision@max and ndcg@max; nulls without gold.

    hits: query_id, chunk_id, rank. A repeated hit counts once, at its best rank.
    """
    last = max(at)
    best = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    found = gold.select("query_id", "chunk_id").distinct()
    size = found.groupBy("query_id").agg(F.count("*").alias("gold_n"))
    joined = found.join(best, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        *(F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in at), F.min("rank").alias("first_rank"),
        F.sum(F.when(F.col("rank") <= last, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("gold_n", F.lit(last)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return size.join(joined, "query_id").select(
        "query_id", "gold_n", *((F.col(f"hit_{k}") / F.col("gold_n")).alias(f"recall_{k}") for k in at), "first_rank",
        F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), (F.col(f"hit_{last}") == F.col("gold_n")).cast("int").alias(f"all_gold_{last}"),
        (F.col(f"hit_{last}") / last).alias(f"precision_{last}"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 9).alias(f"ndcg_{last}"),
    )


def failure_stage(in_vector: Column, in_lexical: Column, in_fused: Column, in_final: Column) -> Column:
    """Where a query's gold was lost; the labels are fixed values."""
    return (
        F.when(in_final, "final_hit").when(in_fused, "lost_at_final_selection").when(in_vector | in_lexical, "lost_before_rrf_candidate_pool")
        .otherwise("not_recalled_by_either_route")
    )


def missing_reason(recalled: Column, fused: Column, limited: Column) -> Column:
    """Where a gold label that is not in the result was lost; the names are fixed values."""
    return F.when(~recalled, "absent_both_candidate_routes").when(~fused, "raw_rrf_top10_truncation").when(~limited, "per_source_limit_after_rrf").otherwise("final_top5_truncation")


def nearest_rank(x: str, percent: int) -> Column:
    """The value at ceil(n * percent / 100) of the sorted values."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {x})")


def linear(x: str, percent: int, least: int = 0) -> Column:
    """Linear interpolation, null for fewer than ``least`` values."""
    return F.when(F.count(x) >= least, F.expr(f"percentile_cont({percent / 100}) WITHIN GROUP (ORDER BY {x})"))


def paired(rows: DataFrame, keys: list[str], by: str, value: str, base: str, other: str) -> DataFrame:
    """keys, base and other's values and their delta; pairs that lack a side are left out."""
    side = lambda name, alias: rows.where(F.col(by) == name).select(*keys, F.col(value).alias(alias))
    return side(base, "base").join(side(other, "other"), keys).withColumn("delta", F.col("other") - F.col("base"))


def outcomes(pairs: DataFrame) -> DataFrame:
    """Improved, tied and regressed pairs."""
    return pairs.agg(F.count_if(F.expr("delta > 0")).alias("improved"), F.count_if(F.expr("delta = 0")).alias("tied"), F.count_if(F.expr("delta < 0")).alias("regressed"))


def _drawn(seed: int, resample: Column, draw: Column) -> Column:
    """A number of 32 bits from the seed, the resample and the draw."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), resample, draw)), 1, 8), 16, 10).cast("long")


def bootstrap(values: DataFrame, value: str, family: str, resamples: int, seed: int) -> DataFrame:
    """Cluster bootstrap of a mean: families are drawn with replacement by a seeded hash; low and high bounds of 95 %.

    Only (family, sum, n) rows take part, once for each resample and draw. The bounds are the means at places 2.5 % and
    97.5 % of the sorted ones, of 4,000 the 100th and the 3,900th.
    """
    families = values.groupBy(family).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    numbered = families.withColumn("i", F.row_number().over(Window.orderBy(family)) - 1)
    count = families.agg(F.count("*").alias("families"))
    spark = values.sparkSession
    draws = spark.range(resamples).withColumnRenamed("id", "resample").crossJoin(F.broadcast(count))
    draws = draws.select("resample", "families", F.explode(F.sequence(F.lit(1).cast("long"), F.col("families"))).alias("draw"))
    draws = draws.withColumn("i", _drawn(seed, F.col("resample"), F.col("draw")) % F.col("families"))
    means = draws.join(F.broadcast(numbered), "i").groupBy("resample").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return means.agg(nearest_rank("mean", 2.5).alias("low"), nearest_rank("mean", 97.5).alias("high"))


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """case_id and change: newly failed or fixed."""
    failed = lambda x: x.where("not passed").select("case_id")
    return (
        failed(current).join(failed(baseline), "case_id", "left_anti").withColumn("change", F.lit("newly_failed"))
        .unionByName(failed(baseline).join(failed(current), "case_id", "left_anti").withColumn("change", F.lit("fixed")))
    )


def ratio_bounds(ratios: DataFrame, group: str, key: str, ratio: str, resamples: int = 2000, seed: int = 1749, least: int = 3) -> DataFrame:
    """Per group: pairs, the median ratio and 95 % bounds of the medians of resamples drawn by a seeded hash.

    Bounds are null for fewer than ``least`` pairs. A group's ratios, in the order of their keys, travel once for each
    RESAMPLES_AT_ONCE resamples; draws are never shuffled. A task holds the ratios and draws of that many resamples of one group.
    """
    spark = ratios.sparkSession
    r = F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(ratio).alias("r")))), lambda x: x["r"])
    sizes = ratios.where(F.col(ratio).isNotNull()).groupBy(group).agg(F.count("*").alias("pairs"), linear(ratio, 50).alias("ratio"), r.alias("r"))
    # few bytes, much work: the resamples are spread whatever their size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    asked = sizes.where(F.col("pairs") >= least).select(group, "pairs", "r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(RESAMPLES_AT_ONCE))).alias("first")).repartition(parts, group, "first")
    each = F.sequence(F.col("first"), F.least(F.col("first") + RESAMPLES_AT_ONCE, F.lit(resamples)) - 1)
    draws = F.sequence(F.lit(1).cast("long"), F.col("pairs"))
    drawn = F.transform(each, lambda resample: F.sort_array(F.transform(draws, lambda draw: F.get("r", _drawn(seed, resample, draw) % F.col("pairs")))))
    low, high = F.floor((F.col("pairs") - 1) / 2), F.floor(F.col("pairs") / 2)
    middle = F.transform(drawn, lambda x: F.get(x, low) * 0.5 + F.get(x, high) * 0.5)
    bounds = asked.select(group, F.explode(middle).alias("m")).groupBy(group).agg(nearest_rank("m", 2.5).alias("low"), nearest_rank("m", 97.5).alias("high"))
    return sizes.drop("r").join(bounds, group, "left")
