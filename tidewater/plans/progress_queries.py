"""Registered query of the request state machine over a finished table, with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.plans import adapt as A
from tidewater.streaming import requests as R

Q, SQL = {}, {}

_REQUESTS = f"""WITH {A.TRACES}, e AS (
  SELECT conversation_id, id, node, k, elapsed_ms, CASE node WHEN 'close' THEN 'done' WHEN 'execute' THEN 'error' ELSE 'node' END AS event FROM traces
), r AS (
  SELECT *, coalesce(count(*) FILTER (WHERE event <> 'node') OVER (PARTITION BY conversation_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM e
)"""


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces as events of requests: a terminal node ends a conversation's request, the next one begins another."""
    event = F.when(F.col("node") == "close", "done").when(F.col("node") == "execute", "error").otherwise("node")
    traces = A.traces(spark, sf_dir).withColumn("event", event)
    before = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.coalesce(F.count_if(F.col("event") != "node").over(before), F.lit(0))
    status = F.when(F.col("k") % 3 == 0, F.concat(F.lit("s"), F.col("k").cast("string")))
    intent = F.when(F.col("node") == "intent", F.concat(F.lit("i"), F.col("k").cast("string")))
    return traces.select(
        (F.col("conversation_id") * 1_000_000 + nth).alias("request_id"), F.col("id").alias("seq"), F.col("at").cast("timestamp").alias("at"), "event", "node",
        intent.alias("intent"), status.alias("status"), F.col("elapsed_ms").cast("double").alias("elapsed_ms"),
    )


def request_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's last state: steps, nodes, overwritten fields, and how it ended."""
    return R.outcomes(request_events(spark, sf_dir)).withColumn("elapsed_ms", F.round("elapsed_ms", 6))


Q["request_progress"] = request_progress
SQL["request_progress"] = f"""{_REQUESTS}
SELECT conversation_id * 1000000 + nth AS request_id, max(id) AS seq, CASE arg_max(event, id) WHEN 'node' THEN 'open' ELSE arg_max(event, id) END AS event, count(*) AS steps,
  string_agg(node, ',' ORDER BY id) AS nodes, arg_max('i' || k, id) FILTER (WHERE node = 'intent' AND k IS NOT NULL) AS intent, arg_max('s' || k, id) FILTER (WHERE k % 3 = 0) AS status,
  round(coalesce(sum(elapsed_ms), 0), 6) AS elapsed_ms FROM r GROUP BY conversation_id, nth"""
