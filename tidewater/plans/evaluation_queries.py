"""Registered queries of release evaluation, each with its DuckDB statement. Hits and gold are made from the items' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import evaluation as E
from tidewater.operators import metrics as M
from tidewater.operators import selection as N
from tidewater.plans import adapt as A

Q, SQL = {}, {}


def query(sql: str):
    def register(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_RUN = """hits AS (SELECT item_id AS query_id, item_id * 37 + (r * (3 + item_id % 4)) % 40 AS chunk_id, r AS rank FROM benchmark, (SELECT unnest(range(1, 11)) AS r)),
gold AS (SELECT item_id AS query_id, item_id * 37 + g AS chunk_id FROM benchmark, (SELECT unnest([3, 9, 14]) AS g) WHERE item_id % 4 <> 0 AND (item_id + g) % 3 <> 0),
forbidden AS (SELECT item_id AS query_id, item_id * 37 + 12 AS chunk_id FROM benchmark WHERE item_id % 3 = 0),
top AS (SELECT query_id, chunk_id, min(rank) AS rank FROM hits WHERE rank <= 5 GROUP BY ALL)"""


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queries, hits, gold, forbidden)"""
    items = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    i = F.col("query_id")
    hits = items.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(10)))).select("query_id", (i * 37 + (F.col("rank") * (3 + i % 4)) % 40).alias("chunk_id"), "rank")
    gold = items.withColumn("g", F.explode(F.array(F.lit(3), F.lit(9), F.lit(14)))).where((i % 4 != 0) & ((i + F.col("g")) % 3 != 0)).select("query_id", (i * 37 + F.col("g")).alias("chunk_id"))
    return items, hits, gold, items.where("query_id % 3 = 0").select("query_id", (i * 37 + 12).alias("chunk_id"))


@query(f"""WITH {_RUN}, f AS (SELECT g.query_id, count(*) AS gold_n, count(t.rank) AS found, min(t.rank) AS first FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN top t USING (query_id, chunk_id) GROUP BY g.query_id),
b AS (SELECT query_id, count(*) AS bad FROM top SEMI JOIN forbidden USING (query_id, chunk_id) GROUP BY query_id)
SELECT item_id AS query_id, found / gold_n AS recall, CASE WHEN gold_n IS NOT NULL THEN coalesce(1.0::DOUBLE / first, 0) END AS mrr, found = gold_n AS all_gold, (found > 0)::INT AS hit_rate, coalesce(bad, 0) AS forbidden_hits,
coalesce(found = gold_n, true) AND coalesce(bad, 0) = 0 AS passed FROM benchmark LEFT JOIN f ON f.query_id = item_id LEFT JOIN b ON b.query_id = item_id""")
def release_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, hits, gold, forbidden = _run(spark, sf_dir)
    return E.release_retrieval(hits, gold, forbidden, items, 5)


@query(f"""WITH {_RUN}, n AS (SELECT query_id, count(*) AS n FROM top SEMI JOIN gold USING (query_id, chunk_id) GROUP BY query_id)
SELECT item_id AS query_id, coalesce(n, 0) / 5 AS precision FROM benchmark LEFT JOIN n ON query_id = item_id WHERE item_id % 2 = 1""")
def precision_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, hits, gold, _ = _run(spark, sf_dir)
    return E.fixed_precision(hits, gold, items.where("query_id % 2 = 1"), 5)


@query(f"""WITH {_RUN}, p AS (SELECT DISTINCT query_id, chunk_id // 10 AS parent FROM gold), h AS (SELECT DISTINCT query_id, chunk_id // 10 AS parent, 1 AS hit FROM hits)
SELECT p.query_id, count(hit) / count(*) AS coverage FROM p LEFT JOIN h USING (query_id, parent) GROUP BY p.query_id""")
def parent_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits, gold, _ = _run(spark, sf_dir)
    return E.parent_coverage(hits, gold, F.expr("chunk_id div 10"))


@query(f"""WITH {_RUN}, b AS (SELECT g.query_id, min(h.rank) AS rank FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN hits h USING (query_id, chunk_id) GROUP BY g.query_id)
SELECT count(*) AS queries, avg(coalesce((rank <= 1)::INT, 0)) AS hit_1, avg(coalesce((rank <= 5)::INT, 0)) AS hit_5, avg(coalesce((rank <= 10)::INT, 0)) AS hit_10 FROM b""")
def any_gold_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits, gold, _ = _run(spark, sf_dir)
    return E.any_hit(hits, gold, (1, 5, 10))


_FACTS = """facts AS (SELECT item_id AS query_id, f AS fact_id, CASE f WHEN 0 THEN substr(text, 1, 20) WHEN 1 THEN substr(text, 30, 20) ELSE 'no such text' END AS pattern FROM benchmark, (SELECT unnest([0, 1, 2]) AS f)),
segments AS (SELECT item_id AS query_id, text, item_id % 5 <> 0 AS allowed FROM benchmark UNION ALL SELECT item_id, substr(text, 1, 25), item_id % 10 <> 0 FROM benchmark)"""


@query(f"""WITH {_FACTS}, e AS (SELECT f.query_id, fact_id, coalesce(max(contains(s.text, pattern)::INT), 0) AS covered FROM facts f LEFT JOIN (SELECT * FROM segments WHERE allowed) s USING (query_id) GROUP BY ALL)
SELECT query_id, count(*) AS facts, count(*) FILTER (WHERE covered = 1) AS covered FROM e GROUP BY query_id""")
def context_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    pattern = F.when(F.col("fact_id") == 0, F.substring("text", 1, 20)).when(F.col("fact_id") == 1, F.substring("text", 30, 20)).otherwise("no such text")
    facts = items.withColumn("fact_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("query_id", "fact_id", pattern.alias("pattern"))
    segments = items.select("query_id", "text", (F.col("query_id") % 5 != 0).alias("allowed")).unionByName(items.select("query_id", F.substring("text", 1, 25).alias("text"), (F.col("query_id") % 10 != 0).alias("allowed")))
    return E.fact_coverage(facts, segments)


_SAID = r"""said AS (SELECT conv_id * 100 + turn AS id, role, CASE conv_id % 4 WHEN 0 THEN text || '. Could you tell more?' WHEN 1 THEN 'I cannot do that. ' || text WHEN 2 THEN text ELSE '' END AS answer, conv_id % 3 AS want FROM conversations),
verdicts AS (SELECT id, CASE want WHEN 0 THEN 'clarify' WHEN 1 THEN 'refuse' ELSE 'answer' END AS expected,
  CASE WHEN trim(answer) = '' THEN NULL WHEN regexp_matches(lower(answer), 'cannot|not able|no information') THEN 'refuse' WHEN regexp_matches(lower(answer), 'could you|which|please provide|\?') THEN 'clarify' ELSE 'answer' END AS verdict FROM said)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = A.table(spark, sf_dir, "conversations"), F.col("conv_id") % 4
    answer = F.when(n == 0, F.concat("text", F.lit(". Could you tell more?"))).when(n == 1, F.concat(F.lit("I cannot do that. "), "text")).when(n == 2, F.col("text")).otherwise("")
    expected = F.when(F.col("conv_id") % 3 == 0, "clarify").when(F.col("conv_id") % 3 == 1, "refuse").otherwise("answer")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), expected.alias("expected"), E.behaviour(answer).alias("verdict"))


@query(f"WITH {_SAID} SELECT * FROM verdicts")
def behaviour_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(f"WITH {_SAID} SELECT expected, count(verdict) AS judged, avg((verdict = expected)::INT) AS accuracy FROM verdicts GROUP BY expected")
def behaviour_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy_by(_verdicts(spark, sf_dir), "expected", "verdict")


@query("""WITH r AS (SELECT event_id, event_type, user_id % 5 AS want, (props->>'$.k')::INT % 5 AS got, (props->>'$.k')::INT % 4 = 0 AS multi FROM events)
SELECT event_type, count(*) AS cases, avg((want = got)::INT) AS accuracy, avg(CASE WHEN multi THEN (want = got)::INT END) AS multi_accuracy, count(*) FILTER (WHERE multi) AS multi_cases FROM r GROUP BY event_type""")
def intent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    r = A.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5 == k % 5).cast("int").alias("ok"), (k % 4 == 0).alias("multi"))
    return r.groupBy("event_type").agg(F.count("*").alias("cases"), F.avg("ok").alias("accuracy"), F.avg(F.when(F.col("multi"), F.col("ok"))).alias("multi_accuracy"), F.count_if("multi").alias("multi_cases"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id, round(avg(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-9)), 6) AS relevancy
FROM e a JOIN e b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3 GROUP BY a.vec_id""")
def answer_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of a question and the three that were made from its answer (the vectors after it)."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = e.select("vec_id", F.col("v").alias("q"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("made"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = asked.join(e.select(F.col("vec_id").alias("made"), "v"), "made")
    return pairs.groupBy("vec_id").agg(F.round(F.avg(dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")) + 1e-9)), 6).alias("relevancy"))


@query("""WITH x AS (SELECT conv_id, turn, [conv_id % 5, 7, turn] AS denied, [conv_id % 3, 1] AS a, [turn % 4] AS b, [(conv_id + turn) % 9]  AS c FROM conversations)
SELECT conv_id, turn, len(list_distinct(list_intersect(denied, a || b || c))) AS n_leaked FROM x""")
def leaked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    found = E.leaked(F.array(c % 5, F.lit(7).cast("long"), t), F.array(c % 3, F.lit(1).cast("long")), F.array(t % 4), F.array((c + t) % 9))
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("n_leaked"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN []::BIGINT[] ELSE [user_id % 4, user_id % 7] END AS want, CASE WHEN event_id % 4 = 0 THEN []::BIGINT[] ELSE [event_id % 3, event_id % 7] END AS got FROM events)
SELECT event_id, round(CASE WHEN len(want) = 0 THEN (len(got) = 0)::INT ELSE len(list_intersect(want, got)) / len(list_distinct(want)) END, 9)::DOUBLE AS coverage FROM x""")
def key_text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<bigint>")
    want = F.when(F.col("event_id") % 6 == 0, none).otherwise(F.array(F.col("user_id") % 4, F.col("user_id") % 7))
    got = F.when(F.col("event_id") % 4 == 0, none).otherwise(F.array(F.col("event_id") % 3, F.col("event_id") % 7))
    return A.table(spark, sf_dir, "events").select("event_id", F.round(E.key_coverage(want, got), 9).alias("coverage"))


@query("""WITH x AS (SELECT (props->>'$.k')::INT % 4 = 0 AS unsafe, value > 20 AS before, value > 20 AND (props->>'$.k')::INT % 8 <> 0 AS after FROM events)
SELECT count(*) FILTER (WHERE unsafe AND before) AS unsafe_before, count(*) FILTER (WHERE unsafe AND after) AS unsafe_after, count(*) FILTER (WHERE NOT unsafe AND before) AS safe_before,
count(*) FILTER (WHERE NOT unsafe AND after) AS safe_after, count(*) AS cases FROM x""")
def gate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    before = F.col("value") > 20
    return E.gate_confusion(A.table(spark, sf_dir, "events").select((k % 4 == 0).alias("unsafe"), before.alias("before"), (before & (k % 8 != 0)).alias("after")))


@query("""WITH o AS (SELECT doc_id, lang AS grouped FROM documents WHERE doc_id % 5 <> 0 OR lang <> 'en'),
l AS (SELECT doc_id, max(quality) AS faithful, max(toxic) AS correct FROM labels WHERE doc_id IN (SELECT doc_id FROM o) GROUP BY doc_id),
s AS (SELECT * FROM o WHERE grouped = 'fr' OR doc_id IN (SELECT doc_id FROM l)),
j AS (SELECT s.grouped, s.doc_id AS a, l.doc_id AS b, l.faithful, l.correct FROM s FULL JOIN l ON s.doc_id = l.doc_id),
g AS (SELECT coalesce(grouped, 'none') AS grouped, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS claims, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS errors, sum(faithful) AS f, sum(correct) AS c FROM j GROUP BY ALL)
SELECT grouped, claims, errors, CASE WHEN errors > 0 THEN 0 ELSE f / claims END AS faithful, CASE WHEN errors > 0 THEN 0 ELSE c / claims END AS correct FROM g""")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of claims by language; French ones are observed without a review, which is an error."""
    observed = A.table(spark, sf_dir, "documents").where("doc_id % 5 <> 0 OR lang <> 'en'").select("doc_id", F.col("lang").alias("grouped"))
    reviews = A.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("faithful"), F.max("toxic").alias("correct"))
    reviews = reviews.join(observed, "doc_id", "left_semi")
    known = observed.where("grouped = 'fr'").unionByName(observed.where("grouped <> 'fr'").join(reviews, "doc_id", "left_semi"))
    return E.review_scores(known, reviews, "doc_id")


@query("SELECT event_type, min(value) AS least, quantile_cont(value, 0.25) AS q1, median(value) AS middle, quantile_cont(value, 0.75) AS q3, max(value) AS most FROM events GROUP BY event_type")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"least": ("nearest", 0), "q1": ("linear", 25), "middle": ("linear", 50), "q3": ("linear", 75), "most": ("nearest", 100)}
    return N.percentiles(A.table(spark, sf_dir, "events"), "event_type", "value", kinds).drop("n")


@query("SELECT event_type AS outcome, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.percentiles(A.table(spark, sf_dir, "events"), "event_type", "value", {f"p{p}": ("nearest", p) for p in (50, 95, 99)}).withColumnRenamed("event_type", "outcome")


@query("SELECT lang, quality, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def dataset_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT conv_id, arg_max(length(text), turn) AS n, max(turn) AS last_stage FROM conversations GROUP BY conv_id)
SELECT last_stage, count(*) AS attempts, sum(n)::BIGINT AS parsed FROM a GROUP BY last_stage""")
def attempt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over attempts, of which the last stage counts."""
    last = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.length("text"), "turn").alias("n"), F.max("turn").alias("last_stage"))
    return last.groupBy("last_stage").agg(F.count("*").alias("attempts"), F.sum("n").alias("parsed"))
