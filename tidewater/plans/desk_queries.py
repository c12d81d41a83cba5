"""Registered service-desk queries, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import decisions as D
from tidewater.operators import metrics as M
from tidewater.operators import selection as N
from tidewater.operators import service_desk as S
from tidewater.plans import adapt as A

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {A.MESSAGES} SELECT tenant_id, count(*) AS total, count(*) FILTER (WHERE feedback = 'up') AS up, count(*) FILTER (WHERE feedback = 'down') AS down,
count(*) FILTER (WHERE feedback IS NULL) AS unrated, round(count(*) FILTER (WHERE feedback = 'down') / count(feedback), 3) AS down_rate FROM messages GROUP BY tenant_id""")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feedback_summary(A.messages(spark, sf_dir), "tenant_id")


_ASOF = f"""WITH {A.TRACES}, m AS (SELECT event_id AS id, user_id AS conversation_id, ts AS at FROM events WHERE event_type = 'signup'),
j AS (SELECT m.id, m.conversation_id, max(t.id) AS trace_id FROM m LEFT JOIN traces t ON t.conversation_id = m.conversation_id AND t.node = 'rag_query' AND t.at <= m.at GROUP BY ALL),
r AS (SELECT j.*, t.n_sources FROM j LEFT JOIN traces t ON t.id = j.trace_id)"""
_CATEGORY = "CASE WHEN trace_id IS NULL THEN 'other' WHEN coalesce(n_sources, 0) = 0 THEN 'missing' ELSE 'stale' END"


def _classified(spark, sf_dir):
    asked = A.table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation_id"), F.col("ts").alias("at"))
    found = S.last_trace_before(asked, A.traces(spark, sf_dir), "rag_query")
    return found.withColumn("category", S.feedback_category(F.col("trace_id"), F.col("n_sources")))


@query(_ASOF + f" SELECT id, conversation_id, trace_id, n_sources, {_CATEGORY} AS category FROM r")
def feedback_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("id", "conversation_id", "trace_id", "n_sources", "category")


@query(_ASOF + f" SELECT {_CATEGORY} AS category, count(*) AS n FROM r GROUP BY ALL")
def feedback_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, user_id, event_type AS action, props AS detail FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.col("props").alias("detail"))
    return S.page(rows, 50, 100)


@query("SELECT user_id % 3 AS tenant_id, event_type AS action, count(*) AS n FROM events GROUP BY ALL")
def audit_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("tenant_id"), F.col("event_type").alias("action")).agg(F.count("*").alias("n"))


@query(f"""WITH {A.CHUNKS} SELECT collection, count(*) AS docs, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'inactive') AS inactive,
count(*) FILTER (WHERE status IS NULL) AS unlabelled, count(*) FILTER (WHERE denied) AS denied, max(valid_to) AS latest FROM chunks GROUP BY collection""")
def kb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chunks(spark, sf_dir).groupBy("collection").agg(
        F.count("*").alias("docs"), F.count_if(F.expr("status = 'active'")).alias("active"), F.count_if(F.expr("status = 'inactive'")).alias("inactive"),
        F.count_if(F.expr("status IS NULL")).alias("unlabelled"), F.count_if(F.expr("denied")).alias("denied"), F.max("valid_to").alias("latest"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE datediff('day', DATE '2024-01-01', DATE '2024-01-01' + (doc_id % 90)::INT - 20) END::INT AS expiring_days,
coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 90) - 20 END <= 30, false) AS alert FROM documents""")
def expiring_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = A.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, "soon").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90 - 20).cast("int")), "yyyy-MM-dd")).alias("valid_to")
    )
    return S.expiring(ledger, "2024-01-01").select("doc_id", "expiring_days", "alert")


def _turns(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), ((kind == "error") & (F.col("event_id") % 11 == 0)).alias("human"), (kind == "purchase").alias("closed"),
        kind.isin("view", "click").alias("message"), (kind == "signup").alias("reopened"),
    )


@query(f"""WITH RECURSIVE t AS (
  SELECT user_id AS conversation_id, event_id AS seq, event_type = 'error' AND event_id % 11 = 0 AS human, event_type = 'purchase' AS closed, event_type IN ('view', 'click') AS message,
    event_type = 'signup' AS reopened, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), legal(f, t) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in S.TRANSITIONS)}),
f AS (
  SELECT conversation_id, 0::BIGINT AS n, NULL::BIGINT AS seq, 'new' AS before, 'new' AS status FROM t WHERE n = 1 UNION ALL
  SELECT t.conversation_id, t.n, t.seq, f.status, coalesce((SELECT l.t FROM legal l WHERE l.f = f.status AND l.t = CASE WHEN human THEN 'handoff' WHEN closed THEN 'resolved' WHEN message AND f.status = 'new' THEN 'processing' WHEN reopened THEN 'processing' END), f.status)
  FROM f JOIN t ON t.conversation_id = f.conversation_id AND t.n = f.n + 1
) SELECT conversation_id, seq, before AS from_status, status AS to_status FROM f WHERE before <> status""")
def ticket_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ticket_log(_turns(spark, sf_dir))


@query(f"""WITH l AS (SELECT user_id AS conversation_id, event_id AS seq, lag(kind, 1, 'new') OVER w AS from_status, kind AS to_status FROM
 (SELECT *, CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'resolved' ELSE 'handoff' END AS kind FROM events WHERE event_type IN ('view', 'purchase', 'error')) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT conversation_id, seq, from_status, to_status, 'not allowed' AS reason FROM l WHERE (from_status, to_status) NOT IN ({", ".join(f"('{a}', '{b}')" for a, b in S.TRANSITIONS)})""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "resolved").otherwise("handoff")
    e = A.table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase', 'error')").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), kind.alias("to_status"))
    log = e.withColumn("from_status", F.lag("to_status", 1, "new").over(Window.partitionBy("conversation_id").orderBy("seq")))
    return S.illegal_changes(log).select("conversation_id", "seq", "from_status", "to_status", "reason")


@query("""SELECT conv_id AS conversation_id, arg_max(text, turn) FILTER (WHERE role = 'user' AND text <> '') AS last_question, max(turn) AS last_seq, count(*) AS messages FROM conversations GROUP BY conv_id""")
def state_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations").withColumn("question", F.when(F.col("role") == "user", F.col("text")))
    state = S.carried_state(c, "conv_id", "turn", ["question"])
    size = c.groupBy("conv_id").agg(F.max("turn").alias("last_seq"), F.count("*").alias("messages"))
    return state.join(size, "conv_id").select(F.col("conv_id").alias("conversation_id"), F.col("question").alias("last_question"), "last_seq", "messages")


_REQUESTS = """, r AS (SELECT id, conversation_id, k AS request_id, node AS fingerprint, CASE WHEN n_sources = 0 THEN 'pending' ELSE 'done' END AS status, row_number() OVER (PARTITION BY conversation_id, k ORDER BY id) AS n FROM traces)"""


@query(f"""WITH {A.TRACES}{_REQUESTS} SELECT a.id, CASE WHEN a.n = 1 THEN 'new' WHEN b.fingerprint <> a.fingerprint THEN 'conflict' WHEN b.status = 'pending' THEN 'unconfirmed' ELSE 'replay' END AS decision
FROM r a LEFT JOIN r b ON a.n > 1 AND a.conversation_id = b.conversation_id AND a.request_id = b.request_id AND b.n = 1""")
def request_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.traces(spark, sf_dir).select("id", "conversation_id", F.lit(0).alias("actor_id"), F.col("k").alias("request_id"), F.col("node").alias("fingerprint"), F.when(F.col("n_sources") == 0, "pending").otherwise("done").alias("status"))
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("conversation_id", "request_id").orderBy("id")))
    later = S.request_decision(t.where("n > 1").drop("status"), t.where("n = 1")).select("id", "decision")
    return t.where("n = 1").select("id", F.lit("new").alias("decision")).unionByName(later)


@query("""WITH s AS (SELECT conv_id, count(*) AS stored FROM conversations WHERE turn < 3 GROUP BY conv_id), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
SELECT n.conv_id, n.turn, n.role FROM n LEFT JOIN s USING (conv_id) WHERE nth > coalesce(stored, 0)""")
def new_turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    return S.new_rows(c, c.where("turn < 3"), "conv_id", "turn").select("conv_id", "turn", "role")


@query(f"""WITH {A.TRACES} SELECT id, conversation_id, node, CASE WHEN k % 2 = 0 THEN elapsed_ms ELSE (epoch_us("at") - lag(epoch_us("at")) OVER (PARTITION BY conversation_id ORDER BY "at", id)) / 1000 END::DOUBLE AS step_ms FROM traces""")
def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.traces(spark, sf_dir).withColumn("elapsed_ms", F.when(F.col("k") % 2 == 0, F.col("elapsed_ms")))
    return S.step_times(t).select("id", "conversation_id", "node", "step_ms")


@query(f"""WITH {A.TRACES} SELECT node, count(*) AS n, quantile_disc(elapsed_ms, 0.5) AS p50, quantile_disc(elapsed_ms, 0.95) AS p95, quantile_disc(elapsed_ms, 0.99) AS p99,
CASE WHEN count(*) >= 200 THEN round(quantile_cont(elapsed_ms, 0.95), 6) END AS linear_p95, round(median(elapsed_ms), 6) AS median,
round(list_sort(list(elapsed_ms))[(floor((count(*) - 1) * 0.9))::INT + 1], 2) AS floor_p90 FROM traces WHERE elapsed_ms IS NOT NULL GROUP BY node""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"p50": ("nearest", 50), "p95": ("nearest", 95), "p99": ("nearest", 99), "linear_p95": ("linear", 95), "median": ("linear", 50), "floor_p90": ("floor", 90)}
    found = N.percentiles(A.traces(spark, sf_dir), "node", "elapsed_ms", kinds)
    enough = F.when(F.col("n") >= 200, F.round("linear_p95", 6))
    return found.select("node", "n", "p50", "p95", "p99", enough.alias("linear_p95"), F.round("median", 6).alias("median"), F.round("floor_p90", 2).alias("floor_p90"))


@query("""WITH s AS (SELECT user_id, epoch_ms(ts) AS a, epoch_ms(ts) + 3600000 AS b FROM events), e AS (SELECT user_id, a AS at, 1 AS d FROM s UNION ALL SELECT user_id, b, -1 FROM s),
r AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY "at", d ROWS UNBOUNDED PRECEDING) AS open FROM e) SELECT user_id, max(open)::BIGINT AS peak FROM r GROUP BY user_id""")
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return S.peak_concurrency(A.table(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + 3600000).alias("end")), "user_id")


@query(f"""WITH {A.TRACES} SELECT conversation_id, arg_max(node, id) AS last_node, count(*) AS steps, round(sum(elapsed_ms), 6) AS elapsed_ms FROM traces GROUP BY conversation_id""")
def conversation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.traces(spark, sf_dir).groupBy("conversation_id").agg(F.max_by("node", "id").alias("last_node"), F.count("*").alias("steps"), F.round(F.sum("elapsed_ms"), 6).alias("elapsed_ms"))


@query(f"""WITH {A.TRACES} SELECT id, CASE WHEN node = 'execute' AND k % 5 = 0 THEN 'handoff' WHEN k % 7 = 0 THEN 'multi' WHEN k % 3 = 0 THEN 'greeting' WHEN k % 3 = 1 THEN 'rag_query' WHEN k % 2 = 0 THEN 'check' ELSE 'rag_query' END AS route FROM traces""")
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    request = F.when(k % 3 == 0, "other").when(k % 3 == 1, "consult").otherwise("troubleshoot")
    return A.traces(spark, sf_dir).select("id", D.route((F.col("node") == "execute") & (k % 5 == 0), k % 7 == 0, request, F.when(k % 2 == 0, "active").otherwise("coming")).alias("route"))


@query(f"""WITH {A.TRACES}, c AS (SELECT id, CASE k % 3 WHEN 0 THEN '800' WHEN 1 THEN '720' ELSE '619' END AS code, k % 2 = 0 AS expired FROM traces),
rules(code, expired, action, risk) AS (VALUES ('800', true, 'vpn.renew_certificate', 'low'), ('800', false, 'vpn.check_client_config', 'low'), ('720', true, 'vpn.rebuild_connection', 'medium'))
SELECT c.id, r.action, r.risk, CASE WHEN r.risk = 'low' THEN 'auto' ELSE 'human' END AS execution FROM c LEFT JOIN rules r ON r.code = c.code AND r.expired = c.expired""")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    cases = A.traces(spark, sf_dir).select("id", F.lit("vpn").alias("scenario"), F.when(k % 3 == 0, "800").when(k % 3 == 1, "720").otherwise("619").alias("error_code"), (k % 2 == 0).alias("cert_expired"))
    found = D.solved(cases, D.rules(spark))
    return found.select("id", "action", "risk", D.execution(F.col("action").isNotNull(), F.col("risk")).alias("execution"))


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN ['m2', 'm3', 'm1'] WHEN event_type = 'click' THEN ['m3', 'm1'] WHEN event_type = 'view' THEN ['m1', 'm2', 'm3'] ELSE ['m1', 'm3'] END AS models FROM events""")
def model_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    cursor = F.when(kind == "error", "m2").when(kind == "click", "m3").otherwise("m1")
    none = F.array().cast("array<string>")
    blocked = F.when(kind.isin("error"), none).when(kind == "view", F.array(F.lit("m1"), F.lit("m2"), F.lit("m3"))).otherwise(F.array(F.lit("m2")))
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), D.model_order(F.array(F.lit("m1"), F.lit("m2"), F.lit("m3")), cursor, blocked).alias("models"))


@query("""WITH b AS (SELECT conv_id AS case_id, min(turn) = 0 AND count(*) >= 4 AS passed FROM conversations GROUP BY conv_id), c AS (SELECT conv_id AS case_id, count(*) FILTER (WHERE role = 'assistant') >= 2 AS passed FROM conversations GROUP BY conv_id)
SELECT case_id, CASE WHEN b.passed THEN 'newly_failed' ELSE 'fixed' END AS change FROM b JOIN c USING (case_id) WHERE b.passed <> c.passed""")
def regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id"))
    base = c.agg(((F.min("turn") == 0) & (F.count("*") >= 4)).alias("passed"))
    return M.regressions(base, c.agg((F.count_if(F.expr("role = 'assistant'")) >= 2).alias("passed")))


@query("""SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS agree_good, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS false_accept, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS false_reject, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS agree_bad FROM labels""")
def calibration_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda q, t, n: F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(n)
    return A.table(spark, sf_dir, "labels").agg(cell(1, 0, "agree_good"), cell(1, 1, "false_accept"), cell(0, 0, "false_reject"), cell(0, 1, "agree_bad"))


@query("""SELECT role, count(*) AS total, count(*) FILTER (WHERE length(text) > 40) AS passed, coalesce(list_sort(list(conv_id) FILTER (WHERE length(text) <= 40 AND turn = 0)), []) AS failed FROM conversations GROUP BY role""")
def release_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("total"), F.count_if(F.expr("length(text) > 40")).alias("passed"), F.sort_array(F.collect_list(F.when((F.length("text") <= 40) & (F.col("turn") == 0), F.col("conv_id")))).alias("failed")
    )
