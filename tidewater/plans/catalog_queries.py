"""Registered queries of point reads, merges, request checks, jobs and generations, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import catalog as C
from tidewater.operators import lifecycle as L
from tidewater.plans import adapt as A

Q, SQL = {}, {}


def query(sql: str):
    def register(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def chunks_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = A.table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))
    return C.rows_of(A.table(spark, sf_dir, "documents"), ids, "doc_id").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query(f"WITH {A.CHUNKS} SELECT parent_id, chunk_id FROM chunks WHERE parent_id IN (SELECT item_id * 17 FROM benchmark)")
def ids_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = A.table(spark, sf_dir, "benchmark").select((F.col("item_id") * 17).alias("parent_id"))
    return C.rows_of(A.chunks(spark, sf_dir), ids, "parent_id").select("parent_id", "chunk_id")


@query(f"""WITH {A.CHUNKS}, r AS (SELECT * FROM (VALUES ('kb_a', true), ('kb_b', true), ('kb_c', true), ('kb_d', false)) r(collection, readable))
SELECT r.collection, CASE WHEN readable THEN count(c.chunk_id) ELSE -1 END AS n FROM r LEFT JOIN chunks c ON c.collection = r.collection GROUP BY r.collection, readable""")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("kb_a", True), ("kb_b", True), ("kb_c", True), ("kb_d", False)], "collection string, readable boolean")
    return C.listing(registry, A.chunks(spark, sf_dir), "collection")


@query("SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = C.without(A.table(spark, sf_dir, "documents"), A.denied(spark, sf_dir), "doc_id")
    return left.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""WITH {A.CHUNKS} SELECT collection, scenario, count(*) FILTER (WHERE status IS NULL AND chunk_id % 50 = 0) AS failed, count(*) AS chunks,
count(*) FILTER (WHERE status IS NULL AND chunk_id % 50 = 0) = 0 AND count(*) > 0 AS ready FROM chunks GROUP BY ALL""")
def build_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = A.chunks(spark, sf_dir).groupBy("collection", "scenario").agg(F.count_if(F.expr("status IS NULL AND chunk_id % 50 = 0")).alias("failed"), F.count("*").alias("chunks"))
    return built.withColumn("ready", C.ready(F.col("failed"), F.col("chunks")))


@query(f"""WITH {A.MESSAGES}, q AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN (tenant_id + 1) % 3 ELSE tenant_id END AS tenant_id, CASE (id + n) % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS value, n
  FROM messages, (SELECT unnest([1, 2]) AS n) WHERE id % 4 <> 3
), v AS (SELECT q.id, q.value, row_number() OVER (PARTITION BY q.id ORDER BY n DESC) AS k FROM q JOIN messages m ON m.id = q.id AND m.role = 'assistant' AND m.tenant_id = q.tenant_id)
SELECT m.id, CASE WHEN v.id IS NOT NULL THEN v.value ELSE m.feedback END AS feedback FROM messages m LEFT JOIN v ON v.id = m.id AND k = 1""")
def feedback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.messages(spark, sf_dir)
    requests = m.where("id % 4 <> 3").withColumn("at", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "id", F.when(F.col("id") % 5 == 0, (F.col("tenant_id") + 1) % 3).otherwise(F.col("tenant_id")).alias("tenant_id"),
        F.when((F.col("id") + F.col("at")) % 3 == 0, "up").when((F.col("id") + F.col("at")) % 3 == 1, "down").alias("value"), "at",
    )
    return C.feedback_merge(m, requests)


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN CASE WHEN c_custkey IN (SELECT conv_id FROM conversations) THEN 'processing' ELSE 'new' END ELSE 'closed' END AS status FROM customer""")
def status_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    tickets = A.table(spark, sf_dir, "customer").join(some, "c_custkey", "left")
    status = F.when(F.col("c_nationkey") % 2 == 0, "open").otherwise("closed")
    return tickets.select(F.col("c_custkey").alias("id"), C.backfilled(status, F.coalesce("has", F.lit(False))).alias("status"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT conv_id FROM conversations WHERE role = 'user')")
def conversations_with_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = A.table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("id"))
    return C.rows_of(A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), said, "id")


@query("""WITH r AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS action, c.c_nationkey AS nation, c.c_acctbal AS balance,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1 AS known
  FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_custkey % 10 <> 7
), f AS (SELECT id, known, CASE WHEN action IS NULL THEN 'missing_action' WHEN nation IS NULL THEN 'unknown_user' WHEN nation % 5 = 3 THEN 'wrong_tenant' WHEN balance < 0 THEN 'not_allowed' END AS reason FROM r)
SELECT id, reason, CASE WHEN reason IS NOT NULL THEN 'denied:' || reason WHEN known THEN 'existing' ELSE 'pending' END AS outcome FROM f""")
def execution_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = A.table(spark, sf_dir, "customer").where("c_custkey % 10 <> 7").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    known = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")) > 1
    r = A.table(spark, sf_dir, "orders").withColumn("known", known).join(users, "o_custkey", "left")
    reason = C.first_failure(
        (F.col("o_orderkey") % 6 == 0, "missing_action"), (F.col("c_nationkey").isNull(), "unknown_user"), (F.col("c_nationkey") % 5 == 3, "wrong_tenant"), (F.col("c_acctbal") < 0, "not_allowed"),
    )
    return r.select(F.col("o_orderkey").alias("id"), reason.alias("reason"), C.side_effect(reason, F.col("known")).alias("outcome"))


@query("""SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position,
count(*) OVER (PARTITION BY o_custkey) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) QUALIFY position <= 3""")
def config_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's own configurations, the latest first, a page of three with the total before paging."""
    mine = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    rows = C.rows_of(A.table(spark, sf_dir, "orders"), mine, "o_custkey").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return C.page(rows, ["owner"], [F.desc("o_orderdate"), F.desc("id")], 3).select("owner", "id", "position", "total")


_JUDGE = """j AS (SELECT event_id, (props->>'$.k')::INT AS k, CASE WHEN (props->>'$.k')::INT % 7 = 0 THEN ' ' ELSE event_type END AS evidence,
  '{"enough":' || CASE (props->>'$.k')::INT % 4 WHEN 0 THEN '"true"' WHEN 1 THEN 'false' ELSE 'true' END || ',"answerable":' || CASE WHEN (props->>'$.k')::INT % 5 = 0 THEN '1' ELSE 'true' END
  || ',"missing":' || CASE (props->>'$.k')::INT % 3 WHEN 0 THEN '["a","b"]' WHEN 1 THEN '[1]' ELSE '[]' END || CASE WHEN (props->>'$.k')::INT % 11 = 0 THEN '' ELSE '}' END AS judge FROM events)"""


@query(f"""WITH {_JUDGE}, v AS (SELECT *, k % 4 <> 0 AND k % 5 <> 0 AND k % 3 <> 1 AND k % 11 <> 0 AS valid FROM j)
SELECT event_id, valid, valid AND k % 4 <> 1 AND trim(evidence) <> '' AS generate FROM v""")
def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' JSON with every kind of fault: wrong types, cut short, blank evidence."""
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    judge = F.concat(
        F.lit('{"enough":'), pick(4, '"true"', "false", "true", "true"), F.lit(',"answerable":'), F.when(k % 5 == 0, "1").otherwise("true"),
        F.lit(',"missing":'), pick(3, '["a","b"]', "[1]", "[]"), F.when(k % 11 == 0, "").otherwise("}"),
    )
    rows = A.table(spark, sf_dir, "events").select("event_id", F.when(k % 7 == 0, " ").otherwise(F.col("event_type")).alias("evidence"), judge.alias("judge"))
    return rows.select("event_id", C.judge_valid(F.col("judge")).alias("valid"), C.may_generate(F.col("evidence"), F.col("judge")).alias("generate"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(source, 'untitled') WHEN doc_id % 3 = 1 THEN 'T' || doc_id ELSE coalesce(source, 'untitled') END AS label, substr(coalesce(text, ''), 1, 140) AS snippet FROM documents")
def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("T"), "doc_id"))
    label, snippet = C.hit_card(title, F.col("source"), F.col("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), snippet.alias("snippet"))


@query("SELECT event_id AS id, event_type AS status, (props->>'$.k')::INT AS attempts, (props->>'$.stage') AS stage, date_trunc('second', ts) AS updated_at FROM events")
def job_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.from_json("props", "k int, stage string")
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), state["k"].alias("attempts"), state["stage"].alias("stage"), F.date_trunc("second", "ts").alias("updated_at"))


@query(f"""WITH {A.TRACES} SELECT id, CASE node WHEN 'rag_query' THEN CASE WHEN n_sources > 0 THEN 'Found ' || n_sources || ' sources' ELSE 'No sources' END WHEN 'intent' THEN 'Intent recognised'
WHEN 'execute' THEN CASE WHEN k % 2 = 0 THEN 'Action done' ELSE 'Action failed' END WHEN 'verify' THEN 'Result verified' ELSE node END AS label,
CASE WHEN node = 'rag_query' AND n_sources = 0 THEN 'warn' WHEN node = 'execute' THEN CASE WHEN k % 2 = 0 THEN 'good' ELSE 'bad' END ELSE 'info' END AS tone FROM traces""")
def trace_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.traces(spark, sf_dir)
    node, done = F.col("node"), F.col("k") % 2 == 0
    label = (
        F.when(node == "rag_query", F.when(F.col("n_sources") > 0, F.concat(F.lit("Found "), "n_sources", F.lit(" sources"))).otherwise("No sources")).when(node == "intent", "Intent recognised")
        .when(node == "execute", F.when(done, "Action done").otherwise("Action failed")).when(node == "verify", "Result verified").otherwise(node)
    )
    tone = F.when((node == "rag_query") & (F.col("n_sources") == 0), "warn").when(node == "execute", F.when(done, "good").otherwise("bad")).otherwise("info")
    return t.select("id", label.alias("label"), tone.alias("tone"))


@query("SELECT event_type, event_id, position, total FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS position, count(*) OVER (PARTITION BY event_type) AS total FROM events WHERE value > 10) WHERE position <= 20")
def audit_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").where("value > 10").select("event_type", "event_id", "ts")
    return C.page(rows, ["event_type"], [F.desc("ts"), F.desc("event_id")], 20).select("event_type", "event_id", "position", "total")


@query(f"WITH {A.CHUNKS} SELECT collection, count(*) FILTER (WHERE status = 'active' AND NOT denied) AS active_chunks, count(*) FILTER (WHERE status = 'inactive') AS inactive, count(*) FILTER (WHERE status IS NULL) AS unknown, count(*) FILTER (WHERE denied) AS removed FROM chunks GROUP BY collection")
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda text, name: F.count_if(F.expr(text)).alias(name)
    return A.chunks(spark, sf_dir).groupBy("collection").agg(n("status = 'active' AND NOT denied", "active_chunks"), n("status = 'inactive'", "inactive"), n("status IS NULL", "unknown"), n("denied", "removed"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type = 'error' QUALIFY nth <= 3")
def last_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = A.table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", "ts")
    return C.last_of(failed, "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "nth")


@query(f"WITH {A.CHUNKS} SELECT collection, count(*) AS n FROM chunks WHERE collection IN ('kb_a', 'kb_b') GROUP BY collection")
def target_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a joint search reads: kb_a and of its configured extras the one that exists."""
    read = C.targets("kb_a", ["kb_b", "kb_x"], ["kb_a", "kb_b"])
    return A.chunks(spark, sf_dir).where(F.col("collection").isin(read)).groupBy("collection").agg(F.count("*").alias("n"))


@query(f"""WITH {A.CHUNKS}, p AS (SELECT chunk_id AS parent_id, collection, text FROM chunks WHERE chunk_type = 'parent')
SELECT c.chunk_id, sha256(coalesce(o.text, f.text, '')) AS parent_digest, CASE WHEN o.text IS NOT NULL THEN 'own' WHEN f.text IS NOT NULL THEN 'first' ELSE 'none' END AS found_in
FROM chunks c LEFT JOIN p o ON o.parent_id = c.parent_id AND o.collection = c.collection LEFT JOIN p f ON f.parent_id = c.parent_id AND f.collection = 'kb_a' WHERE c.chunk_type = 'child'""")
def parents_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir)
    found = C.parents_of(c.where("chunk_type = 'child'"), c.where("chunk_type = 'parent'"), "kb_a")
    return found.select("chunk_id", F.sha2(F.coalesce("parent_text", F.lit("")), 256).alias("parent_digest"), "found_in")


@query("""WITH s AS (SELECT item_id, mode FROM benchmark, (SELECT unnest(['fast', 'full']) AS mode)), r AS (
  SELECT item_id, mode FROM s WHERE item_id % 7 <> 0 UNION ALL SELECT item_id, mode FROM s WHERE item_id % 5 = 1 AND item_id % 7 <> 0 UNION ALL SELECT item_id + 100000, mode FROM s WHERE item_id % 11 = 0
)
SELECT item_id, mode, 'duplicate' AS error FROM r GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT item_id, mode, 'unexpected' FROM r WHERE item_id >= 100000
UNION ALL SELECT item_id, mode, 'missing' FROM s WHERE item_id % 7 = 0""")
def suite_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = A.table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.lit("fast"), F.lit("full"))).alias("mode"))
    good = suite.where("item_id % 7 <> 0")
    report = good.unionByName(good.where("item_id % 5 = 1")).unionByName(suite.where("item_id % 11 = 0").withColumn("item_id", F.col("item_id") + 100000))
    return C.suite_errors(report, suite, ["item_id", "mode"])


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'write' ELSE 'unregistered' END AS risk FROM events")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame([("view", "read"), ("click", "read"), ("purchase", "write")], "event_type string, risk string")
    return C.registered(A.table(spark, sf_dir, "events").select("event_id", "event_type"), tools, "event_type", "risk").select("event_id", "risk")


@query("""WITH b AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75, 0.99]) AS c FROM documents),
p AS (SELECT doc_id, CASE WHEN n_chars > c[4] THEN 'tail' ELSE ((c[1] < n_chars)::INT + (c[2] < n_chars)::INT + (c[3] < n_chars)::INT)::VARCHAR END AS stratum FROM documents, b)
SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || doc_id), doc_id) AS nth FROM p QUALIFY nth <= CASE WHEN stratum = 'tail' THEN 4 ELSE 15 END""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return C.stratified(docs, "n_chars", "doc_id", 64, 7).select("doc_id", "stratum", "nth")


@query("""SELECT event_id, coalesce(CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'override' END, event_type) AS source, CASE WHEN (props->>'$.k')::INT % 3 = 0 THEN 'v2' ELSE 'v1' END AS version, user_id::VARCHAR AS owner FROM events""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later metadata wins: the defaults, the row's own and an override, as maps."""
    k = F.get_json_object("props", "$.k").cast("int")
    first = F.create_map(F.lit("source"), F.col("event_type"), F.lit("version"), F.lit("v1"), F.lit("owner"), F.col("user_id").cast("string"))
    second = F.when(k % 3 == 0, F.create_map(F.lit("version"), F.lit("v2"))).otherwise(F.create_map(F.lit("version"), F.lit("v1")))
    third = F.when(k % 2 == 0, F.create_map(F.lit("source"), F.lit("override"))).otherwise(F.create_map(F.lit("source"), F.col("event_type")))
    entries = F.concat(*(F.map_entries(x) for x in (third, second, first)))
    get = lambda key: F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"].alias(key)
    return A.table(spark, sf_dir, "events").select("event_id", *map(get, ("source", "version", "owner")))


_GENERATIONS = """g AS (SELECT c_custkey AS id, c_nationkey, c_custkey * 10 AS active_job, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 10 - 1 END AS previous_job, c_custkey % 6 AS desired_seq FROM customer),
j AS (SELECT o_orderkey AS id, o_custkey AS source_id, o_orderkey % 6 AS seq, CASE WHEN o_orderstatus = 'F' THEN 'prepared' ELSE 'running' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE 'p1' END AS profile FROM orders),
latest AS (SELECT source_id, arg_max(id, id) AS id, arg_max(seq, id) AS seq, arg_max(profile, id) AS profile FROM j GROUP BY source_id)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return A.table(spark, sf_dir, "customer").select(
        key.alias("id"), "c_nationkey", (key * 10).alias("active_job"), F.when(key % 3 != 0, key * 10 - 1).alias("previous_job"), (key % 6).alias("desired_seq"),
        F.array(key, key + 1).alias("denied"), F.array(key).alias("restored"),
    )


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return A.table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("source_id"), (key % 6).alias("seq"), F.when(F.col("o_orderstatus") == "F", "prepared").otherwise("running").alias("status"),
        F.when(key % 7 == 0, "old").otherwise("p1").alias("profile"),
    )


def _newest(jobs: DataFrame) -> DataFrame:
    last = F.max_by(F.struct(*jobs.columns), "id").alias("x")
    return jobs.groupBy("source_id").agg(last).select("x.*")


@query(f"""WITH {_GENERATIONS} SELECT g.id AS source_id, CASE WHEN c_nationkey = 4 THEN 'refused' WHEN l.seq = g.desired_seq AND l.profile = 'p1' THEN 'reused' ELSE 'queued' END AS decision,
CASE WHEN c_nationkey <> 4 AND NOT coalesce(l.seq = g.desired_seq AND l.profile = 'p1', false) THEN coalesce(l.id, 0) + 1 ELSE coalesce(l.id, 0) END AS seq FROM g LEFT JOIN latest l ON l.source_id = g.id""")
def job_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("desired_seq").alias("snapshot"), F.lit("p1").alias("profile"), F.when(F.col("c_nationkey") == 4, 0).otherwise(1).alias("files"))
    live = _newest(_jobs(spark, sf_dir)).select("source_id", F.col("seq").alias("snapshot"), "profile", F.col("id").alias("seq"))
    return L.enqueue(requests, live)


_PUBLISHED = f"""WITH {_GENERATIONS}, p AS (SELECT g.*, CASE WHEN l.seq = g.desired_seq AND l.profile = 'p1' AND j.status = 'prepared' THEN l.id END AS new_job
  FROM g LEFT JOIN latest l ON l.source_id = g.id LEFT JOIN j ON j.id = l.id),
q AS (SELECT id, coalesce(new_job, active_job) AS active_job, CASE WHEN new_job IS NOT NULL THEN active_job ELSE previous_job END AS previous_job, desired_seq, CASE WHEN new_job IS NOT NULL THEN 1 ELSE 2 END AS denied FROM p)"""


@query(f"{_PUBLISHED} SELECT * FROM q")
def generation_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.published(_sources(spark, sf_dir), _newest(_jobs(spark, sf_dir)), "p1").withColumn("denied", F.size("denied"))


@query(f"{_PUBLISHED} SELECT id, coalesce(previous_job, active_job) AS active_job, CASE WHEN previous_job IS NOT NULL THEN active_job END AS previous_job, desired_seq + (previous_job IS NOT NULL)::INT AS desired_seq, denied FROM q")
def generation_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = L.published(_sources(spark, sf_dir), _newest(_jobs(spark, sf_dir)), "p1")
    return L.rolled_back(now).withColumn("denied", F.size("denied"))


@query("""WITH p AS (SELECT c_custkey AS id, (c_custkey % 20)::BIGINT AS expected FROM customer) SELECT p.id, coalesce(n, 0) = expected AS served FROM p LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = p.id""")
def active_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointers = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 20).alias("expected"))
    return L.resolved(pointers, A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'parse' WHEN c_custkey % 3 = 0 THEN 'chunk' WHEN c_custkey % 5 = 0 THEN 'embed' WHEN c_custkey % 7 = 0 THEN 'validate' ELSE 'none' END AS scope FROM customer""")
def invalidation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, names = F.col("c_custkey"), {"parser": 2, "chunk": 3, "embedding": 5, "pipeline": 7}
    old = F.struct(*(F.lit(1).alias(x) for x in names))
    new = F.struct(*(F.when(key % n == 0, 2).otherwise(1).alias(x) for x, n in names.items()))
    return A.table(spark, sf_dir, "customer").select(key.alias("id"), L.scope(old, new).alias("scope"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' THEN 'not quarantined' WHEN o_orderkey % 4 = 0 THEN 'pinned' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') < 30 THEN 'too young' ELSE 'eligible' END AS reason FROM orders""")
def purge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "quarantined").otherwise("published")
    age = F.datediff(F.lit("1998-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), L.purgeable(status, F.col("o_orderkey") % 4 == 0, age, 30).alias("reason"))


@query("""WITH d AS (SELECT doc_id, ('0x' || substr(md5('3:' || doc_id), 1, 8))::BIGINT AS a, ('0x' || substr(md5('4:' || doc_id), 1, 8))::BIGINT AS b FROM documents)
SELECT doc_id, CASE b % 4 WHEN 0 THEN 'body' WHEN 1 THEN 'metadata' WHEN 2 THEN 'rename' ELSE 'delete' END AS kind FROM d WHERE a < 429496729""")
def sync_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.mutations(A.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 3)


@query("""WITH w AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE h END AS h FROM w WHERE doc_id % 4 <> 1)
SELECT count(*) FILTER (WHERE w.h = c.h) AS hits, count(*) FILTER (WHERE c.h IS NULL) AS misses, count(*) FILTER (WHERE c.h <> w.h) AS rebuilt FROM w LEFT JOIN c ON w.doc_id = c.doc_id""")
def stage_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = A.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    cache = wanted.where("doc_id % 4 <> 1").withColumn("h", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("h")))
    return L.cache_state(wanted, cache, "doc_id", "h")


@query(f"WITH {A.CHUNKS} SELECT chunk_id, CASE WHEN denied THEN 'denied' ELSE 'expired' END AS reason FROM chunks WHERE denied OR valid_to < {A.TODAY}")
def filter_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads exposed before the deny list and the dates were applied and no longer do."""
    c = A.chunks(spark, sf_dir)
    after = L.served(c, c.where("denied").select("chunk_id"), "chunk_id").where(f"valid_to IS NULL OR valid_to >= {A.TODAY}")
    return C.without(c, after, "chunk_id").select("chunk_id", F.when(F.col("denied"), "denied").otherwise("expired").alias("reason"))


@query(f"WITH {A.CHUNKS} SELECT collection, count(*) AS rows_served, count(embedding) AS vectors_served FROM chunks WHERE NOT denied GROUP BY collection")
def served_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same served rows through metadata and through vectors."""
    seen = L.served(A.chunks(spark, sf_dir), A.denied(spark, sf_dir).select(F.col("doc_id").alias("chunk_id")), "chunk_id")
    return seen.groupBy("collection").agg(F.count("*").alias("rows_served"), F.count("embedding").alias("vectors_served"))


@query("SELECT 0.25::DOUBLE AS delta, count(*) FILTER (WHERE vec_id % 10 = 3) AS alone, count(*) AS compared FROM embeddings")
def restore_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restored copy in which some vectors are moved by 0.25 and some are missing."""
    before = A.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * 64) / 64).alias("v"))
    after = before.where("vec_id % 10 <> 3").withColumn("v", F.transform("v", lambda x: F.when(F.col("vec_id") % 7 == 0, x + 0.25).otherwise(x)))
    return L.vector_delta(before, after, "vec_id", "v")


@query("""WITH c AS (SELECT 'kb/' || (doc_id % 200) AS path, doc_id AS chunk_id, md5(coalesce(text, '')) AS h FROM documents),
t AS (SELECT path, chunk_id, CASE WHEN chunk_id % 301 = 0 THEN 'x' ELSE h END AS h FROM c WHERE chunk_id % 157 <> 5)
SELECT path, CASE WHEN path IN (SELECT path FROM (FROM c EXCEPT FROM t) UNION SELECT path FROM (FROM t EXCEPT FROM c)) THEN 'repair' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT path FROM c)""")
def reconcile_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchanged documents whose chunks in the target are missing or differ are repaired."""
    expected = A.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("kb/"), F.col("doc_id") % 200).alias("path"), F.col("doc_id").alias("chunk_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_hash")
    )
    target = expected.where("chunk_id % 157 <> 5").withColumn("text_hash", F.when(F.col("chunk_id") % 301 == 0, "x").otherwise(F.col("text_hash")))
    return L.repairs(expected.select("path").distinct().withColumn("change", F.lit("unchanged")), expected, target)


@query("SELECT doc_id FROM documents WHERE doc_id % 8 = 3")
def obsolete_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything wanted is verified as written, so what is no longer wanted may go."""
    written = A.table(spark, sf_dir, "documents").select("doc_id")
    return L.obsolete(written, written.where("doc_id % 8 <> 3"), ["doc_id"])


@query("""SELECT event_id, CASE (props->>'$.k')::INT % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 7.0 WHEN 2 THEN 1.5 WHEN 3 THEN 60.0 END AS wait FROM events""")
def retry_after_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 5
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    value = F.element_at(F.array(*map(F.lit, ("250ms", "7", "1.5s", "Sat, 20 Jan 2024 00:01:00 GMT", "soon"))), k + 1)
    return A.table(spark, sf_dir, "events").select("event_id", L.retry_after(value, now).alias("wait"))


@query("""SELECT doc_id, ceil(length(text) / 500.0)::BIGINT AS pieces, true AS covers FROM documents WHERE text <> ''""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 500 characters with their position and digest of the whole; put together in order they are the document again."""
    docs = A.table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("whole"))
    pieces = docs.select("doc_id", "whole", F.posexplode(F.expr("transform(sequence(0, (length(text) - 1) div 500), i -> substring(text, i * 500 + 1, 500))")).alias("pos", "piece"))
    # a group is one document
    back = pieces.groupBy("doc_id", "whole").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda p: p["piece"]), "")
    return back.select("doc_id", F.size("x").cast("long").alias("pieces"), (F.md5(joined.cast("binary")) == F.col("whole")).alias("covers"))
