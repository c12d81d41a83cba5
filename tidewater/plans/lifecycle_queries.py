"""Registered lifecycle queries, each with its DuckDB statement. The driver's tables stand for versions, jobs and backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import lifecycle as L
from tidewater.plans import adapt as A

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


NOW = "2024-01-20 00:00:00"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the knowledge base as (doc_id, revision): some documents come, go or change."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = d.where("doc_id % 7 <> 1").select("doc_id", F.sha2("text", 256).alias("revision"))
    new = d.where("doc_id % 11 <> 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("revision"))
    return old, new


_VERSIONS = """v AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
old AS (SELECT doc_id, sha256(text) AS revision FROM v WHERE doc_id % 7 <> 1),
new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS revision FROM v WHERE doc_id % 11 <> 2)"""


@query(f"""WITH {_VERSIONS}, ledger AS (SELECT doc_id, revision, CASE WHEN doc_id % 9 = 0 THEN 'removed' ELSE 'active' END AS status FROM old)
SELECT 'kb/' || coalesce(n.doc_id, l.doc_id) AS path, CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN n.doc_id % 13 = 4 THEN 'failed' WHEN l.doc_id IS NULL OR l.status = 'removed' THEN 'added'
WHEN l.revision <> n.revision THEN 'updated' ELSE 'unchanged' END AS change FROM new n FULL JOIN ledger l ON n.doc_id = l.doc_id WHERE n.doc_id IS NOT NULL OR l.status <> 'removed'""")
def reconcile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    path = F.concat(F.lit("kb/"), "doc_id").alias("path")
    status = F.when(F.col("doc_id") % 9 == 0, "removed").otherwise("active").alias("status")
    readable = new.where("doc_id % 13 <> 4").select(path, F.col("revision").alias("doc_hash"))
    return L.reconcile(readable, new.select(path), old.select(path, F.col("revision").alias("doc_hash"), status))


@query(f"WITH {_VERSIONS} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.revision <> n.revision THEN 'updated' ELSE 'skipped' END AS change FROM new n FULL JOIN old o ON n.doc_id = o.doc_id")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return L.manifest_diff(new, old)


@query(f"WITH {_VERSIONS} SELECT doc_id, revision, 'missing' AS side FROM (FROM new EXCEPT ALL FROM old) UNION ALL SELECT doc_id, revision, 'unexpected' FROM (FROM old EXCEPT ALL FROM new)")
def generation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return L.differences(new, old)


@query(f"WITH {_VERSIONS} SELECT doc_id, revision FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL FROM new")
def generation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return L.upserted(old, new, "doc_id")


@query(f"WITH {_VERSIONS} SELECT DISTINCT revision FROM new WHERE revision NOT IN (SELECT revision FROM old)")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return L.cache_misses(new.select("revision"), old, "revision")


@query("""WITH g AS (SELECT source, list(DISTINCT doc_id) AS known, list(DISTINCT doc_id) FILTER (WHERE doc_id % 3 <> 0) AS active, list(DISTINCT doc_id) FILTER (WHERE doc_id % 9 = 0) AS restored FROM documents GROUP BY source),
d AS (SELECT source, unnest(known) AS doc_id, coalesce(active, []) AS active, coalesce(restored, []) AS restored FROM g)
SELECT source, count(*) FILTER (WHERE NOT list_contains(active, doc_id) AND NOT list_contains(restored, doc_id)) AS n, coalesce(sum(doc_id) FILTER (WHERE NOT list_contains(active, doc_id) AND NOT list_contains(restored, doc_id)), 0)::BIGINT AS total FROM d GROUP BY source""")
def deny_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, by = A.table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"]
    denied = L.deny_changes(d, d.where("doc_id % 3 <> 0"), d.where("doc_id % 9 = 0"), d.where("false"), by)
    sums = denied.groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))
    return d.select("source").distinct().join(sums, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Generation jobs from events: a source for each user, numbered by event; and the sources with their pointers."""
    e = A.table(spark, sf_dir, "events")
    status = F.element_at(F.array(*(F.lit(x) for x in _STATES)), (F.col("event_id") % len(_STATES) + 1).cast("int"))
    jobs = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), status.alias("status"), (F.col("event_id") % 5).alias("attempts"), (F.col("event_id") % 3).cast("int").alias("fence"),
        F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("lease_until"), F.when(F.col("event_id") % 6 != 0, F.col("ts")).alias("next_attempt_at"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    sources = e.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("desired_seq"), F.min("event_id").alias("active_job"), F.max(F.when(F.col("event_id") % 2 == 0, F.col("event_id"))).alias("previous_job"))
    return jobs, sources


_STATES = ("queued", "running", "prepared", "published", "failed", "superseded", "quarantined", "odd")
_JOBS = f"""jobs AS (SELECT event_id AS id, user_id AS source_id, event_id AS seq, [{', '.join(map(repr, _STATES))}][event_id % {len(_STATES)} + 1] AS status, event_id % 5 AS attempts, (event_id % 3)::INT AS fence,
CASE WHEN event_id % 4 <> 0 THEN ts END AS lease_until, CASE WHEN event_id % 6 <> 0 THEN ts END AS next_attempt_at, ts AS created_at, ts AS updated_at FROM events),
sources AS (SELECT user_id AS id, max(event_id) AS desired_seq, min(event_id) AS active_job, max(event_id) FILTER (WHERE event_id % 2 = 0) AS previous_job FROM events GROUP BY user_id)"""


@query(f"""WITH {_JOBS}, r AS (SELECT j.id, j.status, [CASE WHEN EXISTS (FROM sources s WHERE j.id IN (s.active_job, s.previous_job)) THEN 'active_or_rollback' END,
CASE WHEN EXISTS (FROM sources s WHERE s.id = j.source_id AND s.desired_seq = j.seq) THEN 'latest_source_intent' END, CASE WHEN j.status IN ('queued', 'running', 'prepared') THEN 'pending_task' END,
CASE WHEN j.status = 'odd' THEN 'unknown_status' END, CASE WHEN j.updated_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'safety_window' END] AS every FROM jobs j)
SELECT id, status, array_to_string(list_filter(every, lambda x: x IS NOT NULL), ',') AS reasons, len(list_filter(every, lambda x: x IS NOT NULL)) = 0 AND status IN ('published', 'failed', 'superseded') AS candidate FROM r""")
def retention_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, sources = _jobs(spark, sf_dir)
    return L.retention_reasons(jobs, sources, F.lit(NOW).cast("timestamp")).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_JOBS} SELECT j.id, CASE WHEN j.seq <> s.desired_seq AND j.status IN ('queued', 'running') THEN 'superseded'
WHEN NOT ((j.status = 'running' AND j.lease_until <= TIMESTAMP '{NOW}') OR (j.status = 'queued' AND (j.next_attempt_at IS NULL OR j.next_attempt_at <= TIMESTAMP '{NOW}'))) OR (j.status = 'running' AND j.lease_until IS NULL) THEN 'wait'
WHEN j.attempts >= 3 THEN 'failed' ELSE 'claim' END AS decision, CASE WHEN decision = 'claim' THEN j.fence + 1 ELSE j.fence END AS fence FROM jobs j JOIN sources s ON j.source_id = s.id""")
def job_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, sources = _jobs(spark, sf_dir)
    return L.claim(jobs, sources, F.lit(NOW).cast("timestamp"))


@query(f"""SELECT e.event_id AS id FROM events e WHERE e.ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND NOT EXISTS (FROM orders o WHERE o.o_orderkey = e.event_id AND o.o_orderstatus = 'O')""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("modified_at"))
    references = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return L.unreferenced(files, references, "id", F.lit(NOW).cast("timestamp")).select("id")


@query("""WITH g AS (SELECT printf('b%06d', user_id) AS prefix, (31 - max(day(ts)))::INT AS age_days, count(*) >= 50 AS complete, bool_or(event_type = 'purchase') AS verified FROM events GROUP BY user_id),
t AS (SELECT max(prefix) AS latest FROM g), s AS (SELECT prefix, CASE WHEN prefix = latest THEN 'latest pointer' WHEN age_days < 7 THEN 'online safety window' WHEN NOT (complete AND verified) THEN 'incomplete or not verified' END AS state, latest FROM g, t),
f AS (SELECT max(prefix) FILTER (WHERE state IS NULL AND prefix < latest) AS fallback FROM s)
SELECT prefix, coalesce(state, CASE WHEN fallback IS NULL THEN 'no older verified fallback' WHEN prefix = fallback THEN 'older verified fallback' ELSE 'candidate' END) AS decision FROM s, f""")
def backup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = A.table(spark, sf_dir, "events").groupBy(F.format_string("b%06d", "user_id").alias("prefix")).agg(
        (31 - F.max(F.dayofmonth("ts"))).alias("age_days"), (F.count("*") >= 50).alias("complete"), F.bool_or(F.col("event_type") == "purchase").alias("verified")
    )
    latest = groups.agg(F.max("prefix")).first()[0] or ""
    return L.backup_plan(groups, latest)


@query("SELECT event_id AS id, least(greatest(least(2.0 * pow(2, greatest(event_id % 12 - 1, 0)), 300.0), CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END), 300.0)::DOUBLE AS seconds FROM events")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), L.backoff(F.col("event_id") % 12, asked).alias("seconds"))


_ERRORS, _STAGES = ("tls", "timeout", "connection", "status", "database_busy", "permission", "missing", "value", "other"), ("snapshot", "index_write", "profile", "embed")


@query(f"""WITH f AS (SELECT event_id AS id, [{', '.join(map(repr, _ERRORS))}][event_id % 9 + 1] AS error, [429, 503, 401, 403, 408, 409, 404, 700][event_id % 8 + 1] AS status, [{', '.join(map(repr, _STAGES))}][event_id % 4 + 1] AS stage FROM events),
k AS (SELECT *, CASE error WHEN 'tls' THEN 'upstream_tls_configuration' WHEN 'timeout' THEN CASE WHEN stage IN ('snapshot', 'index_write') THEN 'storage_transient' ELSE 'upstream_timeout' END WHEN 'connection' THEN 'upstream_connection'
WHEN 'status' THEN CASE WHEN status = 429 THEN 'upstream_rate_limit' WHEN status >= 500 THEN 'upstream_server' WHEN status IN (401, 403) THEN 'upstream_auth' ELSE 'upstream_request' END WHEN 'database_busy' THEN 'database_busy'
WHEN 'permission' THEN 'storage_permission' WHEN 'missing' THEN 'artifact_missing' WHEN 'value' THEN 'source_validation' ELSE CASE stage WHEN 'profile' THEN 'pipeline_changed' WHEN 'snapshot' THEN 'integrity_error' ELSE 'internal_error' END END AS kind FROM f)
SELECT id, kind, CASE WHEN error = 'status' THEN status IN (429, 408, 409, 503) ELSE error IN ('timeout', 'connection', 'database_busy') END AS retryable FROM k""")
def failure_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), pick(_ERRORS, 9).alias("error"), pick([429, 503, 401, 403, 408, 409, 404, 700], 8).alias("status"), pick(_STAGES, 4).alias("stage"))
    kind, retry = L.failure_kind(F.col("error"), F.col("status"), F.col("stage"))
    return e.select("id", kind.alias("kind"), retry.alias("retryable"))
