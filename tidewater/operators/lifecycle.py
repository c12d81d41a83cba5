"""Versioned data: reconcile by content hash, generation diff and checks, publication, deny list, retention, backups, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(parsed: DataFrame, existing: DataFrame, ledger: DataFrame) -> DataFrame:
    """path and change of each document.

    parsed: path, doc_hash of what could be read; existing: path of all files; ledger: path, doc_hash, status. A file
    that exists and could not be parsed has failed and keeps its old data; only a file that is gone is deleted.
    """
    old = ledger.select("path", F.col("doc_hash").alias("old_hash"), "status", F.lit(True).alias("listed"))
    joined = existing.select("path", F.lit(True).alias("present")).join(parsed.select("path", "doc_hash"), "path", "left").join(old, "path", "full_outer")
    change = (
        F.when(F.col("present").isNull(), F.when(F.col("status") == "removed", "gone").otherwise("deleted"))
        .when(F.col("doc_hash").isNull(), "failed")
        .when(F.col("listed").isNull() | (F.col("status") == "removed"), "added")
        .when(F.col("doc_hash") != F.col("old_hash"), "updated").otherwise("unchanged")
    )
    return joined.select("path", change.alias("change")).where("change <> 'gone'")


def manifest_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id and change between two manifests (doc_id, revision)."""
    joined = new.select("doc_id", F.col("revision").alias("n")).join(old.select("doc_id", F.col("revision").alias("o")), "doc_id", "full_outer")
    return joined.select("doc_id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("n") != F.col("o"), "updated").otherwise("skipped").alias("change"))


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The next version of a table: new rows, and old ones that they do not replace."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that only one of two versions has, with the side that lacks them; empty for a good generation."""
    return expected.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct inputs without a cached value, the only ones to compute."""
    return wanted.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def deny_update(denied: Column, known: Column, active: Column, restored: Column) -> Column:
    """The deny list after a publication: known documents that are not active come in, restored ones go."""
    return F.array_sort(F.array_except(F.array_union(denied, F.array_except(known, active)), restored))


def publishable(status: Column, seq: Column, desired: Column, profile: Column, current: Column) -> Column:
    return (status == "prepared") & (seq == desired) & (profile == current)


#: States of a generation job.
PENDING, TERMINAL, SHELVED = ("queued", "running", "prepared"), ("published", "failed", "superseded"), ("quarantined", "collected")


def retention_reasons(jobs: DataFrame, sources: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """job id and the reasons to keep it; no reason and a terminal state make it a candidate."""
    pins = sources.select(F.explode(F.array("active_job", "previous_job")).alias("id")).dropna().distinct().withColumn("pinned", F.lit(True))
    desired = sources.select(F.col("id").alias("source_id"), F.col("desired_seq").alias("seq"), F.lit(True).alias("latest"))
    joined = jobs.join(pins, "id", "left").join(desired, ["source_id", "seq"], "left")
    recent = F.col("updated_at").isNull() | F.col("created_at").isNull() | (F.greatest("updated_at", "created_at") > now - F.expr(f"INTERVAL {days} DAYS"))
    reasons = F.array_compact(F.array(
        F.when(F.col("pinned"), "active_or_rollback"), F.when(F.col("latest"), "latest_source_intent"), F.when(F.col("status").isin(*PENDING), "pending_task"),
        F.when(~F.col("status").isin(*PENDING, *TERMINAL, *SHELVED), "unknown_status"), F.when(recent, "safety_window"),
    ))
    return joined.select("id", "status", reasons.alias("reasons"), ((F.size(reasons) == 0) & F.col("status").isin(*TERMINAL)).alias("candidate"))


def unreferenced(files: DataFrame, references: DataFrame, key: str, now: Column, days: int = 7) -> DataFrame:
    """Files that nothing retained refers to and that are old enough to go."""
    return files.join(references.select(key).distinct(), key, "left_anti").where(F.col("modified_at") <= now - F.expr(f"INTERVAL {days} DAYS"))


def backup_plan(groups: DataFrame, latest: str) -> DataFrame:
    """prefix and decision for backup groups (prefix, age_days, complete, verified).

    The latest, recent, incomplete and unverified ones are protected; of the others the newest that is older than the
    latest stays as a fallback, and without such a one all stay.
    """
    state = F.when(F.col("prefix") == latest, "latest pointer").when(F.col("age_days") < 7, "online safety window").when(~(F.col("complete") & F.col("verified")), "incomplete or not verified")
    named = groups.withColumn("state", state)
    fallback = named.where(F.col("state").isNull() & (F.col("prefix") < latest)).agg(F.max("prefix").alias("fallback"))
    named = named.crossJoin(F.broadcast(fallback))
    rest = F.when(F.col("fallback").isNull(), "no older verified fallback").when(F.col("prefix") == F.col("fallback"), "older verified fallback").otherwise("candidate")
    return named.select("prefix", F.coalesce("state", rest).alias("decision"))


MAX_ATTEMPTS = 3


def claim(jobs: DataFrame, desired: DataFrame, now: Column) -> DataFrame:
    """What a worker may do with each job: supersede, claim, give up or wait."""
    lapsed = (F.col("status") == "running") & (F.col("lease_until") <= now)
    due = (F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    decision = (
        F.when((F.col("seq") != F.col("desired_seq")) & F.col("status").isin("queued", "running"), "superseded").when(~(lapsed | due) | lapsed.isNull(), "wait")
        .when(F.col("attempts") >= MAX_ATTEMPTS, "failed").otherwise("claim")
    )
    return jobs.join(desired.select(F.col("id").alias("source_id"), "desired_seq"), "source_id").select("id", decision.alias("decision"), F.when(decision == "claim", F.col("fence") + 1).otherwise(F.col("fence")).alias("fence"))


def next_jobs(jobs: DataFrame, desired: DataFrame, now: Column) -> DataFrame:
    """The job that each source would claim now: of those that may be claimed the one of the highest seq, with its next fence."""
    open_ = claim(jobs, desired, now).where("decision = 'claim'").join(jobs.select("id", "source_id", "seq"), "id")
    return open_.groupBy("source_id").agg(F.max_by(F.struct("id", "fence"), F.struct("seq", "id")).alias("x")).select("source_id", "x.id", "x.fence")


def backoff(attempt: Column, retry_after: Column | None = None, base: float = 2.0, most: float = 300.0) -> Column:
    """Seconds to wait: exponential, at least what the service asked for, capped; jitter is left out."""
    wait = F.least(base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(most))
    return F.least(F.greatest(wait, F.coalesce(retry_after, F.lit(0.0))), F.lit(most)) if retry_after is not None else wait


def failure_kind(error: Column, status: Column, stage: Column) -> tuple[Column, Column]:
    """(kind, retryable) of a failed step, the first rule that fits; the names are fixed values."""
    storage = stage.isin("snapshot", "index_read", "index_write", "validation")
    rules = [
        (error == "tls", F.lit("upstream_tls_configuration"), F.lit(False)),
        ((error == "timeout") & storage, F.lit("storage_transient"), F.lit(True)),
        (error == "timeout", F.lit("upstream_timeout"), F.lit(True)),
        (error == "connection", F.lit("upstream_connection"), F.lit(True)),
        ((error == "status") & (status == 429), F.lit("upstream_rate_limit"), F.lit(True)),
        ((error == "status") & (status >= 500), F.lit("upstream_server"), status < 600),
        ((error == "status") & status.isin(401, 403), F.lit("upstream_auth"), F.lit(False)),
        (error == "status", F.lit("upstream_request"), status.isin(408, 409)),
        (error == "database_busy", F.lit("database_busy"), F.lit(True)),
        (error == "permission", F.lit("storage_permission"), F.lit(False)),
        (error == "missing", F.lit("artifact_missing"), F.lit(False)),
        (error == "value", F.lit("source_validation"), F.lit(False)),
        (stage == "profile", F.lit("pipeline_changed"), F.lit(False)),
        (stage.isin("snapshot", "validation"), F.lit("integrity_error"), F.lit(False)),
    ]
    kind, retry = F.lit("internal_error"), F.lit(False)
    for condition, name, again in reversed(rules):
        kind, retry = F.when(condition, name).otherwise(kind), F.when(condition, again).otherwise(retry)
    return kind, retry


#: Codes by which a service states an exhausted or missing plan as a rate limit, and database codes that pass.
QUOTA_CODES = ("1113", "1308", "1309", "1310", "1311", "1313", "1314", "1315", "1316", "1317", "1318", "1319", "1320", "1321")
DATABASE_TRANSIENT = (1040, 1205, 1213, 2006, 2013)
LONGEST_WAIT = 300.0


def failure_kind_detailed(error: Column, status: Column, stage: Column, code: Column, delay: Column, may_retry: Column) -> tuple[Column, Column]:
    """``failure_kind`` with what a service or system says of itself, in front of it: a code of its own (quotas, databases), the
    wait that it asks for, and whether it forbids a retry (``may_retry`` false)."""
    known, again = failure_kind(error, status, stage)
    database = code.try_cast("int").isin(*DATABASE_TRANSIENT) | F.contains(F.lower(code), F.lit("locked"))
    rules = [
        ((error == "status") & code.isin(*QUOTA_CODES), F.lit("upstream_quota"), F.lit(False)),
        ((error == "status") & (delay > LONGEST_WAIT), F.lit("provider_long_wait"), F.lit(False)),
        ((error == "status") & ~may_retry, known, F.lit(False)),
        ((error == "database") & database, F.lit("database_transient"), F.lit(True)),
        (error == "database", F.lit("database_configuration"), F.lit(False)),
        ((error == "os") & (code == "ENOSPC"), F.lit("storage_full"), F.lit(False)),
        ((error == "os") & code.isin("EAGAIN", "EINTR", "EIO", "ETIMEDOUT", "ECONNRESET"), F.lit("storage_transient"), F.lit(True)),
        (error == "os", F.lit("storage_error"), F.lit(False)),
    ]
    for condition, name, retry in reversed(rules):
        hit = F.coalesce(condition, F.lit(False))
        known, again = F.when(hit, name).otherwise(known), F.when(hit, retry).otherwise(again)
    return known, again


def deny_changes(known: DataFrame, active: DataFrame, restored: DataFrame, denied: DataFrame, by: list[str]) -> DataFrame:
    """The deny list after a publication as rows of ``by``: denied ones and known ones that are not active, without restored ones.

    Row by row, by anti joins: no list of a source's documents is gathered.
    """
    gone = known.select(*by).distinct().join(active.select(*by), by, "left_anti")
    return gone.unionByName(denied.select(*by)).distinct().join(restored.select(*by), by, "left_anti")


def repairs(changes: DataFrame, expected: DataFrame, target: DataFrame) -> DataFrame:
    """The changes with ``repair`` for an unchanged path whose chunks (path, chunk_id, text_hash) differ in the target."""
    off = differences(expected.select("path", "chunk_id", "text_hash"), target.select("path", "chunk_id", "text_hash")).select("path").distinct().withColumn("off", F.lit(True))
    joined = changes.join(off, "path", "left")
    return joined.select("path", F.when((F.col("change") == "unchanged") & F.col("off"), "repair").otherwise(F.col("change")).alias("change"))


def obsolete(written: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows to drop once all wanted ones are verified as written; none while one is missing."""
    lack = wanted.select(*key).join(written.select(*key), key, "left_anti").limit(1).withColumn("lack", F.lit(True)).select("lack")
    return written.join(wanted.select(*key), key, "left_anti").join(F.broadcast(lack), how="left_anti")


def enqueue(requests: DataFrame, live: DataFrame) -> DataFrame:
    """source_id, decision and seq: refuse an empty source, reuse a live job of the same snapshot and profile, else queue the next number.

    requests: source_id, snapshot, profile, files; live: the latest live job of a source (source_id, snapshot, profile, seq).
    """
    old = live.select("source_id", F.col("snapshot").alias("s"), F.col("profile").alias("p"), F.col("seq").alias("old_seq"))
    same = (F.col("snapshot") == F.col("s")) & (F.col("profile") == F.col("p"))
    decision = F.when(F.col("files") == 0, "refused").when(same, "reused").otherwise("queued")
    last = F.coalesce("old_seq", F.lit(0))
    return requests.join(old, "source_id", "left").select("source_id", decision.alias("decision"), F.when(decision == "queued", last + 1).otherwise(last).cast("long").alias("seq"))


def published(sources: DataFrame, jobs: DataFrame, profile: str) -> DataFrame:
    """The sources after publication: a prepared job of the desired number and the current profile becomes active, the active one previous.

    sources: id, active_job, previous_job, desired_seq, denied, restored; jobs: id, source_id, seq, status, profile. Restored
    documents leave the deny list with the publication.
    """
    good = jobs.where(publishable(F.col("status"), F.col("seq"), F.col("seq"), F.col("profile"), F.lit(profile))).select(F.col("source_id").alias("id"), F.col("seq").alias("desired_seq"), F.col("id").alias("new_job"))
    joined = sources.join(good, ["id", "desired_seq"], "left")
    new = F.col("new_job").isNotNull()
    return joined.select(
        "id", F.coalesce("new_job", "active_job").alias("active_job"), F.when(new, F.col("active_job")).otherwise(F.col("previous_job")).alias("previous_job"), "desired_seq",
        F.when(new, F.array_except("denied", "restored")).otherwise(F.col("denied")).alias("denied"),
    )


def rolled_back(sources: DataFrame) -> DataFrame:
    """The pointers swapped and the desired number raised, so that no late job overtakes; nothing leaves the deny list."""
    can = F.col("previous_job").isNotNull()
    return sources.select(
        "id", F.when(can, F.col("previous_job")).otherwise(F.col("active_job")).alias("active_job"), F.when(can, F.col("active_job")).otherwise(F.col("previous_job")).alias("previous_job"),
        (F.col("desired_seq") + can.cast("int")).alias("desired_seq"), "denied",
    )


def resolved(pointers: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key and whether its active store can be served: its rows are as many as the pointer (key, expected) says; closed otherwise."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return pointers.join(counts, key, "left").select(key, (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("served"))


def scope(old: Column, new: Column) -> Column:
    """What a change of profiles (structs of parser, chunk, embedding and pipeline) makes anew; the widest counts."""
    differs = lambda x: ~old[x].eqNullSafe(new[x])
    return F.when(differs("parser"), "parse").when(differs("chunk"), "chunk").when(differs("embedding"), "embed").when(differs("pipeline"), "validate").otherwise("none")


def purgeable(status: Column, pinned: Column, age_days: Column, days: int) -> Column:
    """Reason that a quarantined generation stays, or eligible."""
    return F.when(status != "quarantined", "not quarantined").when(pinned, "pinned").when(age_days < days, "too young").otherwise("eligible")


def mutations(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """key and kind of the documents that a sync test changes: a seeded share of them, dealt to four kinds by another draw."""
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + salt), key)), 1, 8), 16, 10).cast("long")
    kind = F.element_at(F.array(*map(F.lit, ("body", "metadata", "rename", "delete"))), (draw(1) % 4 + 1).cast("int"))
    return rows.where(draw(0) < int(ratio * (1 << 32))).select(key, kind.alias("kind"))


def cache_state(wanted: DataFrame, cache: DataFrame, key: str, check: str) -> DataFrame:
    """Hits, misses and rebuilds of a stage cache: an entry whose check value differs is built anew."""
    joined = wanted.select(key, F.col(check).alias("want")).join(cache.select(key, F.col(check).alias("have"), F.lit(True).alias("held")), key, "left")
    return joined.agg(F.count_if(F.col("want") == F.col("have")).alias("hits"), F.count_if(F.col("held").isNull()).alias("misses"), F.count_if(F.col("held") & ~F.col("want").eqNullSafe(F.col("have"))).alias("rebuilt"))


def served(rows: DataFrame, denied: DataFrame, key: str) -> DataFrame:
    """What reads may see: the rows that are not denied."""
    return rows.join(denied.select(key).distinct(), key, "left_anti")


def vector_delta(before: DataFrame, after: DataFrame, key: str, vector: str) -> DataFrame:
    """Largest absolute difference of a component between two versions, rows of one side alone and compared rows."""
    joined = before.select(key, F.col(vector).alias("a")).join(after.select(key, F.col(vector).alias("b")), key, "full_outer")
    most = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return joined.agg(F.max(most).cast("double").alias("delta"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("alone"), F.count("*").alias("compared"))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After value: ``250ms``, seconds, or an HTTP date; null where it is none of them or past."""
    date = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = (
        F.when(value.rlike(r"^\d+ms$"), F.regexp_extract(value, r"^(\d+)", 1).try_cast("double") / 1000).when(value.rlike(r"^\d+(\.\d+)?s?$"), F.regexp_extract(value, r"^([\d.]+)", 1).try_cast("double"))
        .otherwise((F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    )
    return F.when(wait >= 0, wait)
