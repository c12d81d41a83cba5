"""Service-desk analytics: feedback, audit, knowledge-base statistics, tickets, idempotent requests, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.selection import running_max


def feedback_summary(messages: DataFrame, *by: str) -> DataFrame:
    """total counts every role; the rate is of the rated ones, 0 without any. One row, or one for each value of ``by``."""
    up, down = F.count_if(F.expr("feedback = 'up'")), F.count_if(F.expr("feedback = 'down'"))
    return messages.groupBy(*by).agg(F.count("*").alias("total"), up.alias("up"), down.alias("down"), (F.count("*") - up - down).alias("unrated")).withColumn(
        "down_rate", F.when(F.col("up") + F.col("down") > 0, F.round(F.col("down") / (F.col("up") + F.col("down")), 3)).otherwise(0.0)
    )


def last_trace_before(messages: DataFrame, traces: DataFrame, node: str) -> DataFrame:
    """Each message (id, conversation_id, at) with the trace of highest id of a node that is not later; a left join.

    Messages and traces of a conversation are merged by time and the highest trace id so far is carried along, so no
    pair of a message and a trace is ever formed; ``running_max`` carries it from range to range of a long conversation.
    """
    steps = traces.where(F.col("node") == node).select("conversation_id", F.col("at"), F.struct(F.col("id").alias("trace_id"), "n_sources").alias("trace"), F.lit(None).cast("long").alias("id"))
    asked = messages.select("conversation_id", "at", F.lit(None).cast(steps.schema["trace"].dataType).alias("trace"), "id")
    # at equal times traces come before messages
    order = [F.col("at"), F.col("id").isNotNull(), F.coalesce("id", "trace.trace_id")]
    merged = running_max(steps.unionByName(asked), "conversation_id", order, "trace", "best")
    return merged.where("id is not null").select("id", "conversation_id", F.col("best.trace_id").alias("trace_id"), F.col("best.n_sources").alias("n_sources"))


def feedback_category(trace_id: Column, n_sources: Column) -> Column:
    """Why an answer was voted down; the labels are fixed values."""
    return F.when(trace_id.isNull(), "other").when(F.coalesce(n_sources, F.lit(0)) == 0, "missing").otherwise("stale")


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in descending order of id."""
    return rows.orderBy(F.desc("id")).offset(offset).limit(limit)


def expiring(ledger: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Documents with the days that their validity lasts (null if it can't be read) and whether that is a cause for alarm."""
    left = F.datediff(F.try_to_timestamp("valid_to", F.lit("yyyy-MM-dd")).cast("date"), F.lit(today).cast("date"))
    return ledger.withColumn("expiring_days", left).withColumn("alert", F.coalesce(F.col("expiring_days") <= days, F.lit(False)))


#: Allowed ticket transitions.
TRANSITIONS = [("new", "processing"), ("new", "handoff"), ("processing", "resolved"), ("processing", "handoff"), ("resolved", "processing")]


def target_status(human: Column, closed: Column, message: Column, reopened: Column, status: Column) -> Column:
    """The state that a turn asks for, null for none: handoff, then resolved, first message, reopened."""
    return F.when(human, "handoff").when(closed, "resolved").when(message & (status == "new"), "processing").when(reopened, "processing")


def ticket_log(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Legal state changes of each conversation: key, seq, from_status, to_status.

    turns: key, seq, human, closed, message, reopened. Each conversation folds its own ordered turns through the
    transition table; changes that it does not allow keep the state.
    """
    turn = F.struct("seq", "human", "closed", "message", "reopened")
    legal = F.array(*(F.lit(f"{a}>{b}") for a, b in TRANSITIONS))
    entry = "array<struct<seq:bigint,from_status:string,to_status:string>>"

    def step(acc: Column, t: Column) -> Column:
        target = target_status(t["human"], t["closed"], t["message"], t["reopened"], acc["status"])
        moves = F.coalesce(F.array_contains(legal, F.concat(acc["status"], F.lit(">"), target)), F.lit(False))
        line = F.struct(t["seq"].cast("long").alias("seq"), acc["status"].alias("from_status"), target.alias("to_status"))
        return F.struct(
            F.when(moves, target).otherwise(acc["status"]).alias("status"), F.when(moves, F.array_append(acc["log"], line)).otherwise(acc["log"]).alias("log")
        )

    start = F.struct(F.lit("new").alias("status"), F.array().cast(entry).alias("log"))
    folded = turns.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(turn)), start, step, lambda acc: acc["log"]).alias("log"))
    return folded.select(key, F.inline("log"))


def illegal_changes(log: DataFrame) -> DataFrame:
    """Changes that the table does not allow or that do not start from the state before."""
    allowed = log.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string")
    before = F.lag("to_status", 1, "new").over(Window.partitionBy("conversation_id").orderBy("seq"))
    marked = log.withColumn("before", before)
    return marked.join(F.broadcast(allowed), ["from_status", "to_status"], "left_anti").withColumn("reason", F.lit("not allowed")).unionByName(
        marked.join(F.broadcast(allowed), ["from_status", "to_status"], "left_semi").where("from_status <> before").withColumn("reason", F.lit("broken chain"))
    ).drop("before")


def request_decision(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """What an incoming request is: new, a replay of a finished one, a conflict, or not yet confirmed."""
    keys = ["conversation_id", "actor_id", "request_id"]
    old = ledger.select(*keys, F.col("fingerprint").alias("old"), F.col("status").alias("old_status"))
    decision = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("fingerprint"), "conflict").when(F.col("old_status") == "pending", "unconfirmed").otherwise("replay")
    return requests.join(old, keys, "left").withColumn("decision", decision).drop("old", "old_status")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Rows beyond those that are stored already, by their number in the group."""
    count = stored.groupBy(key).agg(F.count("*").alias("stored"))
    numbered = incoming.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return numbered.join(count, key, "left").where(F.col("nth") > F.coalesce("stored", F.lit(0))).drop("stored", "nth")


def carried_state(turns: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The last non-empty value of each field."""
    return turns.groupBy(key).agg(*(F.max_by(f, F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col(order))).alias(f) for f in fields))


def step_times(traces: DataFrame) -> DataFrame:
    """Elapsed milliseconds of each step: its own, else the time since the one before."""
    now = F.unix_micros(F.col("at").cast("timestamp"))
    since = (now - F.lag(now).over(Window.partitionBy("conversation_id").orderBy("at", "id"))) / 1000
    return traces.withColumn("step_ms", F.coalesce("elapsed_ms", since))


def peak_concurrency(spans: DataFrame, key: str) -> DataFrame:
    """Most spans (key, start, end) open at once; one that ends as another starts does not count with it."""
    edges = spans.select(key, F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(spans.select(key, F.col("end").alias("at"), F.lit(-1).alias("d")))
    running = F.sum("d").over(Window.partitionBy(key).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return edges.withColumn("open", running).groupBy(key).agg(F.max("open").alias("peak"))
