"""Progress of requests as a state machine: node events come in, a progress row goes out for each, and one terminal row.

The reducer appends steps and overwrites fields (the value of the greatest sequence number wins, so events may come in any
order); a repeated event changes nothing. ``done`` and ``error`` close a request; one without a terminal event for
``idle`` is closed by an event-time timer as ``timeout``. What comes for a closed request is passed over until its state
expires, ``keep`` after the terminal event, when a second timer clears it. So state only grows with what is open.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.storage import importable

TERMINAL = ("done", "error")
#: request_id, seq, at, event (node, done or error), node, intent, status, elapsed_ms
EVENTS = "request_id long, seq long, at timestamp, event string, node string, intent string, status string, elapsed_ms double"
PROGRESS = "request_id long, seq long, event string, steps long, nodes string, intent string, status string, elapsed_ms double"
_FIELDS = ("intent", "status")
_ms = lambda at: int(at.timestamp() * 1000)


class Progress(StatefulProcessor):
    """One request: ``steps`` is a list state of what has been done, ``now`` a value state of the fields and the phase."""

    def __init__(self, idle: timedelta, keep: timedelta):
        self.idle, self.keep = int(idle.total_seconds() * 1000), int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getListState("steps", "seq long, node string, elapsed_ms double")
        self.now = handle.getValueState("now", "intent string, intent_seq long, status string, status_seq long, last long, closed string")

    def _row(self, key, seq, event, now, steps):
        steps = sorted(steps)
        return (key[0], seq, event, len(steps), ",".join(n for _, n, _ in steps), now["intent"], now["status"], float(sum(e for _, _, e in steps)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["seq"], kind="stable")
        held = self.now.get() if self.now.exists() else (None, -1, None, -1, 0, None)
        now = dict(zip(("intent", "intent_seq", "status", "status_seq", "last", "closed"), held, strict=True))
        steps = [tuple(s) for s in self.steps.get()] if self.steps.exists() else []
        seen, out, before = {s for s, _, _ in steps}, [], now["last"]
        for e in events.itertuples(index=False):
            if now["closed"] or e.seq in seen:
                continue
            seen.add(e.seq)
            for name in _FIELDS:
                value = getattr(e, name)
                if not pd.isna(value) and e.seq > now[f"{name}_seq"]:
                    now[name], now[f"{name}_seq"] = value, int(e.seq)
            step = (int(e.seq), "" if pd.isna(e.node) else e.node, 0.0 if pd.isna(e.elapsed_ms) else float(e.elapsed_ms))
            steps.append(step)
            self.steps.appendValue(step)
            now["last"] = max(now["last"], _ms(e.at))
            now["closed"] = e.event if e.event in TERMINAL else None
            out.append(self._row(key, int(e.seq), e.event, now, steps))
        if out:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now["last"] + (self.keep if now["closed"] else self.idle))
            self.now.update(tuple(now.values()))
        elif not before:
            self.now.update(tuple(now.values()))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in PROGRESS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        now = dict(zip(("intent", "intent_seq", "status", "status_seq", "last", "closed"), self.now.get(), strict=True))
        if not now["closed"]:
            steps = [tuple(s) for s in self.steps.get()]
            out.append(self._row(key, None, "timeout", now, steps))
            now["closed"] = "timeout"
            self.now.update(tuple(now.values()))
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep)
        else:
            self.now.clear()
            self.steps.clear()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in PROGRESS.split(", ")])

    def close(self) -> None:
        pass


def progress(events: DataFrame, lateness: str = "10 minutes", idle: timedelta = timedelta(minutes=30), keep: timedelta = timedelta(hours=1)) -> DataFrame:
    """Stream of EVENTS to stream of PROGRESS; needs the RocksDB state store (``configured_for_state``)."""
    importable(events.sparkSession)
    keyed = events.withWatermark("at", lateness).groupBy("request_id")
    return keyed.transformWithStateInPandas(Progress(idle, keep), PROGRESS, "Append", "EventTime")


def configured_for_state(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def outcomes(events: DataFrame) -> DataFrame:
    """The same machine over a finished table: each request's last row of PROGRESS, ``open`` without a terminal event.

    Windows order by seq, so events may lie in any order; those after the first terminal one, and repeats, do not count.
    """
    once = events.groupBy("request_id", "seq").agg(*(F.first(c).alias(c) for c in ("event", "node", *_FIELDS, "elapsed_ms")))
    ahead = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    live = once.withColumn("closed", F.coalesce(F.max(F.col("event").isin(*TERMINAL).cast("int")).over(ahead), F.lit(0))).where("closed = 0")
    last = {name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name) for name in _FIELDS}
    steps = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("node", F.lit("")).alias("node"))))
    found = live.groupBy("request_id").agg(F.max("seq").alias("seq"), F.max_by("event", "seq").alias("event"), F.count("*").alias("steps"), F.array_join(F.transform(steps, lambda s: s["node"]), ",").alias("nodes"), *last.values(), F.coalesce(F.sum("elapsed_ms"), F.lit(0.0)).alias("elapsed_ms"))
    return found.withColumn("event", F.when(F.col("event").isin(*TERMINAL), F.col("event")).otherwise("open"))
