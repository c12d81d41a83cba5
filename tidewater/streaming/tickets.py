"""Streaming forms: conversation progress, request dedup, ticket states with custom state, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators.service_desk import TRANSITIONS


def progress(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Steps, time and last node of each conversation in tumbling windows; late events count until the watermark."""
    return (
        events.withWatermark("at", lateness).groupBy(F.window("at", window), "conversation_id")
        .agg(F.count("*").alias("steps"), F.sum("elapsed_ms").alias("elapsed_ms"), F.max_by("node", F.struct("at", "id")).alias("last_node"))
        .select(F.col("window.start").alias("start"), "conversation_id", "steps", "elapsed_ms", "last_node")
    )


def first_requests(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each request once; repeats inside the watermark go."""
    return requests.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["conversation_id", "actor_id", "request_id"])


_LEGAL = frozenset(TRANSITIONS)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status = state.get[0] if state.exists else "new"
    out = []
    rows = pd.concat(list(batches)).sort_values(["at", "seq"])
    for row in rows.itertuples():
        target = "handoff" if row.human else "resolved" if row.closed else "processing" if (row.message and status == "new") or row.reopened else None
        if target and (status, target) in _LEGAL:
            out.append((key[0], row.seq, status, target))
            status = target
    state.update((status,))
    yield pd.DataFrame(out, columns=["conversation_id", "seq", "from_status", "to_status"])


def ticket_changes(turns: DataFrame) -> DataFrame:
    """Legal ticket changes as they happen; the state kept is each conversation's status."""
    return turns.groupBy("conversation_id").applyInPandasWithState(
        _advance, "conversation_id long, seq long, from_status string, to_status string", "status string", "append", GroupStateTimeout.NoTimeout
    )


def append_once(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream so that a repeated batch replaces itself: each epoch has its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
