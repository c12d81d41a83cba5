"""The request state machine: stream equal to batch with late, repeated and unordered events, and its timers."""

from datetime import datetime, timedelta

import pytest

from tidewater.streaming import requests as R

T0 = datetime(2024, 1, 1, 12)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def run(spark, tmp_path, batches, **settings):
    R.configured_for_state(spark)
    source = tmp_path / "in"
    query = None
    spark.createDataFrame([], R.EVENTS).write.parquet(str(source))
    stream = R.progress(spark.readStream.schema(R.EVENTS).parquet(str(source)), **settings)
    name = f"progress_{tmp_path.name.replace('-', '_')}"
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, R.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


@pytest.fixture(scope="module")
def batches():
    first = [(1, 1, at(0), "node", "intent", "vpn", None, 5.0), (1, 3, at(2), "node", "answer", None, "processing", 7.0), (2, 1, at(1), "node", "intent", "mail", "new", None), (3, 1, at(1), "node", "intent", None, None, 1.0)]
    # late but within the watermark, out of order, repeated in a batch and across batches
    second = [(1, 2, at(1), "node", "search", "late", None, 2.0), (1, 3, at(2), "node", "answer", None, "processing", 7.0), (1, 2, at(1), "node", "search", "late", None, 2.0), (2, 2, at(3), "error", None, None, "failed", 4.0)]
    third = [(1, 4, at(5), "done", "close", None, "resolved", 1.0), (1, 5, at(6), "node", "after", "x", "x", 100.0), (2, 3, at(6), "done", "close", None, "resolved", 1.0)]
    return [first, second, third]


def test_stream_equals_batch(spark, tmp_path, batches):
    got = run(spark, tmp_path, batches)
    every = spark.createDataFrame([x for b in batches for x in b], R.EVENTS)
    want = {r["request_id"]: tuple(r) for r in R.outcomes(every).select(*[x.split()[0] for x in R.PROGRESS.split(", ")]).collect()}
    last = {}
    for row in got:
        if row[0] not in last or row[3] > last[row[0]][3]:
            last[row[0]] = row
    assert {k: v[:2] + v[3:] for k, v in last.items()} == {k: v[:2] + v[3:] for k, v in want.items()}
    assert want[1] == (1, 4, "done", 4, "intent,search,answer,close", "late", "resolved", 15.0)
    assert [x[2] for x in got if x[0] == 1].count("done") == 1 and [x[2] for x in got if x[0] == 2] == ["node", "error"]
    # one row for each step that counted
    assert sorted((x[0], x[1]) for x in got) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 1)]


def test_timers(spark, tmp_path):
    """A silent request times out once; when a closed one's state has expired, its id begins anew."""
    batches = [
        [(1, 1, at(0), "node", "intent", "vpn", None, 5.0), (2, 1, at(0), "done", "close", None, None, 1.0)],
        [(9, 1, at(50), "node", "x", None, None, 1.0)],  # the watermark passes 1's idle time
        [(9, 2, at(51), "node", "x", None, None, 1.0)],
        [(1, 2, at(55), "node", "late", None, None, 1.0)],  # closed by its timeout
        [(9, 3, at(200), "done", "x", None, None, 1.0)],  # and 1 and 2 expire
        [(8, 1, at(201), "node", "x", None, None, 1.0)],
        [(2, 1, at(202), "node", "again", "new", None, 1.0)],
    ]
    got = run(spark, tmp_path, batches, lateness="5 minutes", idle=timedelta(minutes=30), keep=timedelta(hours=1))
    assert [x for x in got if x[0] == 1] == [(1, 1, "node", 1, "intent", "vpn", None, 5.0), (1, None, "timeout", 1, "intent", "vpn", None, 5.0)]
    assert [x[2:5] for x in got if x[0] == 2] == [("done", 1, "close"), ("node", 1, "again")]
