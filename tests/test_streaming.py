"""Streaming forms against their batch results."""

from tidewater.operators.service_desk import ticket_log
from tidewater.streaming import tickets


def test_ticket_changes(spark, tmp_path):
    rows = [(1, 1, 1, False, False, True, False), (1, 2, 2, False, True, False, False), (1, 3, 3, False, False, False, True), (2, 1, 1, False, True, False, False), (2, 2, 2, True, False, False, False), (2, 3, 3, False, False, True, True)]
    schema = "conversation_id long, seq long, at long, human boolean, closed boolean, message boolean, reopened boolean"
    turns = spark.createDataFrame(rows, schema)
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tickets.ticket_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("changes").collect()))
    assert got == sorted(map(tuple, ticket_log(turns).collect()))
    assert got == [(1, 1, "new", "processing"), (1, 2, "processing", "resolved"), (1, 3, "resolved", "processing"), (2, 2, "new", "handoff")]
