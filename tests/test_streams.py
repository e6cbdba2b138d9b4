"""Streaming forms give what their batch forms give."""

from pyspark.sql import functions as F

from tidelog.operators import fold
from tidelog.streaming import streams


def test_sink_adds_a_key_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "event_id string, v int")
    rows.write.parquet(f"{tmp_path}/in")
    for run in range(2):  # the second run replays all batches from a new checkpoint
        streams.exactly_once_sink(streams.follow(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", f"{tmp_path}/c{run}", ["event_id"]).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_terminal_states_as_stream(spark, tmp_path):
    e = spark.createDataFrame([("p", 1, "PROCESSING", "a"), ("p", 2, "SUCCESS", "b"), ("p", 3, "SUCCESS", "b"), ("q", 1, "FAILED", "c"), ("q", 2, "SUCCESS", "d")], "payment_id string, seq long, state string, provider_event_id string")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = streams.terminal_states_stream(streams.follow(spark, f"{tmp_path}/in", e.schema))
    out.writeStream.format("memory").queryName("terminal").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r) for r in fold.terminal_states(e).collect()}
    assert {tuple(r) for r in spark.table("terminal").collect()} == want


def test_windowed_counts_as_stream(spark, tmp_path):
    e = spark.createDataFrame([(i, "k") for i in range(0, 600, 50)], "s long, key string").select(F.timestamp_seconds("s").alias("ts"), "key")
    e.write.parquet(f"{tmp_path}/in")
    q = streams.windowed_counts(streams.follow(spark, f"{tmp_path}/in", e.schema), ["key"], "200 seconds", "0 seconds")
    q.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("counted").collect()) == [4, 4, 4]
