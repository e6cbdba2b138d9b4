"""Structured Streaming forms: sources, windowed counts, window joins, deduplication, exactly-once sinks, state machines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidelog.operators.fold import TERMINAL, terminal_step


def follow(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A directory of Parquet files as a stream; files_per_trigger is the back pressure."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(path)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def windowed_counts(stream: DataFrame, keys: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def window_join_stream(left: DataFrame, right: DataFrame, key: str, size_ms: int, late: str, how: str = "inner") -> DataFrame:
    """Both sides (key, ts, ...), renamed by the caller apart from key and ts; state is dropped behind both watermarks."""
    a = left.withColumnRenamed(key, "l_key").withColumnRenamed("ts", "l_ts").withWatermark("l_ts", late)
    b = right.withColumnRenamed(key, "r_key").withColumnRenamed("ts", "r_ts").withWatermark("r_ts", late)
    gap = F.make_dt_interval(secs=F.lit(size_ms / 1000))
    near = (F.col("r_ts") >= F.col("l_ts") - gap) & (F.col("r_ts") <= F.col("l_ts") + gap)
    return a.join(b, (F.col("l_key") == F.col("r_key")) & near, {"inner": "inner", "left": "leftOuter", "right": "rightOuter", "full": "fullOuter"}[how])


def first_seen(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Idempotent ingestion: a key counts once for as long as the watermark keeps it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def exactly_once_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], before_write: Callable[[DataFrame, int], DataFrame] | None = None, within: str | None = None) -> StreamingQuery:
    """Append rows whose keys the target doesn't hold yet. A batch that is replayed finds its rows there and adds none.

    within: a column whose value all rows of a key share, such as the day of the event. The target is then partitioned by it,
    and only the partitions of a batch's values are read, so a batch costs as much however long the target is.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = before_write(batch, batch_id) if before_write else batch
        rows = rows.dropDuplicates(keys)
        try:
            held = batch.sparkSession.read.schema(rows.schema).parquet(path)
        except Exception as error:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        else:
            if within:
                held = held.where(F.col(within).isin([r[0] for r in rows.select(within).distinct().collect()]))  # values of one batch
            rows = rows.join(held.select(*keys), keys, "left_anti")
        writer = rows.write.mode("append")
        (writer.partitionBy(within) if within else writer).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def terminal_states_stream(stream: DataFrame, forget: str | None = None) -> DataFrame:
    """The terminal-state machine with its state in the state store: (payment_id, seq, state, provider_event_id[, ts]).

    forget: with a column ts, a payment's state goes when the watermark is that much past its last webhook; repetitions that
    come later still are new. Without it states stay.
    """
    millis = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        current, ids = held.get if held.exists else (None, "[]")
        seen = set(json.loads(ids))
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable").to_dict("records")
        out = []
        for row in rows:
            name = row["provider_event_id"]
            name = None if pd.isna(name) else name
            before = current
            current, decision = terminal_step(before, row["state"], name is not None and name in seen)
            if name is not None:
                seen.add(name)
            out.append((row["payment_id"], row["seq"], row["state"], before, current, decision))
        held.update((current, json.dumps(sorted(seen))))
        if forget:
            last = max(int(row["ts"].timestamp() * 1000) for row in rows)
            held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in TERMINAL.split(", ")])

    if forget:
        stream = stream.withWatermark("ts", forget)
    timeout = GroupStateTimeout.EventTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return stream.groupBy("payment_id").applyInPandasWithState(step, TERMINAL, "current string, seen string", "append", timeout)
