"""The message envelope (topic, partition, offset, ts, key, value) and ways into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.sources.tables import table

ENVELOPE = ("topic", "partition", "offset", "ts", "key", "value")


def append(rows: DataFrame, order: list[str], heads: DataFrame | None = None) -> DataFrame:
    """Give rows (topic, partition, ...) gap-free offsets per partition, in an order, from each partition's head on.

    heads: (topic, partition, head), the next free offset; 0 where it has none."""
    w = Window.partitionBy("topic", "partition").orderBy(*order)
    out = rows.withColumn("offset", F.row_number().over(w).cast("long") - 1)
    if heads is not None:
        out = out.join(heads, ["topic", "partition"], "left").withColumn("offset", F.col("offset") + F.coalesce("head", F.lit(0))).drop("head")
    return out


def numbered(rows: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """Rows with ``off``, from 0 on for each of the keys, none of them null, in the order of a timestamp and then of ``order``.

    A minute's rows are numbered together, from the number of rows of the minutes before it on, so that many tasks share the
    rows of a key.
    """
    sliced = rows.withColumn("_slice", F.coalesce(F.floor(F.unix_seconds(at) / 60), F.lit(-(2**62))))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a minute
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    base = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(at, *order))
    out = sliced.withColumn("_in", inside).join(base, [*keys, "_slice"])
    return out.withColumn("off", F.col("_base") + F.col("_in") - 1).drop("_slice", "_in", "_base")


def events_log(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """The events table as a log: topic by type, partition by user, value a JSON object. Payload columns stay beside it."""
    e = table(spark, sf_dir, "events")
    value = F.to_json(F.struct("event_id", "user_id", "event_type", F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    rows = e.select(F.col("event_type").alias("topic"), F.pmod("user_id", F.lit(partitions)).cast("int").alias("partition"), "ts", F.col("user_id").cast("string").cast("binary").alias("key"), value.cast("binary").alias("value"), "event_id", "user_id")
    return append(rows, ["ts", "event_id"])


def ndjson(lines: DataFrame, topic: str, partition: int, ts: Column) -> DataFrame:
    """Lines (line_no, value) to messages: one trailing CR goes, empty lines go, a JSON string is unwrapped."""
    bare = F.regexp_replace("value", "\r$", "")
    unwrapped = F.when(bare.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"s":'), bare, F.lit("}")), "$.s"), bare)).otherwise(bare)
    rows = lines.where(bare != "").select("line_no", F.lit(topic).alias("topic"), F.lit(partition).alias("partition"), ts.alias("ts"), F.lit(None).cast("binary").alias("key"), unwrapped.cast("binary").alias("value"))
    return append(rows, ["line_no"]).select(*ENVELOPE)


def read_ndjson(spark: SparkSession, path: str, topic: str, partition: int, ts: Column) -> DataFrame:
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("line_no"), "value")
    return ndjson(lines, topic, partition, ts)


def choose_partition(key: Column, partitions: int, by_key: bool = True) -> Column:
    """By the key's hash; or all to one partition, as a log does that ignores keys."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int") if by_key else F.lit(0)
