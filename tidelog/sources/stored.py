"""A log on storage: Parquet files by topic and partition, with their offsets in them.

Reads by topic, partition and offset touch the files of that partition only, and of those the row groups whose offsets fit.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTITION = ["topic", "partition"]
_written: dict[tuple[str, str], str] = {}


def with_offsets(rows: DataFrame, order: list[str], staging: str) -> DataFrame:
    """Rows (topic, partition, ...) with gap-free offsets in order, without a window over a whole partition.

    Rows are dealt by ranges of (topic, partition, order) and staged; a range's rows are numbered where they lie, from the
    number of rows that the ranges before it have of the partition on. A large partition is so shared by many tasks.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*PARTITION, *order).withColumn("_range", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(ranged.schema).parquet(staging)
    counts = staged.groupBy(*PARTITION, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*PARTITION).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = counts.select(*PARTITION, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*PARTITION, "_range").orderBy(*order))
    numbered = staged.withColumn("_in", inside).join(base, [*PARTITION, "_range"])
    return numbered.withColumn("offset", (F.col("_base") + F.col("_in") - 1).cast("long")).drop("_base", "_in", "_range")


def write_log(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Write rows (topic, partition, ...) as a log and read it."""
    numbered = with_offsets(rows, order, f"{path}-staged")
    numbered.repartitionByRange(*PARTITION, "offset").sortWithinPartitions(*PARTITION, "offset").write.mode("overwrite").partitionBy(*PARTITION).parquet(path)
    return read_log(rows.sparkSession, path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that the driver and all executors share: under spark.checkpoint.dir, or on one machine a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}"


def stored_once(rows: DataFrame, name: str, source: str, order: list[str]) -> DataFrame:
    """write_log's result, written once an application for a source that doesn't change."""
    spark = rows.sparkSession
    key = (spark.sparkContext.applicationId, json.dumps([name, source]))
    if key not in _written:
        path = scratch(spark, f"{name}-{abs(hash(key))}")
        write_log(rows, path, order)
        _written[key] = path
    return read_log(spark, _written[key])


def replay(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """State after all sealed records (seq, kind, topic, partition, group_id, key, value, number, crc) of a folder.

    kind says what a record tells: message, commit, kv_put, kv_delete, idempotency, truncate. A record whose crc isn't that of
    its value is counted and left out. Gives messages, commits, kv, idempotency, floors and skipped (one row, n).
    """
    from tidelog.functions.fields import crc32c

    sealed = spark.read.parquet(path)
    sound = F.col("crc").eqNullSafe(crc32c(F.coalesce(F.col("value"), F.lit(b""))))
    r = sealed.where(sound)
    floors = r.where("kind = 'truncate'").groupBy(*PARTITION).agg(F.max("number").alias("floor"))
    messages = r.where("kind = 'message'").join(floors, PARTITION, "left").where("floor IS NULL OR number >= floor")
    last = r.where("kind IN ('kv_put', 'kv_delete')").groupBy("topic", "key").agg(F.max_by(F.struct("kind", "value", "number"), "seq").alias("s"), F.count("*").alias("cas"))
    return {
        "messages": messages.select(*PARTITION, F.col("number").alias("offset"), "key", "value"),
        "commits": r.where("kind = 'commit'").groupBy(*PARTITION, "group_id").agg(F.max("number").alias("committed")),
        "kv": last.select(F.col("topic").alias("ns"), "key", F.when(F.col("s.kind") == "kv_put", F.col("s.value")).alias("value"), "cas", (F.col("s.kind") == "kv_delete").alias("deleted")),
        "idempotency": r.where("kind = 'idempotency'").groupBy(*PARTITION, "key").agg(F.min_by("number", "seq").alias("answer_offset")),
        "floors": floors,
        "skipped": sealed.agg(F.count_if(~sound).alias("n")),
    }
