"""Range scans, visibility, retention and offsets. All are filters and aggregates over the envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTITION = ["topic", "partition"]


def visible(log: DataFrame, *, now: Column | None = None, ttl_ms: int | None = None, floor: int | None = None, capacity: int | None = None) -> DataFrame:
    """Messages that readers see: no tombstones, not expired, at the floor or above it, among the newest ``capacity``."""
    if "status" in log.columns:
        log = log.where(F.coalesce(F.col("status") != "tombstone", F.lit(True)))
    if ttl_ms is not None:
        log = log.where(F.unix_millis("ts") >= F.unix_millis(now if now is not None else F.current_timestamp()) - ttl_ms)
    if floor is not None:
        log = log.where(F.col("offset") >= floor)
    if capacity is not None:
        heads = log.groupBy(*PARTITION).agg((F.max("offset") + 1 - capacity).alias("_low"))
        log = log.join(heads, PARTITION).where(F.col("offset") >= F.col("_low")).drop("_low")
    return log


def start_offset(offset: int | None, committed: int | None) -> int:
    """First offset of a read: an explicit one (0 and less: the start), else after the committed one, else the start."""
    if offset is not None:
        return max(offset, 0)
    return committed + 1 if committed is not None else 0


def consume(log: DataFrame, topic: str, partition: int, *, offset: int | None = None, committed: int | None = None, limit: int = 100) -> DataFrame:
    """A page of one partition in order. Committed offsets name the last message processed."""
    start = start_offset(offset, committed)
    page = log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= start))
    return page.orderBy("offset").limit(limit)


def commits(requests: DataFrame) -> DataFrame:
    """(topic, group_id, partition, offset) requests to the committed offset of each; older ones change nothing."""
    return requests.groupBy("topic", "group_id", "partition").agg(F.max("offset").alias("committed"))


def unread(log: DataFrame, committed: DataFrame) -> DataFrame:
    """Every group's messages after what it has committed. committed: (topic, group_id, partition, committed)."""
    return log.join(committed, PARTITION).where(F.col("offset") > F.col("committed"))


def delete_before(log: DataFrame, before: DataFrame) -> DataFrame:
    """Messages at each partition's floor and above. before: (topic, partition, floor)."""
    return log.join(before, PARTITION, "left").where(F.col("offset") >= F.coalesce("floor", F.lit(0))).drop("floor")


def deleted_by(log: DataFrame, before: DataFrame) -> DataFrame:
    """(topic, partition, deleted_count, freed_bytes) of a truncation."""
    gone = log.join(before, PARTITION).where(F.col("offset") < F.col("floor"))
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    return gone.groupBy(*PARTITION).agg(F.count("*").alias("deleted_count"), F.sum(size).cast("long").alias("freed_bytes"))


def retain_bytes(log: DataFrame, size: Column, most: int) -> DataFrame:
    """The newest messages of each partition whose sizes add up to ``most`` at most."""
    newest = Window.partitionBy(*PARTITION).orderBy(F.desc("offset")).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("_held", F.sum(size).over(newest)).where(F.col("_held") <= most).drop("_held")


def retention_settings(changes: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """The last write of each setting of each partition: changes (topic, partition, setting, value, seq).

    topics: (topic, partition, since), what there is and since which seq. A change whose topic is ``*`` is one of every
    partition that was there then; later ones don't have it."""
    if topics is not None:
        every = changes.where("topic = '*'").drop(*PARTITION).crossJoin(F.broadcast(topics)).where(F.col("since") <= F.col("seq"))
        changes = changes.where("topic <> '*'").unionByName(every.select(*changes.columns))
    return changes.groupBy(*PARTITION, "setting").agg(F.max_by("value", "seq").alias("value"))


def sealed_gc(batches: DataFrame, *, now_ms: int, max_age_ms: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """What stays of sealed batches (topic, partition, batch_id, sealed_ms, bytes): a prefix of each partition goes. First
    batches up to the last one that is too old, then the oldest until the rest has max_bytes at most."""
    w = Window.partitionBy(*PARTITION)
    kept = batches
    if max_age_ms is not None:
        old = F.max(F.when(F.col("sealed_ms") < now_ms - max_age_ms, F.col("batch_id"))).over(w)
        kept = kept.withColumn("_old", old).where(F.col("_old").isNull() | (F.col("batch_id") > F.col("_old"))).drop("_old")
    if max_bytes is not None:
        held = F.sum("bytes").over(w.orderBy(F.desc("batch_id")).rowsBetween(Window.unboundedPreceding, 0))
        kept = kept.withColumn("_held", held).where(F.col("_held") <= max_bytes).drop("_held")
    return kept


def published_prefix(log: DataFrame) -> DataFrame:
    """What a reader sees of a log with a ``status``: messages before the partition's first ``unpublished`` one, but for those
    that are ``deleted``. Read positions stop there, so nothing is seen out of order."""
    first = log.where("status = 'unpublished'").groupBy(*PARTITION).agg(F.min("offset").alias("_stop"))
    seen = log.join(first, PARTITION, "left").where(F.col("_stop").isNull() | (F.col("offset") < F.col("_stop")))
    return seen.where(F.coalesce(F.col("status") != "deleted", F.lit(True))).drop("_stop")


def offset_gaps(log: DataFrame) -> DataFrame:
    """(topic, partition, messages, gaps): gaps counts messages that aren't where a gap-free log has them."""
    w = Window.partitionBy(*PARTITION).orderBy("offset")
    x = log.withColumn("_want", F.row_number().over(w) - 1)
    return x.groupBy(*PARTITION).agg(F.count("*").alias("messages"), F.count_if(F.col("offset") != F.col("_want")).alias("gaps"))


def backward_moves(history: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, moves): number of rows whose value is below the one before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return history.withColumn("_before", before).groupBy(*keys).agg(F.count_if(F.col(value) < F.col("_before")).alias("moves"))
