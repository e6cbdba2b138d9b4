"""Ordered folds over change logs: key-value state with compare-and-set, payment state machines, retries, repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelog.functions import fields as J


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[object, dict], tuple[object, dict]], out: str) -> DataFrame:
    """One output row for each input row, from a state that is carried along each key's rows in order.

    Rows stream through sorted partitions; only one key's state is held, however long its history is."""

    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, state = now, None
                state, result = step(state, row)
                done.append(result)
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def _kv_step(state, row):
    """State: (cas, value, expires_ms, deleted)."""
    cas, value, expires, gone = state or (0, None, None, True)
    want, now = row.get("expected_cas"), row.get("at_ms") or 0
    live = not gone and (expires is None or expires > now)
    ok, reason = True, "ok"
    if row["op"] == "put":
        if want is not None and want != cas:
            ok, reason = False, "cas_mismatch"
        else:
            ttl = row.get("ttl_ms")
            cas, value, expires, gone = cas + 1, row["value"], now + ttl if ttl else None, False
    elif not live:
        ok, reason = False, "not_found"
    elif want is not None and want != cas:
        ok, reason = False, "cas_mismatch"
    else:
        cas, value, expires, gone = cas + 1, None, None, True
    result = {"ns": row["ns"], "key": row["key"], "seq": row["seq"], "ok": ok, "reason": reason, "cas": cas, "value": value, "expires_ms": expires, "deleted": gone}
    return (cas, value, expires, gone), result


KV = "ns string, key string, seq long, ok boolean, reason string, cas long, value string, expires_ms long, deleted boolean"


def kv_apply(changes: DataFrame) -> DataFrame:
    """Outcome of every change (ns, key, seq, op put|delete, value, expected_cas, ttl_ms, at_ms) to a key-value store."""
    return ordered_fold(changes, ["ns", "key"], ["seq"], _kv_step, KV)


def kv_state(applied: DataFrame) -> DataFrame:
    """(ns, key, cas, value, expires_ms, deleted): the last state of every key."""
    last = F.max_by(F.struct("cas", "value", "expires_ms", "deleted"), "seq").alias("s")
    return applied.groupBy("ns", "key").agg(last).select("ns", "key", "s.*")


def kv_meta(state: DataFrame, now_ms: int) -> DataFrame:
    """(ns, key, cas, ttl_ms, found): of every key that was ever written; no time to live is null."""
    gone = F.col("deleted") | F.coalesce(F.col("expires_ms") <= now_ms, F.lit(False))
    return state.select("ns", "key", "cas", F.greatest(F.col("expires_ms") - now_ms, F.lit(0)).alias("ttl_ms"), (~gone).alias("found"))


def kv_get(state: DataFrame, now_ms: int) -> DataFrame:
    """(ns, key, value base64, cas, ttl_ms) of the keys that are there."""
    live = state.where(~F.col("deleted") & (F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms)))
    return live.select("ns", "key", J.base64_text(F.col("value").cast("binary")).alias("value"), "cas", F.greatest(F.col("expires_ms") - now_ms, F.lit(0)).alias("ttl_ms"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: idempotent writes, insert or do nothing."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def idempotent_results(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every request with the offset it is answered with and whether it repeats an earlier one. keys exclude offsets."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"answer_offset": F.first("offset").over(w), "duplicate": F.row_number().over(w) > 1})


def idempotent_batches(batches: DataFrame, producer: list[str], order: str) -> DataFrame:
    """Batches (topic, partition, batch_key, values, ...) to messages: (producer and order columns, value, offset, duplicate).

    A batch's key covers all its values. The first batch of a key and producer is appended and each later one is answered with
    the first one's offsets. A batch without a key always counts. Batches are numbered in order within a partition.
    """
    keys = ["topic", "partition", *producer, "batch_key"]
    b = batches.withColumn("duplicate", F.col("batch_key").isNotNull() & (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1))
    earlier = Window.partitionBy("topic", "partition").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.when(~F.col("duplicate"), F.size("values")).otherwise(0)).over(earlier), F.lit(0))
    b = b.withColumn("_own", own).withColumn("_base", F.first(F.when(~F.col("duplicate"), F.col("_own")), True).over(Window.partitionBy(*keys).orderBy(order)))
    base = F.when(F.col("duplicate"), F.col("_base")).otherwise(F.col("_own"))
    b = b.select("topic", "partition", *producer, "batch_key", order, base.alias("_base"), "duplicate", F.posexplode("values").alias("_at", "value"))
    return b.withColumn("offset", (F.col("_base") + F.col("_at")).cast("long")).drop("_base", "_at")


def create_topics(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Requests (topic, partitions, seq) to topics (topic, partitions, created_seq): the first request of a topic counts, and a
    topic that exists keeps its partitions. Requests for fewer than one partition are errors and make nothing."""
    first = requests.where("partitions > 0").groupBy("topic").agg(F.min_by("partitions", "seq").alias("partitions"), F.min("seq").alias("created_seq"))
    if existing is None:
        return first
    return existing.select("topic", "partitions", "created_seq").unionByName(first.join(existing.select("topic"), "topic", "left_anti"))


def upsert_totals(rows: DataFrame, keys: list[str], add: str, order: str, status: str) -> DataFrame:
    """Upserts folded at once: sums add, the greatest order stays, the last status overwrites."""
    return rows.groupBy(*keys).agg(F.sum(add).alias("total"), F.max(order).alias("last_seq"), F.max_by(status, order).alias("status"))


def ranked_states(events: DataFrame) -> DataFrame:
    """Webhooks (payment_id, seq, state, rank): lower ranks are stale, an equal state is a duplicate, others apply.

    (payment_id, seq, incoming, current, action, reason, successes); a state has one rank. The rank so far is a running
    maximum, and the current state that of the last row that reached it.
    """
    before = Window.partitionBy("payment_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("payment_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("_high", F.max("rank").over(before))
    e = e.withColumn("current", F.last(F.when(F.col("_high").isNull() | (F.col("rank") >= F.col("_high")), F.col("state")), True).over(before))
    stale = F.coalesce(F.col("rank") < F.col("_high"), F.lit(False))
    same = F.coalesce(F.col("current") == F.col("state"), F.lit(False))
    e = e.withColumn("action", F.when(stale, "IGNORED").when(same, "SUPPRESSED").otherwise("APPLIED"))
    e = e.withColumn("reason", F.when(stale, "stale_state_transition").when(same, "duplicate_webhook"))
    wins = F.count_if((F.col("action") == "APPLIED") & (F.col("state") == "SUCCESS")).over(so_far)
    return e.select("payment_id", "seq", F.col("state").alias("incoming"), "current", "action", "reason", wins.alias("successes"))


TERMINAL = "payment_id string, seq long, incoming string, before string, after string, decision string"
_END = ("SUCCESS", "FAILED")
CONFLICT = "REJECTED_TERMINAL_CONFLICT_NEW_PAYMENT_ID_REQUIRED"


def terminal_step(current: str | None, incoming: str, repeated: bool) -> tuple[str | None, str]:
    """The state after a webhook, and what was decided."""
    if repeated or (current in _END and incoming == current):
        return current, "SUPPRESSED_DUPLICATE"
    if current in _END:
        return current, "IGNORED_STALE_TRANSITION" if incoming == "PROCESSING" else CONFLICT
    return incoming, "APPLIED"


def terminal_states(events: DataFrame) -> DataFrame:
    """Webhooks (payment_id, seq, state, provider_event_id): a terminal state never changes. Columns as of TERMINAL.

    An event id that the payment has had before is a repetition, whatever became of the first; null ids repeat nothing. The
    state before a row is the first terminal one among the rows before that aren't repetitions, else the last of those.
    """
    nth = F.row_number().over(Window.partitionBy("payment_id", "provider_event_id").orderBy("seq"))
    before = Window.partitionBy("payment_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("_again", F.col("provider_event_id").isNotNull() & (nth > 1))
    own = F.when(~F.col("_again"), F.col("state"))
    e = e.withColumn("before", F.coalesce(F.first(F.when(own.isin(*_END), own), True).over(before), F.last(own, True).over(before)))
    ended = F.coalesce(F.col("before").isin(*_END), F.lit(False))
    same = F.coalesce(F.col("before") == F.col("state"), F.lit(False))
    decision = F.when(F.col("_again") | (ended & same), "SUPPRESSED_DUPLICATE").when(ended & (F.col("state") == "PROCESSING"), "IGNORED_STALE_TRANSITION").when(ended, CONFLICT).otherwise("APPLIED")
    e = e.withColumn("decision", decision)
    after = F.when(F.col("decision") == "APPLIED", F.col("state")).otherwise(F.col("before"))
    return e.select("payment_id", F.col("seq").cast("long").alias("seq"), F.col("state").alias("incoming"), "before", after.alias("after"), "decision")


def dead_letters(attempts: DataFrame, keys: list[str], failed: str, most: int = 3) -> DataFrame:
    """(keys, failures) of what has failed ``most`` times or more."""
    return attempts.groupBy(*keys).agg(F.count_if(F.expr(failed)).alias("failures")).where(F.col("failures") >= most)


def repair_missing(pages: DataFrame, recovered: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows still MISSING become CONFIRMED, and only if a replay has them; repaired says which."""
    hit = recovered.select(*keys, F.lit(True).alias("_hit")).distinct()
    joined = pages.join(hit, keys, "left").withColumn("repaired", (F.col("status") == "MISSING") & F.coalesce("_hit", F.lit(False)))
    return joined.withColumn("status", F.when(F.col("repaired"), "CONFIRMED").otherwise(F.col("status"))).drop("_hit")
