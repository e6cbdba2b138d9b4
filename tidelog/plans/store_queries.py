"""Queries of the key-value store, topics, idempotent batches, retention, message joins and checksums, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import fields as J
from tidelog.operators import fold, join, scan
from tidelog.plans.registry import LOG, SIX_HOURS, register
from tidelog.sources.log import events_log, numbered
from tidelog.sources.tables import table

# --- key-value store: changes that set cas and ttl ---

#: A user's events change the user's key. Some name a cas that the key hasn't; every fourth lives for two days. The SQL applies
#: changes one by one, all keys side by side.
_KV = """WITH RECURSIVE c AS (
  SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, event_type = 'error' AS gone, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
    CASE WHEN event_id % 3 = 0 THEN event_id // 3 % 2 END AS short, CASE WHEN event_id % 4 = 0 THEN 172800000 END AS ttl FROM events),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS cas, CAST(NULL AS BIGINT) AS value, CAST(NULL AS BIGINT) AS expires, true AS deleted, '' AS reason FROM events GROUP BY user_id
  UNION ALL
  SELECT user_id, rn, CASE WHEN reason = 'ok' THEN cas + 1 ELSE cas END, CASE WHEN reason <> 'ok' THEN value WHEN gone THEN NULL ELSE event_id END,
    CASE WHEN reason <> 'ok' THEN expires WHEN gone THEN NULL ELSE at_ms + ttl END, CASE WHEN reason <> 'ok' THEN deleted ELSE gone END, reason FROM (
    SELECT c.*, f.cas, f.value, f.expires, f.deleted,
      CASE WHEN gone AND (f.deleted OR f.expires <= at_ms) THEN 'not_found' WHEN short > 0 AND c.rn > 1 AND c.rn % 2 = 0 THEN 'cas_mismatch' ELSE 'ok' END AS reason
    FROM f JOIN c ON c.user_id = f.user_id AND c.rn = f.rn + 1))
"""


def _kv_changes(spark: SparkSession, d: str) -> DataFrame:
    """expected_cas is -1, which no key has, where the SQL says so."""
    e = table(spark, d, "events")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    wrong = (F.col("event_id") % 3 == 0) & (F.floor(F.col("event_id") / 3) % 2 > 0) & (rn > 1) & (rn % 2 == 0)
    return e.select(
        F.lit("demo").alias("ns"),
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.col("event_id").cast("string").alias("value"),
        F.when(wrong, -1).cast("long").alias("expected_cas"),
        F.when(F.col("event_id") % 4 == 0, 172_800_000).cast("long").alias("ttl_ms"),
        F.unix_millis("ts").alias("at_ms"),
    )


@register(_KV + "SELECT reason, count(*) AS n, count(DISTINCT user_id) AS keys, max(cas) AS high FROM f WHERE rn > 0 GROUP BY reason")
def kv_cas_outcomes(spark, d):
    a = fold.kv_apply(_kv_changes(spark, d))
    return a.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.max("cas").alias("high"))


_LAST = _KV + ", l AS (SELECT user_id, arg_max(cas, rn) AS cas, last(value ORDER BY rn) AS value, last(expires ORDER BY rn) AS expires, arg_max(deleted, rn) AS deleted FROM f GROUP BY user_id), m AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events)"


def _now(spark: SparkSession, d: str) -> int:
    return table(spark, d, "events").agg(F.max(F.unix_millis("ts"))).first()[0]


@register(_LAST + " SELECT CAST(user_id AS VARCHAR) AS key, to_base64(CAST(CAST(value AS VARCHAR) AS BLOB)) AS value, cas, greatest(expires - now, 0) AS ttl_ms FROM l, m WHERE NOT deleted AND (expires IS NULL OR expires > now)")
def kv_point_read(spark, d):
    return fold.kv_get(fold.kv_state(fold.kv_apply(_kv_changes(spark, d))), _now(spark, d)).drop("ns")


@register(_LAST + " SELECT CAST(user_id AS VARCHAR) AS key, cas, greatest(expires - now, 0) AS ttl_ms, NOT deleted AND (expires IS NULL OR expires > now) AS found FROM l, m")
def kv_metadata(spark, d):
    return fold.kv_meta(fold.kv_state(fold.kv_apply(_kv_changes(spark, d))), _now(spark, d)).drop("ns")


# --- topics, batches, retention ---


@register("SELECT event_type AS topic, arg_min(user_id % 7, event_id) FILTER (user_id % 7 > 0) AS partitions, min(event_id) FILTER (user_id % 7 > 0) AS created_seq FROM events WHERE event_type <> 'view' GROUP BY event_type UNION ALL SELECT 'view', 3, -1")
def topic_creation(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 7).alias("partitions"), F.col("event_id").alias("seq"))
    there = spark.range(1).select(F.lit("view").alias("topic"), F.lit(3).cast("long").alias("partitions"), F.lit(-1).cast("long").alias("created_seq"))
    return fold.create_topics(e, there)


@register("""WITH b AS (SELECT event_id, event_type AS topic, user_id % 10 AS producer, CASE WHEN event_id % 6 > 0 THEN user_id % 50 END AS batch_key, event_id % 4 AS size FROM events),
d AS (SELECT *, batch_key IS NOT NULL AND row_number() OVER (PARTITION BY topic, producer, batch_key ORDER BY event_id) > 1 AS duplicate FROM b),
o AS (SELECT *, coalesce(sum(CASE WHEN duplicate THEN 0 ELSE size END) OVER (PARTITION BY topic ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM d),
a AS (SELECT o.*, CASE WHEN duplicate THEN f.own ELSE o.own END AS base FROM o LEFT JOIN (SELECT topic, producer, batch_key, own FROM o WHERE NOT duplicate AND batch_key IS NOT NULL) f USING (topic, producer, batch_key))
SELECT topic, event_id, CAST(base + i AS BIGINT) AS off, duplicate FROM (SELECT *, unnest(range(size)) AS i FROM a)""")
def idempotent_batch(spark, d):
    e = table(spark, d, "events")
    key = F.when(F.col("event_id") % 6 > 0, F.col("user_id") % 50)
    values = F.slice(F.array(*[F.concat(F.col("event_id").cast("string"), F.lit(f"-{i}")) for i in range(3)]), F.lit(1), (F.col("event_id") % 4).cast("int"))
    b = e.select(F.col("event_type").alias("topic"), F.lit(0).alias("partition"), (F.col("user_id") % 10).alias("producer"), key.alias("batch_key"), "event_id", values.alias("values"))
    out = fold.idempotent_batches(b, ["producer"], "event_id")
    return out.select("topic", "event_id", F.col("offset").alias("off"), "duplicate")


@register("""WITH t AS (SELECT event_type AS topic, user_id % 4 AS part, min(event_id) AS since FROM events GROUP BY ALL),
c AS (SELECT CASE WHEN event_id % 100 = 0 THEN '*' ELSE event_type END AS topic, user_id % 4 AS part, event_id AS seq FROM events WHERE event_id % 20 = 0 OR event_id < 3),
x AS (SELECT topic, part, seq FROM c WHERE topic <> '*' UNION ALL SELECT t.topic, t.part, c.seq FROM c JOIN t ON c.topic = '*' AND t.since <= c.seq)
SELECT topic, part, max(seq) AS setting FROM x GROUP BY ALL""")
def retention_every_topic(spark, d):
    e = table(spark, d, "events")
    part = F.pmod("user_id", F.lit(4)).cast("int").alias("partition")
    topics = e.groupBy(F.col("event_type").alias("topic"), part).agg(F.min("event_id").alias("since"))
    told = e.where("event_id % 20 = 0 OR event_id < 3")
    topic = F.when(F.col("event_id") % 100 == 0, "*").otherwise(F.col("event_type")).alias("topic")
    changes = told.select(topic, part, F.lit("ttl_ms").alias("setting"), F.col("event_id").alias("value"), F.col("event_id").alias("seq"))
    return scan.retention_settings(changes, topics).select("topic", F.col("partition").alias("part"), F.col("value").alias("setting"))


_SEALED = f"""WITH {LOG}, b AS (SELECT topic, part, off // 8 AS batch_id, max(ts_ms) AS sealed_ms, sum(length(props)) AS bytes FROM log GROUP BY ALL),
n AS (SELECT max(ts_ms) AS now FROM log),
o AS (SELECT b.*, max(CASE WHEN sealed_ms < now - 1728000000 THEN batch_id END) OVER (PARTITION BY topic, part) AS old FROM b, n),
h AS (SELECT *, sum(bytes) OVER (PARTITION BY topic, part ORDER BY batch_id DESC) AS held FROM o WHERE old IS NULL OR batch_id > old)"""


@register(_SEALED + " SELECT topic, part, count(*) AS batches, min(batch_id) AS low, CAST(sum(bytes) AS BIGINT) AS bytes FROM h WHERE held <= 1500 GROUP BY ALL")
def sealed_batches(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    log = events_log(spark, d).join(e, "event_id")
    batches = log.groupBy("topic", "partition", F.floor(F.col("offset") / 8).alias("batch_id")).agg(F.max(F.unix_millis("ts")).alias("sealed_ms"), F.sum(F.octet_length("props")).alias("bytes"))
    kept = scan.sealed_gc(batches, now_ms=_now(spark, d), max_age_ms=1_728_000_000, max_bytes=1500)
    return kept.groupBy("topic", F.col("partition").alias("part")).agg(F.count("*").alias("batches"), F.min("batch_id").alias("low"), F.sum("bytes").alias("bytes"))


@register(f"WITH {LOG}, s AS (SELECT topic, part, min(off) AS stop FROM log WHERE off > 20 AND event_id % 13 = 0 GROUP BY ALL) SELECT log.topic, log.part, count(*) AS n, max(off) AS last_off FROM log LEFT JOIN s ON log.topic = s.topic AND log.part = s.part WHERE (stop IS NULL OR off < stop) AND event_id % 5 <> 0 GROUP BY ALL")
def unpublished_stop(spark, d):
    log = events_log(spark, d)
    status = F.when((F.col("offset") > 20) & (F.col("event_id") % 13 == 0), "unpublished").when(F.col("event_id") % 5 == 0, "deleted")
    seen = scan.published_prefix(log.withColumn("status", status))
    return seen.groupBy("topic", F.col("partition").alias("part")).agg(F.count("*").alias("n"), F.max("offset").alias("last_off"))


@register(f"WITH {LOG}, g AS (SELECT * FROM log WHERE event_id % 3 <> 0) SELECT topic, part, count(*) AS messages, count(*) FILTER (off <> rn - 1) AS gaps FROM (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY off) AS rn FROM g) GROUP BY ALL")
def offset_gaps_found(spark, d):
    return scan.offset_gaps(events_log(spark, d).where("event_id % 3 <> 0")).withColumnRenamed("partition", "part")


# --- message joins: keys as text, projections, absent sides, a cap ---


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Clicks name k as a number; purchases as text, with a fraction of nought by turns. Some have no k."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = numbered(e.where("event_type IN ('click', 'purchase')"), ["event_type"], "ts", ["event_id"])
    rows = rows.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 9 > 0, k).alias("k"), F.unix_millis("ts").alias("ts_ms"), "off")
    clicks = F.to_json(F.struct("event_id", "user_id", "k"))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("k").cast("string"), F.lit(".0"))).otherwise(F.col("k").cast("string"))
    buys = F.to_json(F.struct("event_id", F.col("user_id").alias("who"), text.alias("ref")))
    left = rows.where("event_type = 'click'").select("off", "ts_ms", clicks.cast("binary").alias("value"))
    right = rows.where("event_type = 'purchase'").select("off", "ts_ms", buys.cast("binary").alias("value"))
    return left, right


_MESSAGES = f"""WITH g AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 9 > 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, epoch_us(ts) // 1000 AS ts_ms,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS off FROM events),
l AS (SELECT * FROM g WHERE event_type = 'click' AND k IS NOT NULL), r AS (SELECT * FROM g WHERE event_type = 'purchase' AND k IS NOT NULL),
j AS (SELECT l.off AS left_off, r.off AS right_off,
    CASE WHEN l.off IS NOT NULL THEN '{{"event_id":"' || l.event_id || '","user_id":"' || l.user_id || '"}}' END AS "left",
    CASE WHEN r.off IS NOT NULL THEN '{{"ref":"' || r.k || CASE WHEN r.event_id % 2 = 0 THEN '.0' ELSE '' END || '"}}' END AS "right"
  FROM l FULL JOIN r ON l.user_id = r.user_id AND l.k = r.k AND abs(l.ts_ms - r.ts_ms) <= {SIX_HOURS * 4})"""
_KEYS = [("user_id", "who"), ("k", "ref")]
_SPEC = join.WindowJoin(SIX_HOURS * 4, 10**12, "full")


@register(_MESSAGES + """ SELECT left_off, right_off, coalesce("left", '{}') AS "left", coalesce("right", '{}') AS "right" FROM j""")
def join_text_keys(spark, d):
    return join.messages_join(*_sides(spark, d), _KEYS, _SPEC, left_fields=("event_id", "user_id"), right_fields=("ref", "nope"), missing_as="{}")


@register(_MESSAGES + """ SELECT left_off, right_off, CASE WHEN left_off IS NOT NULL THEN '{}' END AS "left", "right" FROM j
ORDER BY CASE WHEN right_off IS NULL THEN 1 WHEN left_off IS NULL THEN 2 ELSE 0 END, left_off NULLS FIRST, CASE WHEN right_off IS NOT NULL AND left_off IS NOT NULL THEN -right_off ELSE right_off END LIMIT 150""")
def join_capped(spark, d):
    return join.messages_join(*_sides(spark, d), _KEYS, _SPEC, right_fields=("ref",), max_rows=150)


# --- groups in order of appearance, ordered objects, checksums ---


@register(f"WITH {LOG} SELECT topic, count(*) AS n, rank() OVER (ORDER BY min(event_id)) AS place FROM log GROUP BY topic")
def groups_first_seen(spark, d):
    g = events_log(spark, d).groupBy("topic").agg(F.count("*").alias("n"), F.min("event_id").alias("_first"))
    return g.select("topic", "n", F.rank().over(Window.orderBy("_first")).alias("place"))  # a row a topic


@register("""SELECT l_orderkey, '[' || string_agg('{"line":' || l_linenumber || ',"flag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_returnflag) || ']' AS lines,
  coalesce('[' || string_agg('{"line":' || l_linenumber || '}', ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R') || ']', '[]') AS returned FROM lineitem GROUP BY l_orderkey""")
def ordered_objects(spark, d):
    li = table(spark, d, "lineitem")
    line = F.col("l_linenumber").alias("line")
    whole = F.array_sort(F.collect_list(F.struct(line, F.col("l_returnflag").alias("flag"))))
    some = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct(line))))  # nulls aren't collected
    return li.groupBy("l_orderkey").agg(F.to_json(whole).alias("lines"), F.to_json(some).alias("returned"))


@register("""WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: xor(c // 2, CASE WHEN c % 2 = 1 THEN 2197175160 ELSE 0 END))) AS tab),
b AS (SELECT url, list_transform(range(octet_length(CAST(url AS BLOB))), lambda i: CAST('0x' || substr(hex(CAST(url AS BLOB)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS bytes FROM pages)
SELECT url, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c // 256, tab[CAST(xor(c, x) % 256 AS INTEGER) + 1])), 4294967295) AS crc FROM b, t""")
def checksums(spark, d):
    return table(spark, d, "pages").select("url", J.crc32c(F.col("url").cast("binary")).alias("crc"))
