"""The log queries by name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import fields as J
from tidelog.operators import fold, join, query, scan
from tidelog.plans import receipts
from tidelog.sources.log import append, choose_partition, events_log, ndjson, numbered
from tidelog.sources.stored import stored_once
from tidelog.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The log as SQL, for the oracles.
LOG = "log AS (SELECT event_id, user_id, event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part, ts, epoch_us(ts) // 1000 AS ts_ms, value, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS off FROM events)"
SIX_HOURS, FOREVER, TTL_MS = 21_600_000, 10**12, 864_000_000


def _if(condition: str):
    return F.count_if(F.expr(condition))


def register(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- scans, offsets, retention ---


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The events' log on storage, written once an application: reads prune to their topic, partition and offsets."""
    return stored_once(events_log(spark, d).drop("offset"), "events-log", d, ["ts", "event_id"])


@register(f"WITH {LOG} SELECT topic, part, off, event_id FROM log WHERE topic = 'click' AND part = 1 AND off >= 10 AND off < 60")
def log_scan_range(spark, d):
    page = scan.consume(_stored(spark, d), "click", 1, offset=10, limit=50)
    return page.select("topic", F.col("partition").alias("part"), F.col("offset").alias("off"), "event_id")


@register(f"WITH {LOG} SELECT part, off, ts_ms FROM log WHERE topic = 'view' AND part = 2 AND off BETWEEN 8 AND 27")
def log_resume_from_commit(spark, d):
    page = scan.consume(_stored(spark, d), "view", 2, committed=7, limit=20)
    return page.select(F.col("partition").alias("part"), F.col("offset").alias("off"), F.unix_millis("ts").alias("ts_ms"))


@register(f"WITH {LOG} SELECT topic, part, off, to_base64(CAST(CAST(user_id AS VARCHAR) AS BLOB)) AS encode_key FROM log")
def log_base64(spark, d):
    return _stored(spark, d).select("topic", F.col("partition").alias("part"), F.col("offset").alias("off"), J.base64_text(F.col("key")).alias("encode_key"))


@register(
    f"""WITH {LOG}, c AS (SELECT topic, user_id % 3 AS grp, part, max(off) // 2 AS committed FROM log
GROUP BY ALL) SELECT c.topic, CAST(c.grp AS VARCHAR) AS grp, c.part, count(*) AS n_unread, min(log.off) AS next_off FROM log
JOIN c ON log.topic = c.topic AND log.part = c.part WHERE log.off > c.committed GROUP BY ALL"""
)
def commit_and_unread(spark, d):
    log = events_log(spark, d)
    heads = log.groupBy("topic", F.pmod("user_id", F.lit(3)).cast("string").alias("group_id"), "partition").agg(F.floor(F.max("offset") / 2).alias("h"))
    requests = heads.select("topic", "group_id", "partition", F.explode(F.array("h", F.greatest(F.col("h") - 3, F.lit(0)))).alias("offset"))  # commits that go back change nothing
    left = scan.unread(log.select("topic", "partition", "offset"), scan.commits(requests))
    return left.groupBy("topic", F.col("group_id").alias("grp"), F.col("partition").alias("part")).agg(F.count("*").alias("n_unread"), F.min("offset").alias("next_off"))


@register(f"WITH {LOG} SELECT topic, part, count(*) AS messages, CAST(0 AS BIGINT) AS gaps FROM log GROUP BY ALL")
def offset_gap_check(spark, d):
    return scan.offset_gaps(events_log(spark, d)).withColumnRenamed("partition", "part")


@register(
    """WITH h AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b
FROM events) SELECT user_id, count(*) FILTER (value < b) AS moves FROM h GROUP BY user_id"""
)
def monotonic_check(spark, d):
    return scan.backward_moves(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")


@register(f"WITH {LOG}, m AS (SELECT max(ts_ms) AS now FROM log) SELECT topic, count(*) AS n FROM log, m WHERE ts_ms >= now - {TTL_MS} GROUP BY topic")
def retention_ttl(spark, d):
    log = events_log(spark, d)
    now = log.agg(F.max("ts").alias("_now"))
    return scan.visible(log.crossJoin(F.broadcast(now)), now=F.col("_now"), ttl_ms=TTL_MS).groupBy("topic").agg(F.count("*").alias("n"))


@register(
    f"""WITH {LOG}, s AS (SELECT topic, part, off, sum(length(props)) OVER (PARTITION BY topic, part ORDER BY off DESC ROWS UNBOUNDED PRECEDING) AS held
FROM log) SELECT topic, part, count(*) AS n, min(off) AS first_off FROM s WHERE held <= 2000 GROUP BY ALL"""
)
def retention_bytes(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    log = events_log(spark, d).join(e, "event_id")
    kept = scan.retain_bytes(log, F.octet_length("props"), 2000)
    return kept.groupBy("topic", F.col("partition").alias("part")).agg(F.count("*").alias("n"), F.min("offset").alias("first_off"))


@register(
    f"""WITH {LOG}, b AS (SELECT topic, part, max(off) // 3 AS floor FROM log
GROUP BY ALL) SELECT log.topic, log.part, count(*) FILTER (off >= floor) AS kept, count(*) FILTER (off < floor) AS deleted_count,
  CAST(sum(length(CAST(user_id AS VARCHAR))) FILTER (off < floor) AS BIGINT) AS freed_bytes
FROM log JOIN b ON log.topic = b.topic AND log.part = b.part GROUP BY ALL"""
)
def delete_before(spark, d):
    log = events_log(spark, d).withColumn("value", F.lit(None).cast("binary"))
    floors = log.groupBy("topic", "partition").agg(F.floor(F.max("offset") / 3).alias("floor"))
    kept = scan.delete_before(log, floors).groupBy("topic", "partition").agg(F.count("*").alias("kept"))
    gone = scan.deleted_by(log, floors)
    return kept.join(gone, ["topic", "partition"], "left").select("topic", F.col("partition").alias("part"), "kept", F.coalesce("deleted_count", F.lit(0)).alias("deleted_count"), "freed_bytes")


@register(
    f"""WITH {LOG}, h AS (SELECT topic, part, max(off) + 1 - 100 AS low FROM log GROUP BY ALL) SELECT log.topic, log.part, count(*) AS n FROM log
JOIN h ON log.topic = h.topic AND log.part = h.part WHERE off >= low AND event_id % 7 <> 0 GROUP BY ALL"""
)
def visible_ring(spark, d):
    log = events_log(spark, d).withColumn("status", F.when(F.col("event_id") % 7 == 0, "tombstone"))
    heads = scan.visible(log.drop("status"), capacity=100).select("event_id")
    return scan.visible(log).join(heads, "event_id").groupBy("topic", F.col("partition").alias("part")).agg(F.count("*").alias("n"))


@register("SELECT event_type AS topic, CAST(1 AS INTEGER) AS part, arg_max(event_id, event_id) AS setting FROM events GROUP BY event_type")
def retention_last_write(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("topic"), F.lit(1).alias("partition"), F.lit("ttl_ms").alias("setting"), F.col("event_id").alias("value"), F.col("event_id").alias("seq"))
    return scan.retention_settings(e).select("topic", F.col("partition").alias("part"), F.col("value").alias("setting"))


# --- ingest and writes ---


@register("SELECT row_number() OVER (ORDER BY item_id) - 1 AS off, replace(text, chr(10), ' ') AS body FROM benchmark")
def ndjson_ingest(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("line_no"), F.regexp_replace("text", "\n", " ").alias("t"))
    quoted = F.when(F.col("line_no") % 2 == 0, F.regexp_extract(F.to_json(F.struct("t")), r"(?s)^\{\"t\":(.*)\}$", 1)).otherwise(F.concat("t", F.lit("\r")))
    lines = b.select("line_no", quoted.alias("value"))
    return ndjson(lines, "items", 0, F.lit(None).cast("timestamp")).select(F.col("offset").alias("off"), J.text(F.col("value")).alias("body"))


@register(
    """WITH n AS (SELECT event_id, 1000 + row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS off FROM events
WHERE event_type IN ('click', 'view')) SELECT * FROM n"""
)
def batch_produce(spark, d):
    e = table(spark, d, "events").where("event_type IN ('click', 'view')").select(F.col("event_type").alias("topic"), F.lit(0).alias("partition"), "ts", "event_id")
    heads = e.select("topic", "partition").distinct().withColumn("head", F.lit(1000))
    return append(e, ["ts", "event_id"], heads).select("event_id", F.col("offset").alias("off"))


@register("SELECT count(*) AS n, count(DISTINCT user_id) AS users, CAST(1 AS BIGINT) AS partitions_by_topic FROM events")
def partition_choice(spark, d):
    e = table(spark, d, "events")
    key = F.col("user_id").cast("string")
    per_user = e.groupBy("user_id").agg(F.countDistinct(choose_partition(key, 8)).alias("p"), F.count("*").alias("n"), F.countDistinct(choose_partition(key, 8, by_key=False)).alias("q"))
    return per_user.agg(F.sum("n").alias("n"), F.sum("p").alias("users"), F.max("q").alias("partitions_by_topic"))


@register("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def idempotent_first_wins(spark, d):
    return fold.first_wins(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role")


@register(
    f"""WITH {LOG} SELECT event_id, min(off) OVER w AS answer_offset, row_number() OVER (w ORDER BY off) > 1 AS duplicate FROM log
WINDOW w AS (PARTITION BY topic, part, user_id, k)"""
)
def idempotent_produce(spark, d):
    log = events_log(spark, d).withColumn("k", J.field(J.text(F.col("value")), "k"))
    return fold.idempotent_results(log, ["topic", "partition", "user_id", "k"], ["offset"]).select("event_id", "answer_offset", "duplicate")


@register("SELECT user_id, round(sum(value), 4) AS total, max(event_id) AS last_seq, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def upsert_balance(spark, d):
    return fold.upsert_totals(table(spark, d, "events"), ["user_id"], "value", "event_id", "event_type").withColumn("total", F.round("total", 4))


@register("""WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS gone FROM events),
a AS (SELECT *, max(CASE WHEN gone = 0 THEN event_id END) OVER w AS lastput, max(CASE WHEN gone = 1 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastdel FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, gone = 0 OR (lastput IS NOT NULL AND (lastdel IS NULL OR lastput > lastdel)) AS counts FROM a)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) FILTER (counts) AS cas, arg_max(gone, event_id) = 1 AS deleted, CASE WHEN arg_max(gone, event_id) = 1 THEN NULL ELSE arg_max(CAST(event_id AS VARCHAR), event_id) END AS value FROM e GROUP BY user_id""")
def kv_latest_cas(spark, d):
    e = table(spark, d, "events").select(F.lit("demo").alias("ns"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("event_id").cast("string").alias("value"), F.lit(None).cast("long").alias("expected_cas"), F.lit(None).cast("long").alias("ttl_ms"), F.unix_millis("ts").alias("at_ms"))
    return fold.kv_state(fold.kv_apply(e)).select("key", "cas", "deleted", "value")


# --- filters, projections, groups ---


@register(f"WITH {LOG} SELECT topic, part, off, event_id, user_id FROM log WHERE topic = 'purchase' AND value >= 50 AND k < 40")
def filter_compound(spark, d):
    q = query.Query(filters=(("event_type", "eq", "purchase"), ("amount", "ge", 50), ("k", "lt", 40)), project=("event_id", "user_id"))
    return query.run(events_log(spark, d), q).rows.select("topic", F.col("partition").alias("part"), F.col("offset").alias("off"), F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"))


@register(
    """SELECT (SELECT count(*) FROM events
WHERE coalesce(json_extract_string(props, '$.k') <> '7', false)) AS ne_present, CAST(0 AS BIGINT) AS ne_missing, (SELECT count(*) FROM events
WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 42) AS gt_text"""
)
def filter_ne_missing(spark, d):
    props = table(spark, d, "events").select(F.col("props").cast("string").alias("p"))
    return props.agg(F.count_if(J.compare(J.field(F.col("p"), "k"), "ne", 7)).alias("ne_present"), F.count_if(J.compare(J.field(F.col("p"), "nope"), "ne", 7)).alias("ne_missing"), F.count_if(J.compare(J.field(F.col("p"), "k"), "gt", "42")).alias("gt_text"))


@register(
    """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS nope, 'USD' AS currency, json_extract_string(props, '$.k') AS alias_k
FROM events WHERE event_type = 'signup'"""
)
def project_fields(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'")
    p = F.col("props")
    return e.select("event_id", J.field(p, "k").alias("k"), J.field(p, "nope").alias("nope"), J.with_default(J.field(p, "currency"), "USD").alias("currency"), J.alias_of(p, "kk", "k").alias("alias_k"))


@register("SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS body FROM events WHERE event_type = 'view'")
def project_object(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select("event_id", J.object_of(F.col("props"), ["k", "nope"]).alias("body"))


@register(
    f"""WITH {LOG} SELECT topic AS event_type, CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, 'event_type=' || topic || '|user_id=' || user_id AS group_key, round(sum(value), 2) AS total
FROM log WHERE value >= 50 GROUP BY topic, user_id"""
)
def group_count_key(spark, d):
    q = query.Query(filters=(("amount", "ge", 50),), group_by=("event_type", "user_id"), emit_rows=0, measures=(("sum", "amount", "total"),))
    return query.run(events_log(spark, d), q).aggregates.withColumn("total", F.round("total", 2))


@register(
    """SELECT event_type, CAST(NULL AS VARCHAR) AS nope, count(*) AS n, 'event_type=' || event_type || '|nope=null' AS group_key FROM events
GROUP BY event_type"""
)
def group_count_null_bucket(spark, d):
    return query.run(events_log(spark, d), query.Query(group_by=("event_type", "nope"))).aggregates


@register(
    """SELECT event_type, epoch_us(ts) // 1000 // 21600000 * 21600000 AS window_start_ms, count(*) AS n, 'event_type=' || event_type AS group_key FROM events
GROUP BY ALL"""
)
def query_tumbling(spark, d):
    return query.run(events_log(spark, d), query.Query(group_by=("event_type",), window_ms=SIX_HOURS)).aggregates


@register("SELECT 20 AS scanned, max(off) AS last_offset FROM (SELECT * FROM (WITH " + LOG + " SELECT * FROM log WHERE topic = 'click' AND part = 0) ORDER BY off LIMIT 20)")
def query_stats(spark, d):
    page = scan.consume(events_log(spark, d), "click", 0, limit=20)
    return query.run(page, query.Query()).stats.withColumn("scanned", F.col("scanned").cast("int"))


@register(
    """SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS open_large,
  coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'nope'), 0) AS none
FROM orders GROUP BY 1"""
)
def cond_counts(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), _if("o_orderstatus = 'F'").alias("done"), _if("o_orderstatus = 'O' AND o_totalprice > 100000").alias("open_large"), F.coalesce(F.expr("sum(o_totalprice) FILTER (WHERE o_orderstatus = 'nope')"), F.lit(0)).alias("none"))


@register("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(*) > 60")
def count_distinct_having(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds")).where("n > 60")


@register(
    """SELECT l_orderkey, bool_and(l_quantity >= 5) AS all_large, string_agg(CAST(l_linenumber AS VARCHAR), ','
ORDER BY l_linenumber) AS lines, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R') AS returned
FROM lineitem GROUP BY 1"""
)
def ordered_aggregates(spark, d):
    li = table(spark, d, "lineitem")
    listed = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("l_linenumber")))), lambda x: x.cast("string")), ",")
    g = li.groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") >= 5).alias("all_large"), listed(F.lit(True)).alias("lines"), F.nullif(listed(F.col("l_returnflag") == "R"), F.lit("")).alias("returned"))
    return g


@register("SELECT sum(greatest(n - 1, 0)) AS repeats, sum(abs(n - 5)) AS drift FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def nested_aggregates(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return g.agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("repeats"), F.sum(F.abs(F.col("n") - 5)).alias("drift"))


@register("SELECT le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([5, 25, 100, 250, 1000]) AS le) GROUP BY le")
def latency_histogram(spark, d):
    levels = [5, 25, 100, 250, 1000]
    row = table(spark, d, "events").agg(*[F.count_if(F.col("value") <= x).alias(f"le_{x}") for x in levels])
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"le_{x}").alias("n")) for x in levels])).alias("b")).select("b.*")


# --- joins ---


def _sides(spark, d, left="click", right="purchase"):
    e = table(spark, d, "events")
    rows = numbered(e.where(F.col("event_type").isin(left, right)), ["event_type"], "ts", ["event_id"])
    rows = rows.select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"), F.unix_millis("ts").alias("ts_ms"), "off", "event_type")
    return rows.where(F.col("event_type") == left).drop("event_type"), rows.where(F.col("event_type") == right).drop("event_type")


def _join_sql(how: str, late: int = FOREVER, more: str = "", size: int = SIX_HOURS, on: str = "l.user_id = r.user_id", columns: str = "l.event_id AS left_id, r.event_id AS right_id, l.ts_ms AS left_ms, r.ts_ms AS right_ms") -> str:
    return f"""WITH g AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k, epoch_us(ts) // 1000 AS ts_ms, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS off FROM events),
l0 AS (SELECT * FROM g WHERE event_type = 'click'), r0 AS (SELECT * FROM g WHERE event_type = 'purchase'),
w AS (SELECT greatest(least((SELECT max(ts_ms) FROM l0), (SELECT max(ts_ms) FROM r0)) - {late}, 0) AS wm),
l AS (SELECT l0.* FROM l0, w WHERE ts_ms >= greatest(wm - {size}, 0)), r AS (SELECT r0.* FROM r0, w WHERE ts_ms >= greatest(wm - {size}, 0))
SELECT {columns} FROM l {how} JOIN r ON {on} AND abs(l.ts_ms - r.ts_ms) <= {size} {more}"""


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("left_event_id").alias("left_id"), F.col("right_event_id").alias("right_id"), F.col("left_ts_ms").alias("left_ms"), F.col("right_ts_ms").alias("right_ms"))


def _window_join(how: str, keys: tuple[str, ...] = ("user_id",), late: int = FOREVER, in_order: bool = False, do=join.window_join):
    def f(spark, d):
        return _pairs(do(*_sides(spark, d), list(keys), join.WindowJoin(SIX_HOURS, late, how, in_order)))

    return f


for _how in join.HOW:
    QUERIES[f"join_{_how}_window"] = _window_join(_how)
    ORACLE[f"join_{_how}_window"] = _join_sql(_how)
QUERIES["join_composite_keys"] = _window_join("left", keys=("user_id", "k"))
ORACLE["join_composite_keys"] = _join_sql("left", on="l.user_id = r.user_id AND l.k = r.k")
QUERIES["join_in_order"] = _window_join("full", in_order=True)
ORACLE["join_in_order"] = _join_sql("full", more="AND l.off <= r.off")
QUERIES["join_lateness_prune"] = _window_join("full", late=259_200_000)
ORACLE["join_lateness_prune"] = _join_sql("full", late=259_200_000)
QUERIES["join_skew_safe"] = _window_join("inner", do=join.skew_safe_window_join)
ORACLE["join_skew_safe"] = _join_sql("inner")


@register(_join_sql("full", late=259_200_000, columns="(SELECT count(*) FROM l) AS left_scanned, (SELECT count(*) FROM r) AS right_scanned, (SELECT wm FROM w) AS watermark_ms, count(*) FILTER (l.off IS NOT NULL AND r.off IS NOT NULL) AS matched, count(*) FILTER (r.off IS NULL) AS outer_left, count(*) FILTER (l.off IS NULL) AS outer_right"))
def join_stats(spark, d):
    return join.join_stats(*_sides(spark, d), ["user_id"], join.WindowJoin(SIX_HOURS, 259_200_000, "full"))


@register("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def anti_missing_effects(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@register(
    """SELECT o_orderkey, count(l_linenumber) AS n, coalesce(max(l_quantity), 0) AS most FROM orders LEFT
JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1"""
)
def left_multi_on(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'")
    j = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n"), F.coalesce(F.max("l_quantity"), F.lit(0)).alias("most"))


@register(
    """SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT o_orderkey FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest"""
)
def cross_scalar(spark, d):
    o = table(spark, d, "orders").agg(F.count("*").alias("orders"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return o.crossJoin(table(spark, d, "customer").agg(F.count("*").alias("customers"))).select("orders", "customers", "latest")


@register("SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS last_turn, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def top1_latest(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), F.min_by("role", "turn").alias("first_role"))


# --- windows over time ---


@register("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_count(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "6 hours").start.cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("n"))


@register(
    """SELECT time_bucket(INTERVAL '6 hours', ts) - s * INTERVAL '6 hours' AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS s)
GROUP BY ALL"""
)
def sliding_count(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "12 hours", "6 hours").start.cast("timestamp_ntz").alias("window_start")).agg(F.count("*").alias("n"))


@register(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id
ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS sid FROM m) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def session_count(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


# --- state machines and repair ---

#: Every fifth event repeats the provider's id of the user's event before, and every seventh has none.
_STATES = """WITH e AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS state,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 AND prev IS NOT NULL THEN prev ELSE event_id END AS pid FROM e),
r AS (SELECT *, pid IS NOT NULL AND EXISTS (SELECT 1 FROM s b WHERE b.user_id = s.user_id AND b.pid = s.pid AND b.event_id < s.event_id) AS again FROM s),
t AS (SELECT *, arg_min(state, CASE WHEN state <> 'PROCESSING' AND NOT again THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS terminal FROM r)"""


def _payments(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "FAILED").otherwise("PROCESSING")
    rank = F.when(F.col("event_type").isin("purchase", "error"), 2).otherwise(1)
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    again = (F.col("event_id") % 5 == 0) & prev.isNotNull()
    pid = F.when(F.col("event_id") % 7 != 0, F.when(again, prev).otherwise(F.col("event_id"))).cast("string")
    return e.select(F.col("user_id").cast("string").alias("payment_id"), F.col("event_id").alias("seq"), state.alias("state"), pid.alias("provider_event_id"), rank.alias("rank"))


_DECISION = """CASE WHEN again OR terminal = state THEN 'SUPPRESSED_DUPLICATE' WHEN terminal IS NULL THEN 'APPLIED'
  WHEN state = 'PROCESSING' THEN 'IGNORED_STALE_TRANSITION' ELSE 'REJECTED_TERMINAL_CONFLICT_NEW_PAYMENT_ID_REQUIRED' END"""


@register(f"{_STATES} SELECT {_DECISION} AS decision, count(*) AS n, min(event_id) AS first_seq, count(*) FILTER (again) AS repeated FROM t GROUP BY 1")
def state_machine_terminal(spark, d):
    payments = _payments(spark, d)
    nth = F.row_number().over(Window.partitionBy("payment_id", "provider_event_id").orderBy("seq"))
    told = payments.select("payment_id", "seq", (F.col("provider_event_id").isNotNull() & (nth > 1)).alias("again"))
    decided = fold.terminal_states(payments).join(told, ["payment_id", "seq"])
    return decided.groupBy("decision").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.count_if("again").alias("repeated"))


@register(
    """WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS state
FROM events), t AS (SELECT *, arg_max(state, CASE WHEN state <> 'PROCESSING' THEN event_id END) OVER (PARTITION BY user_id
ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, count(*) OVER (PARTITION BY user_id
ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
FROM s) SELECT CASE WHEN state = 'PROCESSING' AND top IS NOT NULL THEN 'IGNORED' WHEN coalesce(top,
  CASE WHEN seen > 0 THEN 'PROCESSING' END) = state THEN 'SUPPRESSED' ELSE 'APPLIED' END AS action, count(*) AS n
FROM t GROUP BY 1"""
)
def state_machine_ranked(spark, d):
    return fold.ranked_states(_payments(spark, d)).groupBy("action").agg(F.count("*").alias("n"))


@register("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') >= 3")
def retry_dlq(spark, d):
    return fold.dead_letters(table(spark, d, "events"), ["user_id"], "event_type = 'error'")


@register(
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS repaired, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 <> 0) AS still_missing
FROM orders GROUP BY 1"""
)
def replay_repair(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "MISSING").otherwise("CONFIRMED"))
    fixed = fold.repair_missing(o, o.where("o_orderkey % 2 = 0"), ["o_orderkey"])
    return fixed.groupBy("o_orderpriority").agg(_if("repaired").alias("repaired"), _if("status = 'MISSING'").alias("still_missing"))


# --- receipts over the tables ---


@register("""WITH x AS (SELECT o_orderkey, count(l_orderkey) AS n, count(l_orderkey) FILTER (f) AS c FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_linestatus = 'F') OVER (PARTITION BY l_orderkey, l_linenumber) AS f FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CASE WHEN o_orderkey % 97 = 0 AND c = 0 THEN 'UNRESOLVED' WHEN c = n AND n > 0 THEN 'CONFIRMED' WHEN c = 0 THEN 'MISSING' ELSE 'PARTIAL' END AS status, count(*) AS n FROM x GROUP BY 1""")
def receipt_reconcile(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("effect_type"), "l_linestatus")
    observed = li.where("l_linestatus = 'F'").select("event_id", "effect_type", F.lit("confirmed").alias("status")).distinct()
    parked = o.where("event_id % 97 = 0").withColumn("status", F.lit("pending"))
    status = receipts.event_status(o, li.select("event_id", "effect_type"), observed, parked)
    return status.groupBy("status").agg(F.count("*").alias("n"))


@register(
    """WITH f AS (SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) AS missing, (SELECT count(*) FROM documents
WHERE text = '') AS invalid) SELECT id AS rule_id, name AS rule_name,
  CASE WHEN id = 'D1' THEN CASE WHEN missing = 0 THEN 'PASS' ELSE 'WARN' END ELSE CASE WHEN invalid = 0 THEN 'PASS' ELSE 'FAIL' END END AS status,
  CASE WHEN missing > 0 OR invalid > 0 THEN 'WARN' ELSE 'GREEN' END AS verdict
FROM f, (VALUES ('D1', 'rows in equal rows out'), ('D2', 'required fields are valid')) t(id, name)"""
)
def receipt_pipeline_audit(spark, d):
    docs = table(spark, d, "documents").agg(F.count("*").alias("n"), _if("text = ''").alias("invalid_rows"))
    labels = table(spark, d, "labels").agg(F.count("*").alias("m"))
    return receipts.pipeline_audit(docs.crossJoin(labels).select((F.col("n") - F.col("m")).alias("missing_rows"), "invalid_rows"))


@register(
    """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS debit, round(sum(l_extendedprice * (1 - l_discount)), 2) AS credit, abs(round(sum(l_extendedprice),
  2) - round(sum(l_extendedprice * (1 - l_discount)), 2)) < 0.005 AS balanced
FROM lineitem GROUP BY 1"""
)
def ledger_balance(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("debit"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("credit"))
    return g.withColumn("balanced", F.abs(F.col("debit") - F.col("credit")) < 0.005)


@register(
    """SELECT conv_id AS attempt_id, arg_max(role, turn) AS database_state, arg_min(role, turn) AS cache_before, arg_max(role, turn) AS cache_after, arg_max(role,
  turn) IS NOT NULL AS cache_backfilled, arg_min(role, turn) IS DISTINCT
FROM arg_max(role, turn) AS repaired FROM conversations GROUP BY conv_id"""
)
def cache_reconcile(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("attempt_id")).agg(F.max_by("role", "turn").alias("database_state"), F.min_by("role", "turn").alias("cache_before"), F.max_by("role", "turn").alias("cache_after"))
    return receipts.cache_reconciliation(c)


@register("""WITH p AS (SELECT url, replace(replace(url, ':', '%3A'), '/', '%2f') || '?q=caf%C3%A9+%25' AS escaped FROM pages)
SELECT url, escaped, url || '?q=café %' AS decoded, to_base64(CAST(url AS BLOB)) AS b64,
  upper(coalesce(nullif(split_part(url, '/', 4), ''), 'none')) AS part
FROM p WHERE instr(url, '%') = 0 AND instr(url, '+') = 0
UNION ALL
SELECT url, escaped, url_decode(replace(escaped, '+', ' ')), to_base64(CAST(url AS BLOB)), upper(coalesce(nullif(split_part(url, '/', 4), ''), 'none'))
FROM p WHERE NOT (instr(url, '%') = 0 AND instr(url, '+') = 0)""")
def scalar_functions(spark, d):
    url = F.col("url")
    escaped = F.concat(F.replace(F.replace(url, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2f")), F.lit("?q=caf%C3%A9+%25"))
    p = table(spark, d, "pages").select("url", escaped.alias("escaped"))
    part = F.upper(F.coalesce(F.nullif(F.split_part("url", F.lit("/"), F.lit(4)), F.lit("")), F.lit("none")))
    return p.select("url", "escaped", J.percent_decoded(F.col("escaped")).alias("decoded"), J.base64_text(url.cast("binary")).alias("b64"), part.alias("part"))


@register(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE 'fraction' END AS canon
FROM events"""
)
def number_text(spark, d):
    e = table(spark, d, "events")
    canon = J.canonical(F.col("value").cast("string"))
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.when(F.col("value") == F.floor("value"), canon).otherwise("fraction").alias("canon"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks joined with purchases of the same user within six hours, counted by user."""
    pairs = join.window_join(*_sides(spark, sf_dir), ["user_id"], join.WindowJoin(SIX_HOURS, FOREVER))
    return pairs.groupBy(F.col("left_user_id").alias("user_id")).agg(F.count("*").alias("n_pairs"), F.min(F.abs(F.col("left_ts_ms") - F.col("right_ts_ms"))).alias("nearest_ms"))


QUERIES["click_to_purchase"] = flagship
ORACLE["click_to_purchase"] = "SELECT user_id, count(*) AS n_pairs, min(abs(left_ms - right_ms)) AS nearest_ms FROM (" + _join_sql("inner", columns="l.user_id, l.ts_ms AS left_ms, r.ts_ms AS right_ms") + ") GROUP BY user_id"
