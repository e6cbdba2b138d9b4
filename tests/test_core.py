"""Log operators on small inputs: golden cases, edges, plans, replay, effects and streams."""

import base64
import json
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import fields as J
from tidelog.operators import fold, join, query, scan
from tidelog.plans import catalog, receipts, registry
from tidelog.sources import log, stored
from tidelog.streaming import effects, streams

SF = "/root/testdata/sf0.001"


def messages(spark, values, start=0):
    """(off, ts_ms, value) of (ts_ms, object) pairs."""
    rows = [(start + i, ts, json.dumps(v).encode() if not isinstance(v, bytes) else v) for i, (ts, v) in enumerate(values)]
    return spark.createDataFrame(rows, "off long, ts_ms long, value binary")


def envelope(spark, values):
    rows = [("t", 0, i, json.dumps(v).encode() if not isinstance(v, bytes) else v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, partition int, offset long, value binary").withColumn("ts", F.timestamp_millis(F.col("offset")))


# --- fields ---


def test_fields_tell_text_from_nested_values(spark):
    v = json.dumps({"a.b": "dot", "s": "{not an object", "l": "[x", "o": {"k": 1}, "list": [1], "n": 7, "f": 1.50, "t": True, "z": None, "a": {"b": "inner"}})
    d = spark.createDataFrame([(v,)], "v string")
    got = d.select(*[J.field(F.col("v"), n).alias(n.replace(".", "_")) for n in ("a.b", "s", "l", "o", "list", "n", "t", "z", "none")]).first()
    assert tuple(got) == ("dot", "{not an object", "[x", None, None, "7", "true", None, None)
    with pytest.raises(ValueError):
        J.field(F.col("v"), "it's")


def test_crc32c(spark):
    def plain(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    data = [b"123456789", b"", b"\x00" * 32, bytes(range(256)) * 20]
    got = [r.c for r in spark.createDataFrame([(x,) for x in [*data, None]], "d binary").select(J.crc32c(F.col("d")).alias("c")).collect()]
    assert got == [*map(plain, data), None] and got[0] == 0xE3069283


def test_percent_decoding(spark):
    texts = ["a%20b+c", "caf%C3%A9", "100%", "%zz", "", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(J.percent_decoded(F.col("t")).alias("x")).collect()]
    assert got == ["a b c", "café", "100%", "%zz", "", None]


def test_base64_is_one_line(spark):
    data = [b"", b"x" * 57, b"x" * 58, bytes(range(256)) * 3]
    got = [r.x for r in spark.createDataFrame([(x,) for x in [*data, None]], "d binary").select(J.base64_text(F.col("d")).alias("x")).collect()]
    assert got == [*(base64.b64encode(x).decode() for x in data), None]


def test_scalar_functions_of_long_urls(spark, tmp_path):
    url = "https://www.example.org/en/" + "long/" * 20
    spark.createDataFrame([(url,), ("http://a/b",)], "url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.url: r.b64 for r in registry.scalar_functions(spark, str(tmp_path)).collect()}
    assert got == {u: base64.b64encode(u.encode()).decode() for u in (url, "http://a/b")}


# --- queries over messages ---


def test_query_rows_whole_values_and_caps(spark):
    people = [{"name": "Ann", "team": "A", "score": 95}, {"name": "Bob", "team": "A", "score": 80}, {"name": "Cat", "team": "B", "score": 99}, {"name": "Dan", "team": "A", "score": "90"}, b"not json", b"[1]"]
    d = envelope(spark, people)
    hits = query.run(d, query.Query(filters=(("team", "eq", "A"), ("score", "ge", 90)), project=("name",)))
    assert [r.name for r in hits.rows.orderBy("offset").collect()] == ["Ann", "Dan"]
    capped = query.run(d, query.Query(filters=(("team", "eq", "A"),), group_by=("team",), emit_rows=1))
    assert [json.loads(r.value)["name"] for r in capped.rows.collect()] == ["Ann"] and [r.n for r in capped.aggregates.collect()] == [3]
    assert capped.stats.first().scanned == 4


# --- joins ---


def test_composite_full_join_of_messages(spark):
    left = messages(spark, [(1000, {"id": 1, "city": "NY", "name": "Ann"}), (1000, {"id": 2, "city": "LA", "name": "Bob"})])
    right = messages(spark, [(1005, {"uid": "1.0", "town": "NY", "item": "pen"}), (1005, {"uid": 3, "town": "SF", "item": "pad"})])
    keys = [("id", "uid"), ("city", "town")]
    out = join.messages_join(left, right, keys, join.WindowJoin(how="full"), left_fields=("name",), right_fields=("item", "nope"))
    assert {(r.left, r.right) for r in out.collect()} == {('{"name":"Ann"}', '{"item":"pen"}'), ('{"name":"Bob"}', None), (None, '{"item":"pad"}')}
    bare = join.messages_join(left, right, keys, join.WindowJoin(how="left"), missing_as="{}")
    assert sorted((r.left_off, r.left, r.right) for r in bare.collect()) == [(0, "{}", "{}"), (1, "{}", "{}")]
    with pytest.raises(ValueError):
        join.messages_join(left, right, keys, join.WindowJoin(), missing_as="none")


def test_keys_agree_as_text_and_missing_ones_take_no_part(spark):
    left = messages(spark, [(0, {"k": 1}), (0, {"k": "1"}), (0, {"k": 1.0}), (0, {"k": True}), (0, {"k": None}), (0, {}), (0, {"k": {"x": 1}}), (0, b"text")])
    right = messages(spark, [(0, {"k": "1.00"}), (0, {"k": "true"}), (0, {"j": 1})])
    out = join.messages_join(left, right, [("k", "k")], join.WindowJoin(how="full"))
    assert sorted((r.left_off, r.right_off) for r in out.collect()) == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_first_of_repeated_fields_counts_in_joins(spark):
    left = messages(spark, [(0, b'{"k":1,"k":2,"s":"a","s":"b"}'), (0, b'{"k":{"x":1},"k":2}'), (0, b'{"k":2')])
    right = messages(spark, [(0, {"k": 1}), (0, {"k": 2})])
    out = join.messages_join(left, right, [("k", "k")], join.WindowJoin(how="full"), left_fields=("s", "none", "k"))
    assert sorted(map(tuple, out.collect()), key=str) == [(0, 0, '{"s":"a","k":"1"}', "{}"), (None, 1, None, "{}")]


@pytest.mark.parametrize("name", ["join_text_keys", "join_capped"])
def test_joins_read_a_field_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    reading = [line for line in plan.splitlines() if "get_json_object(value" in line]
    assert reading and all("Generate inline" in line for line in reading)


def test_numbers_of_minutes_follow_each_other(spark):
    stamp = F.timestamp_millis(F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 400_000 - 200_000))
    d = spark.range(3000).select("id", (F.col("id") % 3).alias("k"), stamp.alias("ts"))
    plain = d.withColumn("off", (F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")) - 1).cast("long"))
    got = log.numbered(d, ["k"], "ts", ["id"]).select(*plain.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", ["join_text_keys", "join_capped", "join_full_window", "join_in_order"])
def test_joins_number_no_whole_type_in_a_task(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    ranked = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*?), specifiedwindowframe", plan)
    assert all("_slice" in w for w in ranked) and (ranked or name == "join_full_window")


def test_window_and_order_decide_pairs(spark):
    left = messages(spark, [(0, {"id": 8}), (180, {"id": 9})])
    right = messages(spark, [(180, {"id": 9}), (180, {"id": 8})])
    count = lambda **o: join.messages_join(left, right, [("id", "id")], join.WindowJoin(**o)).count()
    assert count(size_ms=50) == 1 and count(size_ms=180) == 2 and count(size_ms=179) == 1
    assert [tuple(r)[:2] for r in join.messages_join(left, right, [("id", "id")], join.WindowJoin(in_order=True)).collect()] == [(0, 1)]
    outer = join.messages_join(left, right, [("id", "id")], join.WindowJoin(how="left", in_order=True), missing_as="{}", max_rows=5).collect()
    assert [(r.left_off, r.right_off, r.right) for r in outer] == [(0, 1, "{}"), (1, None, "{}")]


@pytest.mark.parametrize("how", join.HOW)
def test_skew_safe_join_equals_the_plain_one(spark, how):
    left, right = registry._sides(spark, SF)
    hot = lambda side: side.withColumn("user_id", F.when(F.col("event_id") % 3 > 0, 1).otherwise(F.col("user_id"))).unionByName(side.limit(9))
    spec = join.WindowJoin(3_600_000 * 24, 259_200_000, how, in_order=True)
    both = [sorted(map(str, do(hot(left), hot(right), ["user_id"], spec).drop("left_k", "right_k").collect())) for do in (join.window_join, join.skew_safe_window_join)]
    assert both[0] == both[1] and len(both[0]) > 20


# --- the stored log, ndjson, replay ---


def test_stored_log_numbers_and_prunes(spark, tmp_path):
    events = log.events_log(spark, SF)
    out = stored.write_log(events.drop("offset"), f"file://{tmp_path}/log", ["ts", "event_id"])
    want = {(r.event_id, r.offset) for r in events.collect()}
    assert {(r.event_id, r.offset) for r in out.collect()} == want
    page = scan.consume(out, "click", 1, offset=10, limit=50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(offset,10)" in plan and "PartitionFilters: [isnotnull(topic" in plan


def test_read_ndjson(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('"alpha"\r\n\n{"x": 1}\n00ff\n"q\\"uote"\n')
    got = log.read_ndjson(spark, f"file://{tmp_path}/a.ndjson", "t", 0, F.lit(None).cast("timestamp")).orderBy("offset").collect()
    assert [(r.offset, r.value.decode()) for r in got] == [(0, "alpha"), (1, '{"x": 1}'), (2, "00ff"), (3, 'q"uote')]


def test_replay_rebuilds_state_and_skips_bad_records(spark, tmp_path):
    rows = [
        (1, "message", "t", 0, None, "k0", b"m0", 0),
        (2, "message", "t", 0, None, "k1", b"m1", 1),
        (3, "message", "t", 0, None, None, b"m2", 2),
        (4, "truncate", "t", 0, None, None, None, 1),
        (5, "commit", "t", 0, "g", None, None, 2),
        (6, "commit", "t", 0, "g", None, None, 1),
        (7, "idempotency", "t", 0, None, "id", None, 1),
        (8, "idempotency", "t", 0, None, "id", None, 2),
        (9, "kv_put", "ns", 0, None, "a", b"1", None),
        (10, "kv_delete", "ns", 0, None, "a", None, None),
        (11, "kv_put", "ns", 0, None, "b", b"2", None),
        (12, "message", "t", 0, None, "k3", b"spoilt", 3),
    ]
    d = spark.createDataFrame(rows, "seq long, kind string, topic string, partition int, group_id string, key string, value binary, number long")
    crc = J.crc32c(F.coalesce("value", F.lit(b"")))
    d.withColumn("crc", F.when(F.col("seq") < 12, crc).otherwise(crc + 1)).write.parquet(f"{tmp_path}/sealed")
    r = stored.replay(spark, f"{tmp_path}/sealed")
    assert sorted((m.offset, bytes(m.value)) for m in r["messages"].collect()) == [(1, b"m1"), (2, b"m2")]
    assert [c.committed for c in r["commits"].collect()] == [2] and [i.answer_offset for i in r["idempotency"].collect()] == [1]
    assert sorted((k.key, k.value and bytes(k.value), k.cas, k.deleted) for k in r["kv"].collect()) == [("a", None, 2, True), ("b", b"2", 1, False)]
    assert r["skipped"].first().n == 1


# --- state machines and effects ---


def test_null_event_ids_repeat_nothing(spark):
    e = spark.createDataFrame([("p", 1, "PROCESSING", None), ("p", 2, "SUCCESS", None), ("p", 3, "FAILED", None), ("q", 1, "PROCESSING", "a"), ("q", 2, "SUCCESS", "a"), ("q", 3, "SUCCESS", "b")], "payment_id string, seq long, state string, provider_event_id string")
    got = [(r.payment_id, r.decision, r.after) for r in fold.terminal_states(e).orderBy("payment_id", "seq").collect()]
    assert got == [("p", "APPLIED", "PROCESSING"), ("p", "APPLIED", "SUCCESS"), ("p", fold.CONFLICT, "SUCCESS"), ("q", "APPLIED", "PROCESSING"), ("q", "SUPPRESSED_DUPLICATE", "PROCESSING"), ("q", "APPLIED", "SUCCESS")]


def test_effects_happen_once(spark, tmp_path):
    store = effects.EffectStore(spark, f"file://{tmp_path}/store")
    batch = lambda rows: spark.createDataFrame(rows, "event_id string, account_id string, delta long, msg_offset long")
    first, second = batch([("a", "x", 5, 0), ("b", "y", 1, 1), ("a", "x", 5, 2)]), batch([("b", "y", 1, 3), ("c", "x", 2, 4)])
    assert store.apply(first, 0) and not store.apply(first, 0)
    # A lost attempt leaves files but no marker: nobody sees them, and the next attempt replaces them.
    store._write(second, "processed", 1)
    assert store.table("processed").count() == 2
    assert store.apply(second, 1) and not store.apply(second, 1)
    assert {(r.account_id, r.balance) for r in store.balances().collect()} == {("x", 7), ("y", 1)}
    assert sorted(r.event_id for r in store.table("processed").collect()) == ["a", "b", "c"] and store.state().first().last_offset == 4
    assert [(r.prev_offset, r.new_offset) for r in store.table("history").orderBy("seq").collect()] == [(-1, 2), (2, 4)]


def test_stream_into_a_store_passes_the_receipt(spark, tmp_path):
    schema = "event_id string, account_id string, delta long, msg_offset long"
    rows = [(f"e{i}", f"a{i % 3}", 1 + i % 5, i) for i in range(40)]
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = effects.EffectStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # the second run finds nothing new
        stream = streams.follow(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_trigger=1)
        effects.consume_into(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    expected = spark.createDataFrame(rows, schema)
    got = receipts.exactly_once(expected, store.table("processed"), store.balances(), store.state(), store.table("history")).collect()
    assert {r.verdict for r in got} == {"PASS"} and len(store.committed()) == 4


# --- streams ---


def _run(stream, name, tmp_path, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name).collect()


def _timed(spark, tmp_path, name, rows, schema):
    df = spark.createDataFrame(rows, f"s long, {schema}").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return streams.follow(spark, f"{tmp_path}/{name}", df.schema)


def test_streams_join_within_a_window(spark, tmp_path):
    a = _timed(spark, tmp_path, "l", [(10, "k", 1), (500, "k", 2), (20, "j", 3), (9000, "z", 9)], "key string, left_id long")
    b = _timed(spark, tmp_path, "r", [(12, "k", 7), (505, "k", 8), (400, "j", 5), (9000, "y", 6)], "key string, right_id long")
    got = _run(streams.window_join_stream(a, b, "key", 10_000, "1 minute"), "joined", tmp_path)
    assert sorted((r.left_id, r.right_id) for r in got) == [(1, 7), (2, 8)]


def test_first_of_a_key_counts_in_a_stream(spark, tmp_path):
    s = _timed(spark, tmp_path, "d", [(10, "a"), (11, "a"), (12, "b"), (13, "a")], "event_id string")
    assert sorted(r.event_id for r in _run(streams.first_seen(s, ["event_id"], "1 hour"), "first", tmp_path)) == ["a", "b"]


def test_sink_reads_only_the_partitions_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("a", 1, 1), ("c", 2, 3)], "event_id string, day int, v int")
    rows.write.parquet(f"{tmp_path}/in")
    for run in range(2):
        streams.exactly_once_sink(streams.follow(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", f"{tmp_path}/c{run}", ["event_id"], within="day").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.event_id, r.day) for r in got.collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_terminal_stream_forgets(spark, tmp_path):
    schema = "payment_id string, seq long, state string, provider_event_id string"
    s = _timed(spark, tmp_path, "p", [(1, "p", 1, "PROCESSING", "x\x1fy"), (2, "p", 2, "SUCCESS", None), (3, "p", 3, "SUCCESS", None), (4, "p", 4, "FAILED", "x")], schema)
    got = {(r.seq, r.after, r.decision) for r in _run(streams.terminal_states_stream(s, forget="1 hour"), "terminals", tmp_path)}
    assert got == {(1, "PROCESSING", "APPLIED"), (2, "SUCCESS", "APPLIED"), (3, "SUCCESS", "SUPPRESSED_DUPLICATE"), (4, "SUCCESS", fold.CONFLICT)}
