"""Log queries against DuckDB, and folds and receipts on small inputs."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.functions import fields as J
from tidelog.operators import fold, scan
from tidelog.plans import catalog, receipt_queries, receipts

SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    number = lambda v: plain(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else plain(v)
    return sorted(tuple(number(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_unknown_operator_is_an_error(spark):
    with pytest.raises(ValueError):
        J.compare(F.lit("1"), "like", 1)


def test_start_offset_names_the_last_processed():
    assert scan.start_offset(None, 3) == 4 and scan.start_offset(-1, 3) == 0 and scan.start_offset(None, None) == 0


def test_kv_compare_and_set(spark):
    c = spark.createDataFrame([("d", "k", 1, "put", "v1", None, None, 0), ("d", "k", 2, "put", "v2", 7, None, 1), ("d", "k", 3, "put", "v2", 1, 200, 2), ("d", "k", 4, "delete", None, None, None, 500), ("d", "k", 5, "put", "v3", 2, None, 501)], "ns string, key string, seq long, op string, value string, expected_cas long, ttl_ms long, at_ms long")
    got = [(r.ok, r.reason, r.cas) for r in fold.kv_apply(c).orderBy("seq").collect()]
    assert got == [(True, "ok", 1), (False, "cas_mismatch", 1), (True, "ok", 2), (False, "not_found", 2), (True, "ok", 3)]


def test_ranked_and_terminal_states(spark):
    e = spark.createDataFrame([("p", 1, "SUCCESS", 2, "a"), ("p", 2, "PROCESSING", 1, "b"), ("p", 3, "SUCCESS", 2, "c"), ("p", 4, "FAILED", 2, "d")], "payment_id string, seq long, state string, rank int, provider_event_id string")
    ranked = fold.ranked_states(e.where("seq < 4"))
    assert [r.action for r in ranked.orderBy("seq").collect()] == ["APPLIED", "IGNORED", "SUPPRESSED"]
    assert {r.verdict for r in receipts.webhook_ordering(ranked).collect()} == {"GREEN"}
    decisions = [r.decision for r in fold.terminal_states(e).orderBy("seq").collect()]
    assert decisions == ["APPLIED", "IGNORED_STALE_TRANSITION", "SUPPRESSED_DUPLICATE", "REJECTED_TERMINAL_CONFLICT_NEW_PAYMENT_ID_REQUIRED"]


def test_partial_batch_is_red(spark):
    events = spark.createDataFrame([(f"e{i}", "a", 1) for i in range(10)], "event_id string, account_id string, delta long")
    kinds = ["ledger_update", "order_state_updated", "notification_sent"]
    expected = events.select("event_id", F.explode(F.array(*map(F.lit, kinds))).alias("effect_type"))
    observed = expected.where("NOT (event_id = 'e9' OR (event_id = 'e8' AND effect_type = 'notification_sent'))").withColumn("status", F.lit("confirmed"))
    none = spark.createDataFrame([], "event_id string, status string")
    moves = spark.createDataFrame([(0, 1)], "prev_offset long, new_offset long")
    balances = spark.createDataFrame([("a", 9)], "account_id string, balance long")
    got = receipts.partial_batch(events, expected, observed, none, moves, balances).collect()
    assert {r.verdict for r in got} == {"RED"} and {r.rule_id: r.status for r in got}["R5"] == "PASS"


def test_event_status_of_repeats_and_nulls(spark):
    events = [(1,), (1,), (2,), (3,), (4,), (5,), (None,)]
    expected = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, None), (3, "a"), (None, "a"), (6, "a"), (4, "a")]
    observed = [(1, "a", "confirmed"), (1, "a", "confirmed"), (1, "a", "failed"), (1, "z", "confirmed"), (2, "a", "confirmed"), (2, None, "confirmed"), (None, "a", "confirmed"), (4, "a", None)]
    parked = [(3, "pending"), (3, "pending"), (2, "done"), (None, "pending"), (7, "pending")]
    want = Counter()
    for (e,) in events:
        mine = [x for x in expected if x[0] == e and e is not None]
        met = [(o[2] if o else None, o) for x in mine for o in [o for o in observed if o[0] == x[0] and o[1] == x[1] and x[1] is not None] or [None]]
        n, c, m = len(met), sum(s == "confirmed" for s, _ in met), sum(o is None for _, o in met)
        w = sum(p == (e, "pending") for p in parked if e is not None)
        want[e, n, c, m, w, "UNRESOLVED" if w and not c else "CONFIRMED" if c == n > 0 else "MISSING" if not c else "PARTIAL"] += 1
    frames = [spark.createDataFrame(rows, ddl) for rows, ddl in ((events, "event_id long"), (expected, "event_id long, effect_type string"), (observed, "event_id long, effect_type string, status string"), (parked, "event_id long, status string"))]
    assert Counter(map(tuple, receipts.event_status(*frames).collect())) == want


@pytest.mark.parametrize(("task_rows", "broadcast"), [(100, "-1"), (100, "10m"), (10**9, "-1"), (10**9, "10m")])
def test_tasks_of_a_batch_receipt_follow_its_rows(spark, monkeypatch, task_rows, broadcast):
    monkeypatch.setattr(receipt_queries, "TASK_ROWS", task_rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plan = catalog.QUERIES["receipt_partial_batch"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))
    dealt = {(key, int(n)) for key, n in re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert dealt == {("l_orderkey", tasks), ("o_orderkey", tasks)}
    again = re.findall(r"hashpartitioning\((\w+)#.*ENSURE_REQUIREMENTS", plan)
    assert set(again) <= {"account_id"}
