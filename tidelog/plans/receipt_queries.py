"""Receipts over the tables, each on inputs that are whole and on inputs that are broken, with the SQL that says the same.

Inputs are SQL that Spark and DuckDB read alike; the facts, rules and verdicts of the oracles are written out here, apart from
those of ``receipts``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import fold
from tidelog.plans import receipts
from tidelog.plans.registry import register
from tidelog.sources.tables import table

Inputs = dict[str, str]


#: Rows of its largest table that a task of a receipt has, about.
TASK_ROWS = 150_000


def _deal(spark: SparkSession, d: str, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Tables dealt by a key to as many tasks as their rows need: a shuffle's bytes, by which Spark joins its partitions, are so
    compressed that a task's rows would grow with the tables."""
    tables = {t: table(spark, d, t) for t in keys}
    rows = max((df.count() for df in tables.values()), default=0)  # from the files' footers
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))  # fewer, and joins deal anew
    return {t: df.repartition(tasks, keys[t]) for t, df in tables.items()}


def _inputs(spark: SparkSession, d: str, inputs: Inputs, dealt: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The inputs by name; one may read those before it."""
    out: dict[str, DataFrame] = dict(dealt)
    for name, sql in inputs.items():
        used = set(re.findall(r"\{(\w+)\}", sql))
        out[name] = spark.sql(sql, **{t: out[t] if t in out else table(spark, d, t) for t in used})
    return out


def _oracle(scenarios: dict[str, Inputs], facts: str, rules: dict[str, str], verdict: str, otherwise: dict[str, str] | None = None) -> str:
    """(scenario, rule_id, status, verdict): facts is a query over the inputs, rules and verdict are SQL over its columns."""
    parts = []
    for name, inputs in scenarios.items():
        tables = ", ".join(f"{t} AS ({re.sub(r'[{}]', '', sql)})" for t, sql in inputs.items())
        for rule, holds in rules.items():
            fails = (otherwise or {}).get(rule, "FAIL")
            parts.append(f"SELECT * FROM (WITH {tables}, f AS ({facts}) SELECT '{name}' AS scenario, '{rule}' AS rule_id, CASE WHEN {holds} THEN 'PASS' ELSE '{fails}' END AS status, {verdict} AS verdict FROM f)")
    return "\nUNION ALL ".join(parts)


def _receipt(name: str, scenarios: dict[str, Inputs], oracle: str, judge: Callable[[dict[str, DataFrame]], DataFrame], deal: dict[str, str] | None = None) -> None:
    """deal: a key of tables that are large; see _deal."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        dealt = _deal(spark, d, deal or {})
        judged = [judge(_inputs(spark, d, inputs, dealt)).select(F.lit(scenario).alias("scenario"), "rule_id", "status", "verdict") for scenario, inputs in scenarios.items()]
        return reduce(DataFrame.unionByName, judged)

    query.__name__ = name
    register(oracle)(query)


# --- R1: a batch of which some effects are missing ---

_KIND = "CASE WHEN l_linenumber = 1 THEN 'ledger_update' ELSE concat('line', CAST(l_linenumber AS VARCHAR(9))) END"
_BATCH = {
    "events": "SELECT DISTINCT o_orderkey AS event_id, o_custkey AS account_id, 1 AS delta FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey",
    "expected": f"SELECT DISTINCT l_orderkey AS event_id, {_KIND} AS effect_type FROM {{lineitem}}",
}
_POSTED = "SELECT account_id, count(*) AS balance FROM {events} JOIN {observed} USING (event_id) WHERE effect_type = 'ledger_update' GROUP BY account_id"
_R1 = {
    "whole": _BATCH
    | {
        "observed": "SELECT event_id, effect_type, 'confirmed' AS status FROM {expected}",
        "parked": "SELECT event_id, 'pending' AS status FROM {events} WHERE 1 = 0",
        "moves": "SELECT n_nationkey AS prev_offset, n_nationkey + 1 AS new_offset FROM {nation}",
        "balances": _POSTED,
    },
    "broken": _BATCH
    | {
        "observed": f"SELECT l_orderkey AS event_id, {_KIND} AS effect_type, 'confirmed' AS status FROM {{lineitem}} WHERE l_returnflag <> 'R'",
        "parked": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'pending' END AS status FROM {events} WHERE event_id % 7 = 0",
        "moves": "SELECT n_nationkey AS prev_offset, n_nationkey + 1 - n_regionkey AS new_offset FROM {nation}",
        "balances": "SELECT account_id, balance + CASE WHEN account_id % 10 = 0 THEN 2 ELSE 0 END AS balance FROM (" + _POSTED + ") AS p",
    },
    "parked": _BATCH
    | {
        "observed": "SELECT event_id, effect_type, 'confirmed' AS status FROM {expected} WHERE event_id % 7 <> 0",
        "parked": "SELECT event_id, 'pending' AS status FROM {events} WHERE event_id % 7 = 0",
        "moves": "SELECT n_nationkey AS prev_offset, n_nationkey AS new_offset FROM {nation}",
        "balances": _POSTED,
    },
}
_R1_FACTS = """WITH j AS (SELECT x.event_id, o.effect_type IS NULL AS lost, coalesce(o.status = 'confirmed', false) AS ok FROM expected x LEFT JOIN observed o ON x.event_id = o.event_id AND x.effect_type = o.effect_type),
s AS (SELECT event_id, count(*) AS n, count(*) FILTER (ok) AS c, count(*) FILTER (lost) AS m, (SELECT count(*) FROM parked p WHERE p.event_id = j.event_id AND p.status = 'pending') AS w FROM j GROUP BY event_id),
k AS (SELECT *, CASE WHEN w > 0 AND c = 0 THEN 'UNRESOLVED' WHEN c = n THEN 'CONFIRMED' WHEN c = 0 THEN 'MISSING' ELSE 'PARTIAL' END AS st FROM s),
b AS (SELECT a.account_id, coalesce(x.balance, 0) - coalesce(q.posted, 0) AS gap FROM (SELECT DISTINCT account_id FROM events) a LEFT JOIN balances x USING (account_id)
  LEFT JOIN (SELECT account_id, count(*) AS posted FROM events JOIN observed USING (event_id) WHERE effect_type = 'ledger_update' GROUP BY account_id) q USING (account_id))
SELECT (SELECT count(*) FROM k WHERE st = 'MISSING') AS missing, (SELECT count(*) FROM k WHERE st = 'PARTIAL') AS partial_n, (SELECT count(*) FROM k WHERE st = 'UNRESOLVED') AS unresolved,
  (SELECT coalesce(sum(m), 0) FROM k WHERE w = 0) AS lost, (SELECT count(*) FROM (SELECT 1 FROM observed GROUP BY event_id, effect_type HAVING count(*) > 1)) AS twice,
  (SELECT count(*) FROM moves WHERE new_offset < prev_offset) AS backward, (SELECT sum(abs(gap)) FROM b) AS gaps, (SELECT count(*) FROM parked WHERE status = 'pending') AS waiting"""
_receipt(
    "receipt_partial_batch",
    _R1,
    _oracle(_R1, _R1_FACTS, {"R1": "missing + partial_n = 0", "R2": "lost = 0", "R3": "twice = 0", "R4": "backward = 0", "R5": "gaps = 0"}, "CASE WHEN missing + partial_n + twice + lost > 0 THEN 'RED' WHEN unresolved + waiting > 0 THEN 'AMBER' ELSE 'GREEN' END"),
    lambda t: receipts.partial_batch(t["events"], t["expected"], t["observed"], t["parked"], t["moves"], t["balances"]),
    deal={"orders": "o_orderkey", "lineitem": "l_orderkey"},
)

# --- R2: effects exactly once ---

_EXPECTED = "SELECT event_id, user_id, CAST(user_id % 5 + 1 AS BIGINT) AS delta, row_number() OVER (ORDER BY event_id) - 1 AS off FROM {events} WHERE event_type = 'purchase'"
_R2 = {
    "whole": {
        "expected": _EXPECTED,
        "processed": "SELECT event_id, off AS msg_offset FROM {expected}",
        "balances": "SELECT user_id, sum(delta) AS balance FROM {expected} GROUP BY user_id",
        "state_offset": "SELECT max(off) AS last_offset FROM {expected}",
        "history": "SELECT off - 1 AS prev_offset, off AS new_offset FROM {expected}",
    },
    "broken": {
        "expected": _EXPECTED,
        "processed": "SELECT event_id, off AS msg_offset FROM {expected} WHERE off % 31 <> 0 UNION ALL SELECT event_id, off FROM {expected} WHERE off % 50 = 7",
        "balances": "SELECT user_id, sum(delta) + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS balance FROM {expected} GROUP BY user_id",
        "state_offset": "SELECT max(off) - 2 AS last_offset FROM {expected}",
        "history": "SELECT off - 1 AS prev_offset, CASE WHEN off % 40 = 3 THEN off - 2 ELSE off END AS new_offset FROM {expected}",
    },
    "empty": {
        "expected": _EXPECTED,
        "processed": "SELECT event_id, off AS msg_offset FROM {expected} WHERE 1 = 0",
        "balances": "SELECT user_id, delta AS balance FROM {expected} WHERE 1 = 0",
        "state_offset": "SELECT off AS last_offset FROM {expected} WHERE 1 = 0",
        "history": "SELECT off AS prev_offset, off AS new_offset FROM {expected} WHERE 1 = 0",
    },
}
_R2_FACTS = """SELECT (SELECT count(*) FROM processed) AS done, (SELECT count(DISTINCT event_id) FROM processed) AS distinct_done,
  (SELECT count(*) FROM expected x WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.event_id = x.event_id)) AS missing,
  (SELECT count(*) FROM history WHERE new_offset < prev_offset) AS backward, (SELECT coalesce(min(msg_offset), -1) FROM processed) AS low,
  (SELECT coalesce(max(msg_offset), -1) FROM processed) AS high, (SELECT coalesce(max(last_offset), -1) FROM state_offset) AS state,
  (SELECT count(*) FROM expected) AS n, (SELECT coalesce(sum(balance), 0) FROM balances) AS held, (SELECT sum(delta) FROM expected) AS due"""
_R2_RULES = {"E1": "done = distinct_done", "E2": "done = distinct_done", "E3": "missing = 0", "E4": "backward = 0", "E5": "state = high", "E6": "done = 0 OR low = 0", "E7": "state = n - 1", "E8": "held = due"}
_receipt(
    "receipt_exactly_once",
    _R2,
    _oracle(_R2, _R2_FACTS, _R2_RULES, "CASE WHEN " + " AND ".join(f"({x})" for x in _R2_RULES.values()) + " THEN 'PASS' ELSE 'FAIL' END"),
    lambda t: receipts.exactly_once(t["expected"], t["processed"], t["balances"], t["state_offset"], t["history"]),
)

# --- R3: webhooks out of order, of one payment ---

_STATE = "CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END"
_RANK = "CASE WHEN event_type IN ('purchase', 'error') THEN 2 ELSE 1 END"
_R3 = {
    "whole": {"hooks": "SELECT '1' AS payment_id, r_regionkey AS seq, CASE WHEN r_regionkey = 1 THEN 'PROCESSING' ELSE 'SUCCESS' END AS state, CASE WHEN r_regionkey = 1 THEN 1 ELSE 2 END AS rank FROM {region} WHERE r_regionkey < 3"},
    "broken": {"hooks": f"SELECT '2' AS payment_id, event_id AS seq, {_STATE} AS state, {_RANK} AS rank FROM {{events}} WHERE user_id = (SELECT min(user_id) FROM {{events}})"},
}
_R3_FACTS = """WITH a AS (SELECT *, max(rank) OVER w AS high FROM hooks WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, arg_max(state, CASE WHEN high IS NULL OR rank >= high THEN seq END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM a),
c AS (SELECT *, CASE WHEN rank < high THEN 'IGNORED' WHEN cur = state THEN 'SUPPRESSED' ELSE 'APPLIED' END AS action FROM b)
SELECT arg_max(CASE WHEN action = 'APPLIED' THEN state ELSE cur END, seq) AS final, count(*) FILTER (action = 'APPLIED' AND state = 'SUCCESS') AS wins,
  count(*) FILTER (action = 'IGNORED') AS stale, count(*) FILTER (action = 'SUPPRESSED') AS repeats, count(*) FILTER (action = 'APPLIED' AND state = 'PROCESSING' AND cur IS NOT NULL) AS lowered FROM c"""
_R3_RULES = {"W1": "final = 'SUCCESS' AND lowered = 0", "W2": "wins = 1", "W3": "stale = 1 AND repeats = 1"}
_receipt(
    "receipt_webhook_ordering",
    _R3,
    _oracle(_R3, _R3_FACTS, _R3_RULES, "CASE WHEN " + " AND ".join(f"({x})" for x in _R3_RULES.values()) + " THEN 'GREEN' ELSE 'RED' END"),
    lambda t: receipts.webhook_ordering(fold.ranked_states(t["hooks"])),
)

# --- R4: parked messages that are replayed ---


def _redrive(safety: str, status: str, failed: str) -> Inputs:
    return {
        "messages": f"SELECT o_orderkey AS message_id, {status} AS status FROM {{orders}}",
        "items": f"SELECT o_orderkey AS message_id, {safety} AS replay_safety, CASE WHEN o_orderkey % 4 = 0 THEN 'UNRESOLVED' ELSE 'REPLAYED' END AS disposition FROM {{orders}} WHERE o_orderpriority = '1-URGENT'",
        "attempts": f"SELECT o_orderkey AS message_id, CASE WHEN {failed} THEN 'FAILED' ELSE 'OK' END AS outcome FROM {{orders}} CROSS JOIN {{region}} WHERE o_orderpriority = '1-URGENT'",
    }


_R4 = {
    "whole": _redrive("'SAFE'", "'PROCESSED'", "r_regionkey < 3"),
    "review": _redrive("CASE WHEN o_orderkey % 11 = 0 THEN 'UNSAFE' ELSE 'SAFE' END", "CASE WHEN o_orderkey % 2 = 0 THEN 'PROCESSED' ELSE 'PARKED' END", "r_regionkey < 3 AND o_orderkey % 13 > 0"),
    "stuck": _redrive("'SAFE'", "'PARKED'", "r_regionkey < 2"),
}
_R4_FACTS = """SELECT (SELECT count(*) FROM items) AS n, (SELECT count(*) FROM items WHERE replay_safety <> 'SAFE') AS unsafe, (SELECT count(*) FROM items WHERE disposition = 'UNRESOLVED') AS open_n,
  (SELECT count(*) FROM messages WHERE status = 'PROCESSED') AS done, (SELECT count(*) FROM (SELECT 1 FROM attempts WHERE outcome = 'FAILED' GROUP BY message_id HAVING count(*) >= 3)) AS retried"""
_receipt(
    "receipt_dlq_redrive",
    _R4,
    _oracle(_R4, _R4_FACTS, {"D1": "done > 0", "D2": "retried >= n", "D3": "open_n <= n", "D4": "unsafe = 0"}, "CASE WHEN unsafe > 0 THEN 'YELLOW' ELSE 'GREEN' END", {"D4": "REVIEW"}),
    lambda t: receipts.dlq_redrive(t["items"], t["messages"], t["attempts"]),
)

# --- R5: a ledger posting of one attempt ---


def _clearance(entries: str, journal: str, held: str, match: str) -> Inputs:
    return {
        "one": "SELECT o_orderkey AS k, CAST(o_totalprice AS BIGINT) AS amount FROM {orders} WHERE o_orderkey = (SELECT min(o_orderkey) FROM {orders})",
        "journals": f"SELECT k AS journal_id, '{journal}' AS status FROM {{one}}",
        "entries": f"SELECT k AS journal_id, CASE WHEN r_regionkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction, amount FROM {{one}} CROSS JOIN {{region}} WHERE {entries}",
        "accounts": f"SELECT 'user_available' AS account_id, 1000000000 - amount AS balance FROM {{one}} UNION ALL SELECT 'clearance_account', {held} FROM {{one}}",
        "results": f"SELECT amount AS ledger_amount, {match} AS match_status FROM {{one}}",
    }


_R5 = {
    "whole": _clearance("r_regionkey < 2", "COMMITTED", "amount", "'MATCHED'"),
    "unmatched": _clearance("r_regionkey < 2", "COMMITTED", "amount", "'PENDING'"),
    "half": _clearance("r_regionkey = 0", "COMMITTED", "amount", "'MATCHED'"),
    "open": _clearance("r_regionkey < 2", "PENDING", "amount - 1", "'MATCHED'"),
}
_R5_FACTS = """WITH b AS (SELECT e.direction, e.amount, j.status FROM entries e JOIN journals j USING (journal_id))
SELECT (SELECT coalesce(sum(amount), 0) FROM b WHERE direction = 'DEBIT') AS debit, (SELECT coalesce(sum(amount), 0) FROM b WHERE direction = 'CREDIT') AS credit, (SELECT count(*) FROM b) AS n,
  (SELECT coalesce(bool_and(status = 'COMMITTED'), false) FROM b) AS done, (SELECT balance FROM accounts WHERE account_id = 'user_available') AS free, (SELECT balance FROM accounts WHERE account_id = 'clearance_account') AS held,
  (SELECT max(ledger_amount) FROM results) AS amount, (SELECT coalesce(max(match_status), 'MISSING') FROM results) AS bank"""
_R5_SOUND, _R5_HELD = "done AND n = 2 AND debit = credit AND debit <> 0", "held = amount AND free = 1000000000 - amount"
_receipt(
    "receipt_ledger_clearance",
    _R5,
    _oracle(
        _R5,
        _R5_FACTS,
        {"L1": "done AND n = 2", "L2": "debit = credit AND debit <> 0", "L3": "n = 2", "L4": _R5_HELD, "L5": "bank = 'MATCHED'", "L6": "bank = 'MATCHED'"},
        f"CASE WHEN NOT (({_R5_SOUND}) AND ({_R5_HELD})) THEN 'RED' WHEN bank = 'MATCHED' THEN 'GREEN' ELSE 'YELLOW' END",
    ),
    lambda t: receipts.ledger_clearance(t["entries"], t["journals"], t["accounts"], t["results"], 1_000_000_000),
)

# --- R6: a provider that doesn't answer ---


def _timeout(key: str, state: str, customer: str, reason: str, transaction: str, call: str) -> Inputs:
    return {
        "payments": f"SELECT CAST(event_id AS VARCHAR(20)) AS attempt_id, {key} AS idempotency_key, {state} AS internal_state, {customer} AS customer_state, {reason} AS ambiguity_reason, {transaction} AS provider_transaction_id FROM {{events}}",
        "calls": f"SELECT CAST(event_id AS VARCHAR(20)) AS attempt_id, 'CHARGE' AS request_type, concat('call_', CAST(event_id AS VARCHAR(20)), {call}) AS call_id FROM {{events}}",
    }


_MIXED = "CASE event_type WHEN 'purchase' THEN 'SUCCESS_CONFIRMED' WHEN 'error' THEN 'AMBIGUOUS' ELSE 'SUPPRESSED_DUPLICATE' END"
_R6 = {
    "whole": _timeout("event_id", "'SUCCESS_CONFIRMED'", "'PAID'", "'none'", "CAST(event_id AS VARCHAR(20))", "'_charge'"),
    "unknown": _timeout("event_id", _MIXED, "'PENDING'", "'provider_timeout'", "CAST(NULL AS VARCHAR(20))", "'_charge'"),
    "broken": _timeout("user_id", _MIXED, "CASE WHEN event_id % 3 = 0 THEN 'PAID' ELSE 'PENDING' END", "CASE WHEN event_id % 2 = 0 THEN 'provider_timeout' ELSE 'none' END", "CAST(NULL AS VARCHAR(20))", "CASE WHEN event_id % 10 = 0 THEN '_retry' ELSE '_charge' END"),
}
_R6_FACTS = """SELECT (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM payments WHERE internal_state = 'SUCCESS_CONFIRMED' GROUP BY idempotency_key)) AS charged,
  (SELECT count(*) FROM (SELECT 1 FROM payments WHERE internal_state <> 'SUPPRESSED_DUPLICATE' GROUP BY idempotency_key HAVING count(*) > 1)) AS shared,
  (SELECT count(*) FROM payments WHERE internal_state = 'AMBIGUOUS' AND provider_transaction_id IS NULL) AS unknown, (SELECT count(*) FROM payments WHERE internal_state = 'AMBIGUOUS' AND customer_state IN ('PAID', 'FAILED')) AS final,
  (SELECT count(*) FROM calls c JOIN payments p USING (attempt_id) WHERE p.ambiguity_reason = 'provider_timeout' AND c.request_type = 'CHARGE' AND NOT regexp_matches(c.call_id, '^call..*.charge$')) AS blind"""
_receipt(
    "receipt_provider_timeout",
    _R6,
    _oracle(_R6, _R6_FACTS, {"P1": "charged = 0", "P2": "shared = 0", "P3": "unknown = 0", "P4": "final = 0", "P5": "blind = 0"}, "CASE WHEN charged + shared + final + blind > 0 THEN 'RED' WHEN unknown > 0 THEN 'YELLOW' ELSE 'GREEN' END"),
    lambda t: receipts.provider_timeout(t["payments"], t["calls"]),
)

# --- R8: a pipeline that is recovered ---


def _recovery(status: str, critical: str, committed: str, sealed: str) -> Inputs:
    return {
        "sheets": f"SELECT page_id AS page_no, {status} AS status, {critical} AS critical FROM {{pages}}",
        "audits": f"SELECT item_id AS audit_written_at, {committed} AS offset_committed_at FROM {{benchmark}}",
        "evidence": f"SELECT true AS durable, {sealed} AS sealed, n_nationkey AS msg_offset FROM {{nation}}",
    }


_R8 = {
    "whole": _recovery("'CONFIRMED'", "page_id % 20 = 0", "item_id + 1", "true"),
    "missing": _recovery("CASE WHEN page_id % 10 = 3 THEN 'MISSING' ELSE 'CONFIRMED' END", "page_id % 20 = 0", "item_id", "true"),
    "broken": _recovery("CASE WHEN page_id % 10 = 0 THEN 'MISSING' ELSE 'CONFIRMED' END", "page_id % 20 = 0", "CASE WHEN item_id % 9 = 0 THEN NULL ELSE item_id END", "n_nationkey <> 4"),
}
_R8_FACTS = """SELECT (SELECT count(*) FROM sheets WHERE status = 'CONFIRMED') AS confirmed, (SELECT count(*) FROM sheets) AS n, (SELECT count(*) FROM sheets WHERE status = 'MISSING') AS missing,
  (SELECT count(*) FROM sheets WHERE status = 'MISSING' AND critical) AS critical, (SELECT count(*) FROM audits) AS audited,
  (SELECT bool_and(offset_committed_at IS NOT NULL AND offset_committed_at >= audit_written_at) FROM audits) AS ordered, (SELECT bool_and(durable AND sealed AND msg_offset IS NOT NULL) FROM evidence) AS replayable"""
_receipt(
    "receipt_pipeline_recovery",
    _R8,
    _oracle(_R8, _R8_FACTS, {"D1": "confirmed = n", "D2": "critical = 0", "D3": "audited > 0", "D4": "ordered", "D5": "replayable"}, "CASE WHEN critical > 0 THEN 'FAIL' WHEN missing > 0 THEN 'WARN' ELSE 'PASS' END", {"D1": "WARN"}),
    lambda t: receipts.pipeline_recovery(t["sheets"], t["audits"], t["evidence"], t["sheets"].count()),
)

# --- R9: a payment whose outcome is unknown ---


def _ambiguity(checks: str, outcome: str, duplicate: str, effects: str, committed: str, after: str) -> Inputs:
    return {
        "checks": f"SELECT event_id AS attempt_no, {_STATE} AS result FROM {{events}} WHERE {checks}",
        "calls": f"SELECT event_id AS created_at, {outcome} AS outcome FROM {{events}}",
        "requests": f"SELECT {duplicate} AS duplicate, true AS durable, true AS sealed FROM {{nation}}",
        "effects": f"SELECT n_nationkey FROM {{nation}} WHERE {effects}",
        "audits": f"SELECT item_id AS audit_written_at, {committed} AS offset_committed_at FROM {{benchmark}}",
        "cache": f"SELECT conv_id AS attempt_id, 'SUCCESS' AS database_state, 'PENDING' AS cache_before, {after} AS cache_after FROM {{conversations}}",
    }


_R9 = {
    "whole": _ambiguity("event_id = (SELECT min(event_id) FROM {events} WHERE event_type = 'purchase')", "'TIMEOUT'", "n_nationkey > 0", "n_nationkey = 1", "item_id", "'SUCCESS'"),
    "unknown": _ambiguity("1 = 0", "'TIMEOUT'", "n_nationkey > 0", "1 = 0", "item_id", "'SUCCESS'"),
    "broken": _ambiguity("event_type = 'error'", "'SUCCESS'", "n_nationkey > 1", "n_nationkey < 3", "item_id - 1", "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'SUCCESS' END"),
}
_R9_FACTS = """SELECT coalesce((SELECT arg_max(result, attempt_no) FROM checks), (SELECT arg_max(outcome, created_at) FROM calls)) AS outcome,
  (SELECT coalesce(bool_and(durable AND sealed), false) FROM requests WHERE NOT duplicate) AS durable, (SELECT count(*) FROM requests WHERE NOT duplicate) AS logical, (SELECT count(*) FROM effects) AS credits,
  (SELECT bool_and(offset_committed_at IS NOT NULL AND offset_committed_at >= audit_written_at) FROM audits) AS ordered, (SELECT bool_and(coalesce(cache_after = database_state, false)) FROM cache) AS filled"""
_receipt(
    "receipt_payment_ambiguity",
    _R9,
    _oracle(
        _R9,
        _R9_FACTS,
        {"P1": "durable", "P2": "ordered", "P3": "credits <= 1", "P4": "filled", "P5": "logical = 1", "P6": "outcome = 'SUCCESS'"},
        "CASE WHEN outcome = 'SUCCESS' AND filled AND credits <= 1 THEN 'GREEN' ELSE 'YELLOW' END",
        {"P6": "PENDING"},
    ),
    lambda t: receipts.payment_ambiguity(t["checks"], t["calls"], t["requests"], t["effects"], t["audits"], t["cache"]),
)

# --- R10: terminal states, of one payment ---


def _terminal(hooks: str, effects: str, gap: str) -> Inputs:
    return {"hooks": hooks, "effects": f"SELECT n_nationkey FROM {{nation}} WHERE {effects}", "evidence": f"SELECT n_nationkey AS msg_offset, true AS durable, {gap} AS gap FROM {{nation}}"}


_STEPS = "CASE r_regionkey WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'SUCCESS' ELSE 'FAILED' END"
_R10 = {
    "whole": _terminal(f"SELECT '1' AS payment_id, r_regionkey AS seq, {_STEPS} AS state, CAST(r_regionkey AS VARCHAR(9)) AS provider_event_id, true AS committed FROM {{region}}", "n_nationkey = 3", "false"),
    "uncommitted": _terminal(f"SELECT '1' AS payment_id, r_regionkey AS seq, {_STEPS} AS state, CAST(NULL AS VARCHAR(9)) AS provider_event_id, r_regionkey <> 2 AS committed FROM {{region}}", "n_nationkey = 3", "false"),
    "broken": _terminal("SELECT '2' AS payment_id, event_id AS seq, 'PROCESSING' AS state, CAST(event_id AS VARCHAR(20)) AS provider_event_id, true AS committed FROM {events} WHERE user_id = (SELECT min(user_id) FROM {events})", "n_nationkey < 2", "n_nationkey = 9"),
}
_R10_FACTS = """WITH d AS (SELECT *, provider_event_id IS NOT NULL AND row_number() OVER (PARTITION BY provider_event_id ORDER BY seq) > 1 AS again FROM hooks),
t AS (SELECT *, arg_min(state, CASE WHEN state <> 'PROCESSING' AND NOT again THEN seq END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM d)
SELECT arg_max(coalesce(ended, state), seq) AS final, (SELECT count(*) FROM effects) AS wins, bool_and(committed) AS committed, (SELECT bool_and(durable) AND count(*) FILTER (gap) = 0 FROM evidence) AS replayable FROM t"""
_receipt(
    "receipt_terminal_ordering",
    _R10,
    _oracle(_R10, _R10_FACTS, {"W1": "final IN ('SUCCESS', 'FAILED')", "W2": "true", "W3": "wins = 1", "W4": "true"}, "CASE WHEN final IN ('SUCCESS', 'FAILED') AND wins = 1 AND committed AND replayable THEN 'GREEN' ELSE 'RED' END"),
    lambda t: receipts.terminal_ordering(fold.terminal_states(t["hooks"]).join(t["hooks"].select("payment_id", "seq", "committed"), ["payment_id", "seq"]), t["effects"], t["evidence"]),
)
