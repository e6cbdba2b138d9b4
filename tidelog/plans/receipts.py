"""Reconciliation receipts: what was expected against what was observed, as rule rows and one verdict.

A receipt is a one-row table of facts, rules over its columns, and a ladder of verdicts of which the first that holds
counts. Facts come from aggregates, so a receipt's driver-side size doesn't depend on its tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    holds: str
    otherwise: str = "FAIL"


def judge(facts: DataFrame, rules: list[Rule], ladder: list[tuple[str, str]], default: str) -> DataFrame:
    """(rule_id, rule_name, status, verdict), a row for each rule. Conditions are SQL over the facts."""
    verdict: Column = F.lit(default)
    for condition, name in reversed(ladder):
        verdict = F.when(F.expr(condition), name).otherwise(verdict)
    rows = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.when(F.expr(r.holds), "PASS").otherwise(r.otherwise).alias("status")) for r in rules])
    return facts.withColumn("verdict", verdict).select(F.explode(rows).alias("r"), "verdict").select("r.*", "verdict")


def _one(df: DataFrame, **facts: str) -> DataFrame:
    return df.agg(*[F.expr(sql).alias(name) for name, sql in facts.items()])


def _beside(*parts: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def _by_event(events: DataFrame, expected: DataFrame, observed: DataFrame, parked: DataFrame) -> DataFrame:
    """(event_id, events_n, expected_n, confirmed_n, missing_n, parked_n, repeated_n, status), a row for each event id of any.

    An expected effect counts once for each observation of it, once if there is none. repeated_n: effects observed twice or
    more. The four tables are grouped as one, without joins; tables that are dealt alike by event_id aren't dealt anew.
    """
    effect = expected.schema["effect_type"].dataType
    none, confirmed = F.lit(None).cast(effect).alias("effect_type"), F.when(F.col("status") == "confirmed", 2).otherwise(1)
    parts = [
        expected.select("event_id", "effect_type", F.lit(0).alias("tag")),
        observed.select("event_id", "effect_type", confirmed.alias("tag")),
        events.select("event_id", none, F.lit(3).alias("tag")),
        parked.where("status = 'pending'").select("event_id", none, F.lit(4).alias("tag")),
    ]
    count = lambda condition: F.count_if(F.expr(condition))
    effects = reduce(DataFrame.unionAll, parts).groupBy("event_id", "effect_type").agg(count("tag = 0").alias("x"), count("tag IN (1, 2)").alias("o"), count("tag = 2").alias("c"), count("tag = 3").alias("e"), count("tag = 4").alias("w"))
    known = F.col("event_id").isNotNull() & F.col("effect_type").isNotNull()  # what is null agrees with nothing
    effects = effects.withColumns({"met": F.when(known, F.col("o")).otherwise(0), "ok": F.when(known, F.col("c")).otherwise(0)})
    sums = {"events_n": "e", "expected_n": "x * greatest(met, 1)", "confirmed_n": "x * ok", "missing_n": "CASE WHEN met = 0 THEN x ELSE 0 END", "parked_n": "w"}
    out = effects.groupBy("event_id").agg(*[F.sum(F.expr(sql)).alias(name) for name, sql in sums.items()], count("o > 1").alias("repeated_n"))
    out = out.withColumns({n: F.when(F.col("event_id").isNotNull(), F.col(n)).otherwise(0) for n in ("expected_n", "confirmed_n", "missing_n", "parked_n")})
    status = F.when((F.col("parked_n") > 0) & (F.col("confirmed_n") == 0), "UNRESOLVED").when((F.col("confirmed_n") == F.col("expected_n")) & (F.col("expected_n") > 0), "CONFIRMED").when(F.col("confirmed_n") == 0, "MISSING").otherwise("PARTIAL")
    return out.withColumn("status", status)


def event_status(events: DataFrame, expected: DataFrame, observed: DataFrame, parked: DataFrame) -> DataFrame:
    """Each expected event's effects counted and named: (event_id, expected_n, confirmed_n, missing_n, parked_n, status)."""
    told = _by_event(events, expected, observed, parked).where("events_n > 0")
    each = told.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("events_n"))))
    return each.select("event_id", "expected_n", "confirmed_n", "missing_n", "parked_n", "status")


def partial_batch(events: DataFrame, expected: DataFrame, observed: DataFrame, parked: DataFrame, moves: DataFrame, balances: DataFrame) -> DataFrame:
    """R1. balances: (account_id, balance); events: (event_id, account_id, delta); moves: (prev_offset, new_offset)."""
    ledger = observed.where("effect_type = 'ledger_update'").groupBy("event_id").agg(F.count("*").alias("n"))
    posted = F.when(F.col("account_id").isNotNull(), F.sum("n")).alias("posted")
    accounts = events.select("event_id", "account_id").join(ledger, "event_id", "left").groupBy("account_id").agg(posted).join(balances, "account_id", "left")
    facts = _beside(
        _one(
            _by_event(events, expected, observed, parked),
            missing="coalesce(sum(events_n) FILTER (WHERE status = 'MISSING'), 0)",
            partial="coalesce(sum(events_n) FILTER (WHERE status = 'PARTIAL'), 0)",
            unresolved="coalesce(sum(events_n) FILTER (WHERE status = 'UNRESOLVED'), 0)",
            missing_effects="coalesce(sum(CASE WHEN parked_n = 0 THEN events_n * missing_n ELSE 0 END), 0)",
            duplicated="coalesce(sum(repeated_n), 0)",
        ),
        _one(moves, backward="count_if(new_offset < prev_offset)"),
        _one(accounts, unexplained="coalesce(sum(abs(coalesce(balance, 0) - coalesce(posted, 0))), 0)"),
        _one(parked, waiting="count_if(status = 'pending')"),
    )
    rules = [
        Rule("R1", "all events complete", "missing = 0 AND partial = 0"),
        Rule("R2", "all effects observed", "missing_effects = 0"),
        Rule("R3", "no effect twice", "duplicated = 0"),
        Rule("R4", "offsets only advance", "backward = 0"),
        Rule("R5", "balances equal posted effects", "unexplained = 0"),
    ]
    return judge(facts, rules, [("missing > 0 OR partial > 0 OR duplicated > 0 OR missing_effects > 0", "RED"), ("unresolved > 0 OR waiting > 0", "AMBER")], "GREEN")


def exactly_once(expected: DataFrame, processed: DataFrame, balances: DataFrame, state_offset: DataFrame, history: DataFrame) -> DataFrame:
    """R2. state_offset: (last_offset), a row at most."""
    missing = expected.join(processed, "event_id", "left_anti")
    facts = _beside(
        _one(expected, expected_n="count(*)", expected_sum="coalesce(sum(delta), 0)"),
        _one(processed, done="count(*)", distinct_done="count(DISTINCT event_id)", low="coalesce(min(msg_offset), -1)", high="coalesce(max(msg_offset), -1)"),
        _one(processed.groupBy("event_id").count(), twice="count_if(count > 1)"),
        _one(missing, missing="count(*)"),
        _one(history, backward="count_if(new_offset < prev_offset)"),
        _one(state_offset, state="coalesce(max(last_offset), -1)"),
        _one(balances, balance="coalesce(sum(balance), 0)"),
    )
    rules = [
        Rule("E1", "effects are distinct", "done = distinct_done"),
        Rule("E2", "no event twice", "twice = 0"),
        Rule("E3", "no event missing", "missing = 0"),
        Rule("E4", "offsets only advance", "backward = 0"),
        Rule("E5", "state is at the last effect", "state = high"),
        Rule("E6", "effects begin at offset 0", "done = 0 OR low = 0"),
        Rule("E7", "state is at the last expected event", "state = expected_n - 1"),
        Rule("E8", "balances equal expected sums", "balance = expected_sum"),
    ]
    ok = " AND ".join(f"({r.holds})" for r in rules)
    return judge(facts, rules, [(f"NOT ({ok})", "FAIL")], "PASS")


def webhook_ordering(handled: DataFrame) -> DataFrame:
    """R3, over the rows of ranked_states of one payment."""
    facts = _one(
        handled,
        final="max_by(CASE WHEN action = 'APPLIED' THEN incoming ELSE current END, seq)",
        wins="max(successes)",
        stale="count_if(reason = 'stale_state_transition')",
        repeats="count_if(reason = 'duplicate_webhook')",
        lowered="count_if(incoming = 'PROCESSING' AND action = 'APPLIED' AND current IS NOT NULL)",
    )
    rules = [
        Rule("W1", "final state is success and was never lowered", "final = 'SUCCESS' AND lowered = 0"),
        Rule("W2", "success took effect once", "wins = 1"),
        Rule("W3", "one stale and one repeated webhook suppressed", "stale = 1 AND repeats = 1"),
    ]
    return judge(facts, rules, [(f"NOT ({' AND '.join(f'({r.holds})' for r in rules)})", "RED")], "GREEN")


def dlq_redrive(items: DataFrame, messages: DataFrame, attempts: DataFrame) -> DataFrame:
    """R4. items (message_id, replay_safety, disposition), messages (message_id, status), attempts (message_id, outcome)."""
    facts = _beside(
        _one(items, items="count(*)", unsafe="count_if(replay_safety <> 'SAFE')", open_items="count_if(disposition = 'UNRESOLVED')"),
        _one(messages, done="count_if(status = 'PROCESSED')"),
        _one(attempts.where("outcome = 'FAILED'").groupBy("message_id").count(), retried="count_if(count >= 3)"),
    )
    rules = [
        Rule("D1", "other messages went on", "done > 0"),
        Rule("D2", "every parked item was retried", "retried >= items"),
        Rule("D3", "parked items are accounted for", "open_items <= items"),
        Rule("D4", "parked items are safe to replay", "unsafe = 0", "REVIEW"),
    ]
    return judge(facts, rules, [("unsafe > 0", "YELLOW")], "GREEN")


def ledger_clearance(entries: DataFrame, journals: DataFrame, accounts: DataFrame, results: DataFrame, opening: int) -> DataFrame:
    """R5 of one attempt. opening: the available balance before it."""
    both = entries.join(journals.select("journal_id", "status"), "journal_id")
    facts = _beside(
        _one(
            both,
            debit="coalesce(sum(amount) FILTER (WHERE direction = 'DEBIT'), 0)",
            credit="coalesce(sum(amount) FILTER (WHERE direction = 'CREDIT'), 0)",
            entries_n="count(*)",
            committed="coalesce(bool_and(status = 'COMMITTED'), false)",
        ),
        _one(
            accounts,
            available="max(balance) FILTER (WHERE account_id = 'user_available')",
            held="max(balance) FILTER (WHERE account_id = 'clearance_account')",
        ),
        _one(results, amount="max(ledger_amount)", bank="coalesce(max(match_status), 'MISSING')"),
    )
    sound, cleared, matched = "committed AND entries_n = 2 AND debit = credit AND debit <> 0", f"held = amount AND available = {opening} - amount", "bank = 'MATCHED'"
    rules = [
        Rule("L1", "posting was atomic", "committed AND entries_n = 2"),
        Rule("L2", "debits equal credits", "debit = credit AND debit <> 0"),
        Rule("L3", "no partial posting", "entries_n = 2"),
        Rule("L4", "funds are held and the available balance is reduced", cleared),
        Rule("L5", "bank statement matches", matched),
        Rule("L6", "discrepancy is explained", matched),
    ]
    return judge(facts, rules, [(f"NOT (({sound}) AND ({cleared}))", "RED"), (matched, "GREEN")], "YELLOW")


def provider_timeout(payments: DataFrame, calls: DataFrame) -> DataFrame:
    """R6. payments (attempt_id, idempotency_key, internal_state, customer_state, ambiguity_reason, provider_transaction_id)."""
    wins = payments.where("internal_state = 'SUCCESS_CONFIRMED'").groupBy("idempotency_key").count()
    live = payments.where("internal_state <> 'SUPPRESSED_DUPLICATE'").groupBy("idempotency_key").count()
    blind = calls.join(payments.where("ambiguity_reason = 'provider_timeout'").select("attempt_id"), "attempt_id").where("request_type = 'CHARGE' AND call_id NOT LIKE 'call_%_charge'")
    facts = _beside(
        _one(wins, charged_twice="coalesce(sum(greatest(count - 1, 0)), 0)"),
        _one(live, shared_keys="count_if(count > 1)"),
        _one(
            payments,
            unknown="count_if(internal_state = 'AMBIGUOUS' AND provider_transaction_id IS NULL)",
            too_final="count_if(internal_state = 'AMBIGUOUS' AND customer_state IN ('PAID', 'FAILED'))",
        ),
        _one(blind, blind="count(*)"),
    )
    rules = [
        Rule("P1", "nobody is charged twice", "charged_twice = 0"),
        Rule("P2", "a key stands for one payment", "shared_keys = 0"),
        Rule("P3", "provider's commitment is known", "unknown = 0"),
        Rule("P4", "no final customer state on unknown commitment", "too_final = 0"),
        Rule("P5", "no blind retry after a timeout", "blind = 0"),
    ]
    return judge(facts, rules, [("charged_twice > 0 OR shared_keys > 0 OR too_final > 0 OR blind > 0", "RED"), ("unknown > 0", "YELLOW")], "GREEN")


def pipeline_audit(quality: DataFrame) -> DataFrame:
    """R7. quality (missing_rows, invalid_rows), a row a job."""
    facts = _one(quality, missing="coalesce(sum(missing_rows), 0)", invalid="coalesce(sum(invalid_rows), 0)")
    return judge(facts, [Rule("D1", "rows in equal rows out", "missing = 0", "WARN"), Rule("D2", "required fields are valid", "invalid = 0")], [("missing > 0 OR invalid > 0", "WARN")], "GREEN")


def pipeline_recovery(pages: DataFrame, audits: DataFrame, evidence: DataFrame, expected_pages: int) -> DataFrame:
    """R8. pages (page_no, status, critical), audits (audit_written_at, offset_committed_at), evidence (durable, sealed, msg_offset)."""
    facts = _beside(
        _one(pages, confirmed="count_if(status = 'CONFIRMED')", missing="count_if(status = 'MISSING')", critical="count_if(status = 'MISSING' AND critical)"),
        _one(audits, audited="count(*)", ordered="coalesce(bool_and(offset_committed_at IS NOT NULL AND offset_committed_at >= audit_written_at), false)"),
        _one(evidence, replayable="coalesce(bool_and(durable AND sealed AND msg_offset IS NOT NULL), false)"),
    )
    rules = [
        Rule("D1", "all pages confirmed", f"confirmed = {expected_pages}", "WARN"),
        Rule("D2", "no critical page missing", "critical = 0"),
        Rule("D3", "an audit was written", "audited > 0"),
        Rule("D4", "offset committed after the audit", "ordered"),
        Rule("D5", "replay is deterministic", "replayable"),
    ]
    return judge(facts, rules, [("critical > 0", "FAIL"), ("missing > 0", "WARN")], "PASS")


def payment_ambiguity(checks: DataFrame, calls: DataFrame, requests: DataFrame, effects: DataFrame, audits: DataFrame, cache: DataFrame) -> DataFrame:
    """R9. checks (attempt_no, result), calls (created_at, outcome), requests (duplicate, durable, sealed), cache as of R11."""
    facts = _beside(
        _one(checks, checked="max_by(result, attempt_no)"),
        _one(calls, called="max_by(outcome, created_at)"),
        _one(requests, durable="coalesce(bool_and(durable AND sealed) FILTER (WHERE NOT duplicate), false)", logical="count_if(NOT duplicate)"),
        _one(effects, credits="count(*)"),
        _one(audits, ordered="coalesce(bool_and(offset_committed_at IS NOT NULL AND offset_committed_at >= audit_written_at), false)"),
        _one(cache_reconciliation(cache), backfilled="coalesce(bool_and(cache_backfilled), false)"),
    )
    known = "coalesce(checked, called) = 'SUCCESS'"
    rules = [
        Rule("P1", "event is durable", "durable"),
        Rule("P2", "offset committed after the audit", "ordered"),
        Rule("P3", "wallet credited once at most", "credits <= 1"),
        Rule("P4", "cache follows the database", "backfilled"),
        Rule("P5", "one logical event", "logical = 1"),
        Rule("P6", "provider's commitment is verified", known, "PENDING"),
    ]
    return judge(facts, rules, [(f"coalesce(({known}) AND backfilled AND credits <= 1, false)", "GREEN")], "YELLOW")


def terminal_ordering(handled: DataFrame, effects: DataFrame, evidence: DataFrame) -> DataFrame:
    """R10. handled: rows of terminal_states with committed; evidence: (msg_offset, durable, gap): see scan.offset_gaps."""
    facts = _beside(
        _one(
            handled,
            final="max_by(after, seq)",
            lowered="count_if(before IN ('SUCCESS', 'FAILED') AND incoming = 'PROCESSING' AND decision = 'APPLIED')",
            revived="count_if(before = 'FAILED' AND incoming = 'SUCCESS' AND decision = 'APPLIED')",
            committed="bool_and(committed)",
        ),
        _one(effects, wins="count(*)"),
        _one(evidence, replayable="coalesce(bool_and(durable), false) AND count_if(gap) = 0"),
    )
    rules = [
        Rule("W1", "payment reached a terminal state", "final IN ('SUCCESS', 'FAILED')"),
        Rule("W2", "no stale webhook lowered the state", "lowered = 0"),
        Rule("W3", "success took effect once", "wins = 1"),
        Rule("W4", "no terminal state was changed", "revived = 0"),
    ]
    ok = " AND ".join(f"({r.holds})" for r in rules) + " AND committed AND replayable"
    return judge(facts, rules, [(f"NOT coalesce({ok}, false)", "RED")], "GREEN")


def cache_reconciliation(cache: DataFrame) -> DataFrame:
    """R11. The database wins: (attempt_id, database_state, cache_before, cache_after, cache_backfilled, repaired)."""
    return cache.select("attempt_id", "database_state", "cache_before", "cache_after", F.coalesce(F.col("cache_after") == F.col("database_state"), F.lit(False)).alias("cache_backfilled"), (~F.col("cache_before").eqNullSafe(F.col("database_state"))).alias("repaired"))
