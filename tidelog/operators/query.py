"""Ad-hoc queries over JSON messages: filter, project, count by group."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import fields as J


@dataclass(frozen=True)
class Query:
    """filters: (field, operator, literal), all of which must hold. No project list: the whole value. emit_rows caps rows
    that are returned, never what is counted. measures: (function, field, name) beside the count."""

    filters: tuple[tuple[str, str, object], ...] = ()
    project: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    emit_rows: int | None = None
    window_ms: int | None = None
    measures: tuple[tuple[str, str, str], ...] = ()
    keep: tuple[str, ...] = field(default=("topic", "partition", "offset"))


@dataclass(frozen=True)
class Answer:
    rows: DataFrame
    aggregates: DataFrame | None
    stats: DataFrame


_MEASURES = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}


def run(log: DataFrame, q: Query) -> Answer:
    seen = log.withColumn("_v", J.text(F.col("value"))).where(J.is_object(F.col("_v")))
    used = dict.fromkeys([*(f for f, _, _ in q.filters), *q.project, *q.group_by, *(f for _, f, _ in q.measures)])
    at = {f: f"_f{i}" for i, f in enumerate(used)}
    read = J.with_fields(seen, "_v", {c: f for f, c in at.items()})
    hits = read.where(J.all_of([J.compare(F.col(at[f]), op, lit) for f, op, lit in q.filters]))
    rows = hits.select(*q.keep, *([F.col(at[f]).alias(f) for f in q.project] or [F.col("value")]))
    if q.emit_rows is not None:
        rows = rows.orderBy("partition", "offset").limit(q.emit_rows)
    aggregates = None
    if q.group_by:
        keys = [F.col(at[f]).alias(f) for f in q.group_by]
        if q.window_ms:
            keys.append((F.floor(F.unix_millis("ts") / q.window_ms) * q.window_ms).cast("long").alias("window_start_ms"))
        measured = [_MEASURES[fn](J.number(F.col(at[f]))).alias(name) for fn, f, name in q.measures]
        grouped = hits.groupBy(*keys).agg(F.count("*").alias("n"), *measured)
        aggregates = grouped.withColumn("group_key", J.key_text({f: F.col(f) for f in q.group_by}))
    stats = seen.agg(F.count("*").alias("scanned"), F.max("offset").alias("last_offset"))
    return Answer(rows, aggregates, stats)
