"""Windowed equi-join of two logs.

A pair matches if its keys agree and its times differ by ``size_ms`` at most. Rows older than the watermark less the
window take no part, not even as outer rows: the watermark is the lesser of the sides' latest times less ``lateness_ms``,
0 if a side is empty. Rows without a key never take part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import fields as J

HOW = ("inner", "left", "right", "full")


@dataclass(frozen=True)
class WindowJoin:
    """in_order: only pairs whose left offset isn't after the right one; other pairs don't count as matched."""

    size_ms: int = 60_000
    lateness_ms: int = 0
    how: str = "inner"
    in_order: bool = False


def prune(left: DataFrame, right: DataFrame, keys: list[str], spec: WindowJoin) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides, (keys, ts_ms, off, ...), without rows that are too old or have no key; and the watermark's one row."""
    ends = left.agg(F.max("ts_ms").alias("l")).crossJoin(right.agg(F.max("ts_ms").alias("r")))  # one row each
    mark = ends.select(F.when(F.col("l").isNull() | F.col("r").isNull(), F.lit(0)).otherwise(F.greatest(F.least("l", "r") - spec.lateness_ms, F.lit(0))).cast("long").alias("watermark_ms"))

    def young(side: DataFrame) -> DataFrame:
        whole = side.dropna(subset=keys).crossJoin(F.broadcast(mark))
        return whole.where(F.col("ts_ms") >= F.greatest(F.col("watermark_ms") - spec.size_ms, F.lit(0))).drop("watermark_ms")

    return young(left), young(right), mark


def window_join(left: DataFrame, right: DataFrame, keys: list[str], spec: WindowJoin) -> DataFrame:
    """Columns of the left with the prefix left_, of the right with right_, absent sides null."""
    if spec.how not in HOW:
        raise ValueError(f"unknown join {spec.how!r}; one of {HOW}")
    a, b, _ = prune(left, right, keys, spec)
    a, b = (side.select(*[F.col(c).alias(f"{p}_{c}") for c in side.columns]) for p, side in (("left", a), ("right", b)))
    met = F.abs(F.col("left_ts_ms") - F.col("right_ts_ms")) <= spec.size_ms
    for k in keys:
        met = met & (F.col(f"left_{k}") == F.col(f"right_{k}"))
    if spec.in_order:
        met = met & (F.col("left_off") <= F.col("right_off"))
    return a.join(b, met, spec.how)


def skew_safe_window_join(left: DataFrame, right: DataFrame, keys: list[str], spec: WindowJoin) -> DataFrame:
    """window_join with time slices in the key: a hot key's rows spread over its slices.

    Pairs are found between each left row and the right rows of its slice and the two beside it. Rows without a pair, where
    the join keeps them, are those that no pair has: found by their row numbers, of which pairs give each once.
    """
    if spec.how not in HOW:
        raise ValueError(f"unknown join {spec.how!r}; one of {HOW}")
    a, b, _ = prune(left, right, keys, spec)
    slot = lambda c: F.floor(F.col(c) / max(spec.size_ms, 1))
    a = a.select(*[F.col(c).alias(f"left_{c}") for c in a.columns])
    b = b.select(*[F.col(c).alias(f"right_{c}") for c in b.columns])
    near = F.explode(F.array(slot("right_ts_ms") - 1, slot("right_ts_ms"), slot("right_ts_ms") + 1)).alias("_near")
    met = (F.col("_slot") == F.col("_near")) & (F.abs(F.col("left_ts_ms") - F.col("right_ts_ms")) <= spec.size_ms)
    for k in keys:
        met = met & (F.col(f"left_{k}") == F.col(f"right_{k}"))
    if spec.in_order:
        met = met & (F.col("left_off") <= F.col("right_off"))
    pairs = a.withColumn("_slot", slot("left_ts_ms")).join(b.select("*", near), met).drop("_slot", "_near")
    out = pairs
    # A row is known by all its columns, so that copies of a row are outer or not together.
    for side, how in ((a, "left"), (b, "right")):
        if spec.how in (how, "full"):
            same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in side.columns]
            matched = pairs.select(*side.columns).distinct()
            alone = side.alias("x").join(matched.alias("y"), reduce(lambda p, q: p & q, same), "left_anti")
            out = out.unionByName(alone, allowMissingColumns=True)
    return out.select(*a.columns, *b.columns)


def messages_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], spec: WindowJoin, *, left_fields: tuple[str, ...] = (), right_fields: tuple[str, ...] = (), missing_as: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Join of two logs by fields of their JSON values: (left_off, right_off, left, right), sides as JSON objects.

    left and right: (off, ts_ms, value). keys: (left field, right field), compared as text in which equal numbers agree. An
    empty list of fields gives ``{}``. An absent side is null, or ``{}`` if missing_as says so. max_rows: that many of the
    pairs, by left offset and within it the latest right one first, then of the left rows alone, then of the right ones.
    """
    if missing_as not in (None, "{}"):
        raise ValueError(f"missing_as is None or '{{}}', not {missing_as!r}")
    names = [f"k{i}" for i in range(len(keys))]

    def read(side: DataFrame, told: list[str], fields: tuple[str, ...]) -> DataFrame:
        """(off, ts_ms, k0, k1, ..., s0, s1, ...): the keys and the fields that are shown."""
        whole = side.select("off", "ts_ms", J.text(F.col("value")).alias("value")).where(J.is_object(F.col("value")))
        at = {f: f"_f{i}" for i, f in enumerate(dict.fromkeys([*told, *fields]))}
        out = J.with_first_fields(whole, "value", {c: f for f, c in at.items()})
        return out.select("off", "ts_ms", *[J.canonical(F.col(at[f])).alias(n) for n, f in zip(names, told, strict=True)], *[F.col(at[f]).alias(f"s{i}") for i, f in enumerate(fields)])

    def shown(side: str, fields: tuple[str, ...]) -> Column:
        whole = F.to_json(F.struct(*[F.col(f"{side}_s{i}").alias(f) for i, f in enumerate(fields)])) if fields else F.lit("{}")
        own = F.when(F.col(f"{side}_off").isNotNull(), whole)
        return F.coalesce(own, F.lit(missing_as)) if missing_as else own

    out = window_join(read(left, [x for x, _ in keys], left_fields), read(right, [y for _, y in keys], right_fields), names, spec)
    if max_rows is not None:
        kind = F.when(F.col("right_off").isNull(), 1).when(F.col("left_off").isNull(), 2).otherwise(0)
        out = out.orderBy(kind, F.col("left_off"), F.when(kind == 0, -F.col("right_off")).otherwise(F.col("right_off"))).limit(max_rows)
    return out.select("left_off", "right_off", shown("left", left_fields).alias("left"), shown("right", right_fields).alias("right"))


def join_stats(left: DataFrame, right: DataFrame, keys: list[str], spec: WindowJoin) -> DataFrame:
    """(left_scanned, right_scanned, watermark_ms, matched, outer_left, outer_right), scans counted after pruning."""
    a, b, mark = prune(left, right, keys, spec)
    full = window_join(left, right, keys, WindowJoin(spec.size_ms, spec.lateness_ms, "full", spec.in_order))
    missing_l, missing_r = F.col("left_ts_ms").isNull(), F.col("right_ts_ms").isNull()
    counts = full.agg(F.count_if(~missing_l & ~missing_r).alias("matched"), F.count_if(missing_r).alias("outer_left"), F.count_if(missing_l).alias("outer_right"))
    return a.agg(F.count("*").alias("left_scanned")).crossJoin(b.agg(F.count("*").alias("right_scanned"))).crossJoin(mark).crossJoin(counts)
