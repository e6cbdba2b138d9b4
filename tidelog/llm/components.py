"""Connected components of an edge table by alternating large-star and small-star steps; nothing goes to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import cut, partitions


def with_group_value(rows: DataFrame, key: str, spread: str, name: str, first: Column, then: Callable[[str], Column]) -> DataFrame:
    """``rows`` and the value of their group by ``key``, under ``name``; a group of any size is dealt over all partitions.

    A group's rows go to as many buckets as there are shuffle partitions, by the hash of ``spread``; ``first`` is the value of a
    bucket, ``then`` joins the buckets' values. The value goes back only to buckets that have rows.
    """
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(partitions(rows.sparkSession))))
    parts = dealt.groupBy(key, "_bucket").agg(first.alias(name))
    whole = parts.groupBy(key).agg(then(name).alias(name), F.collect_list("_bucket").alias("_buckets"))
    return dealt.join(whole.select(key, name, F.explode("_buckets").alias("_bucket")), [key, "_bucket"]).drop("_bucket")


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of edges (a long, b long); component is the least node. Each round is written out."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = cut(e, "edges")
    files = max(4, e.count() // 10_000)  # rounds have about as many edges
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))  # hi: a node, lo: a neighbour
        both = with_group_value(both, "hi", "lo", "m", F.min("lo"), F.min).withColumn("m", F.least("hi", "m"))
        large = both.where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = with_group_value(large, "hi", "lo", "m", F.min("lo"), F.min)
        small = small.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo")))
        e = cut(small.distinct(), "edges", files)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
