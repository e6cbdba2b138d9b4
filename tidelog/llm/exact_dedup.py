"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A frequent-items sketch of the Misra-Gries family (``approx_top_k``, mergeable, bounded) proposes frequent digests. Their
counts and winners are then computed exactly, from partial aggregates, and broadcast: at most ``max_heavy`` rows. Rows of
these digests are decided where they lie. All other digests have few rows each and go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.storage import cut, partitions
from tidelog.llm.tables import documents

#: Fixed value: the characters that don't count, ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = documents(docs, id_col, text_col)
    return d.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.translate("text", SPACES, "").cast("binary"), 256).alias("text_sha256"))


def _best():
    """Order of rows: most code points first, then the smallest id, null ids last."""
    return F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id")))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = 256, tracked: int = 8192) -> DataFrame:
    """One row a document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are without the characters of SPACES; null counts as empty. The longest original text of a
    group stays, of these the one with the smallest id, null ids last; of rows that repeat its id and length, one. Extra
    columns, whatever their names, are ignored. An empty table gives no row.

    More than max_heavy digests can be frequent. The rest of them are shuffled, each to one task; as all max_heavy others are
    more frequent, that is a share of the rows of less than one in max_heavy.
    """
    spark = docs.sparkSession
    keyed = cut(text_digests(docs, id_col, text_col), "digests")
    heavy_rows = max(32, keyed.count() // (8 * partitions(spark)))
    top = keyed.select(F.expr(f"approx_top_k(text_sha256, {max_heavy}, {tracked})").alias("t")).select(F.explode("t").alias("t"))
    proposed = top.where(F.col("t.count") >= heavy_rows).select(F.col("t.item").alias("text_sha256"))
    proposed = F.broadcast(proposed)  # max_heavy rows at most
    winners = keyed.join(proposed, "text_sha256", "left_semi").groupBy("text_sha256").agg(_best().alias("best"), F.count("*").alias("group_size"))
    winners = cut(winners.where(F.col("group_size") >= heavy_rows), "heavy-winners")
    split = keyed.join(F.broadcast(winners), "text_sha256", "left")
    heavy = split.where(F.col("group_size").isNotNull())
    whole = Window.partitionBy("text_sha256")
    light = split.where(F.col("group_size").isNull()).select("doc_id", "n_chars", "text_sha256")
    light = light.withColumns({"best": _best().over(whole), "group_size": F.count("*").over(whole)})
    columns = ["doc_id", "n_chars", "text_sha256", "group_size"]
    keep, stays = F.col("best.doc_id"), F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (-F.col("best.col1") == F.col("n_chars"))
    nth = F.row_number().over(whole.orderBy(F.desc("n_chars"), F.col("doc_id").asc_nulls_last()))
    light = light.select(*columns, keep.alias("keep_id"), (nth == 1).alias("kept"))
    # Rows that could stay are few, one a digest but for repetitions: of these the first does.
    least = heavy.where(stays).groupBy(*columns, keep.alias("keep_id")).agg(F.count("*").alias("_n"))
    first = least.select(*columns, "keep_id", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_i")).withColumn("kept", F.col("_i") == 1).drop("_i")
    rest = heavy.where(~stays).select(*columns, keep.alias("keep_id"), F.lit(False).alias("kept"))
    return rest.unionByName(first).unionByName(light).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
