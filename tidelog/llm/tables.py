"""Column selection that no extra or clashing column of an input can disturb."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position(df: DataFrame, column: str) -> int:
    """Number of a column. One spelt exactly so wins over one in another case."""
    names = df.columns
    return names.index(column) if column in names else [n.lower() for n in names].index(column.lower())


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named source columns only, as ``out=source``."""
    at = {out: position(df, src) for out, src in columns.items()}
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[F.col(f"_c{i}").alias(out) for out, i in at.items()])


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null texts as empty ones."""
    d = pick(df, doc_id=id_col, text=text_col)
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bucket(n: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
