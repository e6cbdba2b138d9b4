"""The corpus pipeline: documents through four filters, then packed.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of ``documents``. run() writes each stage's rows to the cluster's shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.decontaminate import drop_contaminated
from tidelog.llm.line_dedup import line_dedup
from tidelog.llm.near_dup import near_duplicates
from tidelog.llm.packing import pack_documents
from tidelog.llm.storage import cut
from tidelog.llm.toxicity import reject_toxic, train_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on these documents' labels, doesn't reject.

    A null or empty text is scored as an empty one and a null id as any other; rows that repeat stay or go alike. No rows, or
    no labels of both kinds, reject nothing."""
    return reject_toxic(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines. One that had lines and has none left is a copy and goes; n_chars follows text.

    Null and empty texts stay as they are. Null ids come after all others. Rows that repeat an id and a text are treated
    alike. No rows give none."""
    left = line_dedup(docs).where("n_removed = 0 OR n_removed < n_lines")
    size = F.char_length("row.text").cast("long")
    changed = {"n_chars": F.when(F.col("n_removed") > 0, size).otherwise(F.col("row.n_chars"))}
    return left.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id; of rows that repeat id and text, one.

    Rows with a null id take no part and all stay. Null and empty texts are like nothing else and stay. Where an id that stays
    comes with several texts, each of them stays. No rows give none."""
    stay = near_duplicates(docs).where("class_id = doc_id").select("doc_id").distinct()
    known = docs.where("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi").withColumn("_h", F.xxhash64("text"))
    return known.dropDuplicates(["doc_id", "_h"]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks.

    Null and empty texts hold no item and stay; null ids and rows that repeat are judged by their text. No rows give none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    Null and empty texts are a piece of the end id; null ids and rows that repeat are packed each. No rows give none."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests/llm/test_pipeline.py holds every stage against plain
#: Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
