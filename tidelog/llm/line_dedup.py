"""Line deduplication by overlapping windows of consecutive lines.

Lines that aren't blank are compared by their text without white space at the ends. Every window of ``window`` of them has
a digest; of a digest's occurrences over all documents, in order of document id and position, the first one stays and
every later one is removed, with all lines that it covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import partitions
from tidelog.llm.tables import bucket, pick, position
from tidelog.llm.words import slices

_NO_ID = (1 << 63) - 1


def _lines(text: Column) -> Column:
    """Digests of the lines that aren't blank."""
    bare = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")))
    return F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.md5(x.cast("binary")))


def _windows(lines: Column, window: int) -> Column:
    start = F.when(F.size(lines) >= window, F.sequence(F.lit(0), F.size(lines) - window)).otherwise(F.array().cast("array<int>"))
    return F.transform(start, lambda i: F.struct(i.alias("at"), F.unhex(F.md5(F.array_join(F.slice(lines, i + 1, window), "").cast("binary"))).alias("digest")))


def _starts(docs: DataFrame, window: int) -> DataFrame:
    """(_id, _h, starts): of each text that has any, the windows that occur earlier. docs: (_id, _h, text).

    A digest's rows are dealt over buckets by their document, and only its first and last occurrences in each bucket are
    compared, so a window that is in every document meets in no one task.
    """
    lines = docs.select("_id", "_h", _lines(F.col("text")).alias("lines"))
    each = lines.select("_id", "_h", F.explode(_windows(F.col("lines"), window)).alias("w")).select("_id", "_h", F.col("w.at").alias("at"), F.col("w.digest").alias("digest"))
    each = each.withColumn("_bucket", bucket(partitions(docs.sparkSession), "_id", "_h"))
    spot = F.struct("_id", "_h", "at")
    parts = each.groupBy("digest", "_bucket").agg(F.min(spot).alias("low"), F.max(spot).alias("high"))
    whole = parts.groupBy("digest").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.collect_list("_bucket").alias("_buckets")).where("first <> last")
    first = whole.select("digest", "first", F.explode("_buckets").alias("_bucket"))
    return each.join(first, ["digest", "_bucket"]).where(spot != F.col("first")).groupBy("_id", "_h").agg(F.collect_set("at").alias("starts"))


def _without(text: str, starts: list[int] | None, window: int) -> tuple[str, int, int]:
    """What is left of a text, its number of lines that aren't blank, and of those the number removed."""
    covered = {s + k for s in starts or () for k in range(window)}
    n, kept = 0, []
    for line in text.split("\n"):
        full = bool(line.strip(" \t\x0b\x0c\r"))
        if not (full and n in covered):
            kept.append(line)
        n += full
    return "\n".join(kept), n, len(covered)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """One row a document: (row, n_lines, n_removed); row: a struct of its columns, with what is left of its text.

    Lines that stay are as they were; n_lines counts lines that aren't blank. A text with fewer such lines than a window, an
    empty or a null one loses nothing, and a null stays null. Null ids come after all others. Rows that repeat an id and a
    text count as one occurrence and are treated alike. Extra columns, whatever their names, stay in row. An empty table
    gives no row.
    """
    names = docs.columns
    d = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    i, t = position(docs, id_col), position(docs, text_col)
    text = F.col(f"_c{t}").cast("string")
    keys = {"_id": F.coalesce(F.col(f"_c{i}").cast("long"), F.lit(_NO_ID)), "_h": F.xxhash64(F.coalesce(text, F.lit("")))}
    d = d.withColumn(f"_c{t}", text).withColumns(keys)
    starts = _starts(d.select("_id", "_h", F.coalesce(text, F.lit("")).alias("text")), window)
    # Texts are shuffled once.
    met = d.join(starts, ["_id", "_h"], "left").select("starts", *[f"_c{k}" for k in range(len(names))])
    row = F.struct(*[F.col(f"_c{k}").alias(n) for k, n in enumerate(names)]).alias("row")
    out = met.select(row, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, f"_c{t}"):
                columns = part.columns[1:]
                texts = columns[t].to_pylist()
                done = [_without(x or "", s, window) for x, s in zip(texts, part.column(0).to_pylist(), strict=True)]
                columns[t] = pa.array([d[0] if d[2] else x for d, x in zip(done, texts, strict=True)], pa.string())
                rows = pa.StructArray.from_arrays(columns, fields=[pa.field(n, c.type) for n, c in zip(names, columns, strict=True)])
                yield pa.RecordBatch.from_arrays([rows, pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["row", "n_lines", "n_removed"])

    return met.mapInArrow(remove, out)


def line_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of line_dedup; of a null text the digest of an empty one."""
    narrow = pick(docs, doc_id=options.pop("id_col", "doc_id"), text=options.pop("text_col", "text"))
    kept = F.coalesce("row.text", F.lit("")).cast("binary")
    return line_dedup(narrow, **options).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
