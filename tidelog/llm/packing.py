"""Packing of documents into sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``size`` ids. The histogram of piece lengths (``size`` numbers, whatever the
input) goes to the driver, which places lengths longest first, each into the packs with the most room, and so gets
patterns of lengths with counts. Pieces find their place by rank: the r-th piece of a length takes the r-th place that
the patterns have for that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.storage import cut, partitions
from tidelog.llm.tables import bucket, documents
from tidelog.llm.token_files import with_end
from tidelog.llm.tokens import tokenizer
from tidelog.llm.words import slices


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns that hold counts[length] pieces of each length, lengths in order of placing."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max(by_room, default=0)
            if room < length:
                by_room.setdefault(size - length, []).append((left, (length,)))
                break
            n, pattern = by_room[room].pop()
            k = min(n, left)
            if n > k:
                by_room[room].append((n - k, pattern))
            if not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - length, []).append((k, (*pattern, length)))
            left -= k
    return [p for room in sorted(by_room) for p in by_room[room]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of ranks, by length and first rank: (length, first rank, first sequence, offset)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    table = np.array(sorted(out), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def token_pieces(docs: DataFrame, *, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids (end id included) into pieces: (doc_id, start, length, ids_crc32, doc_tokens[, ids])."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(tokenizer_path)
        for batch in batches:
            for rows, _, _ in slices(batch, "text", 1 << 20):
                ids, ptr = with_end(*tk.encode(rows.column(1).to_pylist()), end_id)
                total = np.diff(ptr)
                n = -(-total // size)
                doc = np.repeat(np.arange(len(total)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, total[doc] - start)
                data = memoryview(ids.astype("<u4").tobytes())
                at = 4 * (ptr[doc] + start)
                ends = at + 4 * length
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at, ends, strict=True)]
                arrays = [rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array([bytes(data[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return documents(docs, id_col, text_col).mapInArrow(cut_up, schema)


def pack_pieces(pieces: DataFrame, *, size: int = 1024) -> DataFrame:
    """Give every piece (doc_id, start, length, ...) a sequence_id and an offset in that sequence.

    Ranks within a length count a length's pieces bucket by bucket, so that no task holds all pieces of a frequent length.
    """
    spark = pieces.sparkSession
    n = partitions(spark)
    p = pieces.withColumn("_b", bucket(n, "doc_id", "start", "ids_crc32"))
    counts = cut(p.groupBy("length", "_b").agg(F.count("*").alias("_n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # size rows at most
    length, first, sequence, offset = places(shortest_pack_first(histogram, size))
    key = length << 40 | first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            own = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = np.searchsorted(key, own << 40 | rank, side="right") - 1
            keep = [i for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32")
    ranked = p.withColumn("_r", F.row_number().over(inside)).join(base, ["length", "_b"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_r") - 1).alias("_rank"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, *, size: int = 1024, with_ids: bool = False, **options) -> DataFrame:
    """Pack documents into sequences of at most size ids: one row a piece.

    (doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset). Null and empty texts are one piece with the
    end id; repeated rows are packed each; an empty table gives no row; extra columns are ignored.
    """
    pieces = cut(token_pieces(docs, size=size, with_ids=with_ids, **options), "pieces")
    return pack_pieces(pieces, size=size)


def sequences(packed: DataFrame, *, size: int = 1024) -> DataFrame:
    """(sequence_id, length, ids): each sequence's ids as little-endian u32, of pieces packed with_ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # size ids at most
    g = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p"))
    return g.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
