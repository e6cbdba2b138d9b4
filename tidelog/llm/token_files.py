"""Token-id files: fixed-width bit packing with block offsets.

A file is a header, packed blocks and a footer, all little-endian::

    header   magic 8 bytes, bits u32, ids per block u32, vocabulary u32, zero u32
    blocks   ids at ``bits`` bits each, lowest bit first; every block but the last has the header's number of ids
    footer   block offsets u64 x (blocks + 1), document ids i64 x documents, document starts u64 x (documents + 1)
    trailer  ids u64, blocks u64, documents u64, documents without an id u64, magic 8 bytes

Blocks begin at byte borders, so any range of ids is read by seeking to its first block and unpacking with numpy.
``bits`` is the least width that holds the vocabulary. Documents without an id come first; the smallest i64 stands for theirs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.storage import AtomicFile, cut, open_fs, partitions, shared_dir
from tidelog.llm.tables import documents
from tidelog.llm.tokens import tokenizer
from tidelog.llm.words import slices

MAGIC = b"TIDETOK1"
NULL_ID = -(1 << 63)
_HEAD, _TAIL = struct.Struct("<8sIIII"), struct.Struct("<QQQQ8s")


def width(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class TokenFileWriter:
    def __init__(self, path: str, vocab_size: int, block_ids: int = 4096):
        self.file, self.path, self.bits, self.block = AtomicFile(path), path, width(vocab_size), block_ids
        self.file.write(_HEAD.pack(MAGIC, self.bits, block_ids, vocab_size, 0))
        self.offsets, self.ids, self.starts, self.n, self.nulls = [_HEAD.size], [], [np.zeros(1, np.int64)], 0, 0
        self.rest = np.zeros(0, np.uint32)

    def _blocks(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), self.block):
            data = pack(ids[i : i + self.block], self.bits)
            self.file.write(data)
            self.offsets.append(self.offsets[-1] + len(data))

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray, nulls: int = 0) -> None:
        """Documents in order, the first ``nulls`` without an id; ends: of each document within ids."""
        self.ids.append(doc_ids)
        self.nulls += nulls
        self.starts.append(ends + self.n)
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> tuple[int, int]:
        self._blocks(self.rest)
        doc_ids = np.concatenate([np.zeros(0, np.int64), *self.ids])
        self.file.write(np.array(self.offsets, "<u8").tobytes())
        self.file.write(doc_ids.astype("<i8").tobytes())
        self.file.write(np.concatenate(self.starts).astype("<u8").tobytes())
        self.file.write(_TAIL.pack(self.n, len(self.offsets) - 1, len(doc_ids), self.nulls, MAGIC))
        self.file.close()
        return len(doc_ids), self.n


class TokenFile:
    """Random access to a token file."""

    def __init__(self, path: str):
        where, inner = open_fs(path)
        self.file = where.open_input_file(inner)
        size = self.file.size()
        magic, self.bits, self.block, self.vocab_size, _ = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        self.n, blocks, docs, self.nulls, end = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} isn't a whole token file")
        foot = 8 * (blocks + 1 + docs + docs + 1)
        data = np.frombuffer(self.file.read_at(foot, size - _TAIL.size - foot), "<u8").astype(np.int64)
        self.offsets, self.doc_ids, self.starts = np.split(data, [blocks + 1, blocks + 1 + docs])

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi, hi excluded."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        data = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        at = self.offsets[a : b + 1] - self.offsets[a]
        last = min(self.n, b * self.block) - (b - 1) * self.block
        if self.bits % 8 == 0 or b - a == 1:
            out = unpack(data, (b - a - 1) * self.block + last, self.bits)
        else:
            out = np.concatenate([unpack(data[at[i] : at[i + 1]], self.block if i < b - a - 1 else last, self.bits) for i in range(b - a)])
        return out[lo - a * self.block : hi - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.file.close()


def with_end(ids: np.ndarray, ptr: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with end_id after each document, and the new pointers."""
    n = len(ptr) - 1
    return np.insert(ids, ptr[1:], end_id).astype(np.uint32), ptr + np.arange(n + 1)


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0, block_ids: int = 4096, file_ids: int = 1 << 26) -> DataFrame:
    """Encode every document, append end_id, and write token files under path in ascending order of document id.

    Returns the manifest (path, part, seq, n_docs, n_ids, start): start is the number of ids in all files before. Each task
    writes the files of one range of ids, a new one after about file_ids ids. Nulls and empty texts have the end id alone;
    null document ids come first; rows that repeat an id follow each other in order of text; an empty table has no files.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk, part, seq, out = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0, None
        rows: list[tuple] = []

        def close() -> None:
            nonlocal out, seq
            if out is not None:
                rows.append((out.path, part, seq, *out.close()))
                seq, out = seq + 1, None

        for batch in batches:
            for rows_, _, _ in slices(batch, "text", 1 << 20):
                ids, ptr = with_end(*tk.encode(rows_.column(1).to_pylist()), end_id)
                doc_ids = rows_.column(0).fill_null(NULL_ID).to_numpy()
                if out is None:
                    out = TokenFileWriter(f"{path}/part-{part:06d}-{seq:04d}.tok", tk.vocab_size, block_ids)
                out.add(doc_ids, ids, ptr[1:], rows_.column(0).null_count)
                if out.n >= file_ids:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "part", "seq", "n_docs", "n_ids"), r, strict=True)) for r in rows], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    d = documents(docs, id_col, text_col)
    ordered = d.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    manifest = cut(ordered.mapInArrow(write, "path string, part int, seq int, n_docs long, n_ids long"), "token-manifest")
    # One row a file: the sum runs over file sizes only.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, *, batch_ids: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that a manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(row["path"])
                i, n = 0, len(f.doc_ids)
                while i < n:
                    j = max(i + 1, int(np.searchsorted(f.starts, f.starts[i] + batch_ids, side="right")) - 1)
                    at = f.starts[i : j + 1] - f.starts[i]
                    data = memoryview(f.read(int(f.starts[i]), int(f.starts[j])).astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                    doc = f.doc_ids[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=np.arange(i, j) < f.nulls), pa.array(f.starts[i:j] + row["start"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j
                f.close()

    dealt = manifest.select("path", "start").repartition(partitions(manifest.sparkSession), "path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write token files to the shared folder and read every document back from them."""
    spark: SparkSession = docs.sparkSession
    return read_token_files(write_token_files(docs, shared_dir(spark, "tokens"), **options))
