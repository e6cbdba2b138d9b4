"""Incremental substring deduplication over a log-structured fingerprint index.

A window is ``window`` consecutive words. Its fingerprint is the least of the hashes of the ``gram``-word windows inside it,
so equal windows have equal fingerprints and neighbours mostly share theirs: an index entry stands for several windows.

The index is a directory of immutable runs. A run holds, for every hash bucket, a file of sorted fingerprints, each with
the document that has it, or MANY. A batch of documents is fingerprinted where it lies and aggregated per chunk of text;
each bucket's task sorts the new entries, merge-joins them with that bucket's files of all earlier runs, and writes the
batch's own run. Documents that share a fingerprint are candidates. Their windows with shared fingerprints, and no others,
are then verified by two independent hashes of all words' bytes, 96 bits in all; a window whose words also start in a
document with a smaller id is removed. Runs are merged when there are more than ``fan_in``.

Each addition ends with a new manifest, which names the runs that make up the index, so a later session goes on where the
last one stopped. An index that outlives the call also keeps, for every window, its two hashes and the least document that
has it, by bucket: windows of new documents are verified against them, without the older documents' texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.storage import AtomicFile, cut, open_fs, pack_ints, pack_sorted, partitions, shared_dir, unpack_ints, unpack_sorted
from tidelog.llm.tables import documents
from tidelog.llm.words import CHUNK_BYTES, Words, slices

MANY = -(1 << 63)
NULL_ID = (1 << 63) - 1
_CHUNK = CHUNK_BYTES
_NTH = 40  # of a window's place in its row, the bits above say which row of its id that is


def _runs_of(values: np.ndarray) -> np.ndarray:
    """First place of each run of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _bucket_cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted 64-bit hashes cross from one of equal ranges to the next."""
    step = (1 << 64) // buckets
    return np.searchsorted(values, np.array([i * step for i in range(1, buckets)], np.uint64))


class _Windows:
    """Windows of a chunk of texts: row and first word of each, fingerprint, and on demand two hashes of all words."""

    def __init__(self, words: Words, window: int, gram: int):
        self.words, self.window = words, window
        self.h = words.hashes(0)
        grams, _, gptr = words.windows(gram, self.h)
        counts = np.maximum(words.counts - window + 1, 0)
        ptr = np.concatenate([[0], np.cumsum(counts)])
        self.row = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(ptr[-1]) - np.repeat(ptr[:-1], counts)
        self.first = np.repeat(words.row_ptr[:-1], counts) + step
        at = np.repeat(gptr[:-1], counts) + step
        self.print = grams[at] if len(at) else np.zeros(0, np.uint64)
        for j in range(1, window - gram + 1):
            np.minimum(self.print, grams[at + j], out=self.print)

    def strong(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of 64 and of 32 bits, each from a lane of its own."""
        weak = self.words.windows(self.window, self.h, 0)[0][which] >> np.uint64(32)
        return self.words.windows(self.window, self.words.hashes(1), 1)[0][which], weak.astype(np.uint32)


def _digest(words: Words, keep: np.ndarray | None = None) -> list[str]:
    """sha256 of each row's (kept) words, joined by one blank."""
    data = words.data.copy()
    if keep is None:
        keep = np.ones(len(words.start), bool)
    mask = np.zeros(len(data) + 1, np.int8)
    np.add.at(mask, words.start[keep], 1)
    np.add.at(mask, words.end[keep], -1)
    mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    kept = np.flatnonzero(keep)
    row = np.searchsorted(words.row_ptr, kept, side="right") - 1
    joint = words.end[kept[:-1][row[:-1] == row[1:]]]
    mask[joint] = True
    data[joint] = 32
    at = np.concatenate([[0], np.cumsum(mask)])[words.offsets]
    out = memoryview(data[mask].tobytes())
    return [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


def _glue(*parts: bytes) -> bytes:
    """Parts as one byte string. Tables of such strings are compressed as columns, which finds more than each string has."""
    return b"".join([np.array([len(parts), *map(len, parts)], "<i8").tobytes(), *parts])


def _parts(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    edges = np.cumsum([8 + 8 * n, *np.frombuffer(data, "<i8", n, 8)])
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_pylist(rows, schema=schema)
    rows.clear()
    return batch


# --- the index ----------------------------------------------------------------------------------------------------------


def _write_bucket(path: str, prints: np.ndarray, docs: np.ndarray) -> None:
    f = AtomicFile(path)
    f.write(_compressed(_glue(pack_sorted(prints), pack_ints(docs))))
    f.close()


def _read_bucket(path: str) -> tuple[np.ndarray, np.ndarray]:
    prints, docs = _parts(_bytes(path))
    return unpack_sorted(prints), unpack_ints(docs)


def _bytes(path: str) -> bytes:
    where, inner = open_fs(path)
    with where.open_input_stream(inner) as f:
        return zstandard.ZstdDecompressor().decompress(f.read())


def _compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _least(strong: np.ndarray, weak: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window once, by its hashes, with the least document that has it."""
    order = np.lexsort((own, weak, strong))
    strong, weak, own = strong[order], weak[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], (strong[1:] != strong[:-1]) | (weak[1:] != weak[:-1])])) if len(own) else np.zeros(0, np.int64)
    return strong[first], weak[first], own[first]


def _pack_windows(strong: np.ndarray, weak: np.ndarray, own: np.ndarray, *more: np.ndarray) -> bytes:
    """Windows by both hashes (strong: sorted), and whatever integers belong to them."""
    return _glue(pack_sorted(strong), weak.astype("<u4").tobytes(), *map(pack_ints, (own, *more)))


def _unpack_windows(data: bytes) -> tuple[np.ndarray, ...]:
    strong, weak, *more = _parts(data)
    return unpack_sorted(strong), np.frombuffer(weak, "<u4"), *map(unpack_ints, more)


def _write_windows(path: str, strong: np.ndarray, weak: np.ndarray, own: np.ndarray) -> None:
    f = AtomicFile(path)
    f.write(_compressed(_pack_windows(strong, weak, own)))
    f.close()


def _read_windows(path: str) -> tuple[np.ndarray, ...]:
    return _unpack_windows(_bytes(path))


def _merge(prints: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of one fingerprint each; those of several documents become MANY."""
    order = np.argsort(prints, kind="stable")
    prints, docs = prints[order], docs[order]
    first = _runs_of(prints)
    low, high = (np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)) if len(first) else (docs, docs)
    return prints[first], np.where(low == high, low, MANY)


class FingerprintIndex:
    """Runs of fingerprints in a shared folder, and runs of windows with the hashes of all their words.

    A folder that has a manifest is opened as its last one says, with the number of buckets it was made with. One writer
    at a time.
    """

    def __init__(self, path: str, buckets: int, *, window: int = 13, gram: int = 8, fan_in: int = 4):
        self.path, self.buckets, self.window, self.gram, self.fan_in = path, buckets, window, gram, fan_in
        self.runs: list[str] = []
        self.windows: list[str] = []
        self.made = 0
        self._open()

    def _open(self) -> None:
        where, inner = open_fs(self.path)
        files = where.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        manifests = sorted(f.path for f in files if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))
        if not manifests:
            return
        with where.open_input_stream(manifests[-1]) as f:
            m = json.loads(f.read())
        if (m["window"], m["gram"]) != (self.window, self.gram):
            raise ValueError(f"the index has windows of {m['window']} and grams of {m['gram']} words, not {self.window} and {self.gram}")
        self.buckets, self.made = m["buckets"], m["made"]
        self.runs, self.windows = ([f"{self.path}/{r}" for r in m[k]] for k in ("runs", "windows"))

    def _commit(self) -> None:
        runs, windows = ([r.rpartition("/")[2] for r in x] for x in (self.runs, self.windows))
        f = AtomicFile(f"{self.path}/manifest-{self.made:09d}.json")
        f.write(json.dumps({"window": self.window, "gram": self.gram, "buckets": self.buckets, "made": self.made, "runs": runs, "windows": windows}).encode())
        f.close()

    def _next(self) -> str:
        self.made += 1
        return f"{self.path}/run-{self.made:06d}"

    def add(self, docs: DataFrame, groups: int) -> DataFrame:
        """Index a batch (doc_id, text): (grp, docs, prints), the batch's and older documents with shared fingerprints."""
        buckets, window, gram, old, new, named = self.buckets, self.window, self.gram, list(self.runs), self._next(), self._name
        schema = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("prints", pa.binary()), ("docs", pa.binary())])
        text = "kind int, key int, prints binary, docs binary"

        def shared(rows: list[dict], prints: np.ndarray, ids: np.ndarray) -> None:
            """Candidates by group of documents, sorted by fingerprint."""
            grp = np.mod(ids, groups)
            order = np.lexsort((prints, grp))
            prints, ids, grp = prints[order], ids[order], grp[order]
            for a, b in zip(s := _runs_of(grp), [*s[1:], len(grp)], strict=True):
                rows.append({"kind": 1, "key": int(grp[a]), "prints": pack_sorted(prints[a:b]), "docs": pack_ints(ids[a:b])})

        def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[dict] = []
            for batch in batches:
                for part, data, offsets in slices(batch, "text", _CHUNK):
                    ids = part.column(0).fill_null(NULL_ID).to_numpy()
                    w = _Windows(Words(data, offsets), window, gram)
                    changed = np.flatnonzero(np.concatenate([[True], (w.print[1:] != w.print[:-1]) | (w.row[1:] != w.row[:-1])])) if len(w.row) else np.zeros(0, np.int64)
                    prints, own = w.print[changed], ids[w.row[changed]]
                    order = np.argsort(prints, kind="stable")
                    prints, own = prints[order], own[order]
                    first = _runs_of(prints)
                    if not len(first):
                        continue
                    many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
                    each = np.repeat(many, np.diff([*first, len(prints)]))
                    if each.any():
                        shared(rows, prints[each], own[each])
                    prints, own = prints[first], np.where(many, MANY, own[first])
                    cuts = [0, *_bucket_cuts(prints, buckets), len(prints)]
                    for b in range(buckets):
                        if cuts[b + 1] > cuts[b]:
                            s = slice(cuts[b], cuts[b + 1])
                            rows.append({"kind": 0, "key": b, "prints": pack_sorted(prints[s]), "docs": pack_ints(own[s])})
                    yield _emit(rows, schema)

        def merge_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, gathered, rows = None, [], []

            def close() -> None:
                if not gathered:
                    return
                prints, own = (np.concatenate(x) for x in zip(*gathered, strict=True))
                gathered.clear()
                order = np.argsort(prints, kind="stable")
                prints, own = prints[order], own[order]
                first = _runs_of(prints)
                unique = prints[first]
                low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
                hit = (low != high) | (low == MANY)
                _write_bucket(named(new, key), unique, np.where(hit, MANY, low))
                for run in old:
                    their, docs_ = _read_bucket(named(run, key))
                    _, x, y = np.intersect1d(unique, their, assume_unique=True, return_indices=True)
                    hit[x] = True
                    single = y[docs_[y] != MANY]
                    if len(single):
                        shared(rows, their[single], docs_[single])
                each = np.repeat(hit, np.diff([*first, len(prints)])) & (own != MANY)
                if each.any():
                    shared(rows, prints[each], own[each])

            for batch in batches:
                for row in batch.to_pylist():
                    if row["kind"]:
                        rows.append(row)
                        continue
                    if row["key"] != key:
                        close()
                        key = row["key"]
                    gathered.append((unpack_sorted(row["prints"]), unpack_ints(row["docs"])))
                yield _emit(rows, schema)
            close()
            yield _emit(rows, schema)

        # Every bucket has a task's attention even if the batch has nothing for it: its file must exist.
        spark = docs.sparkSession
        empty = spark.range(buckets).select(F.lit(0).alias("kind"), F.col("id").cast("int").alias("key"), F.lit(b"").alias("prints"), F.lit(b"").alias("docs"))
        dealt = docs.mapInArrow(fingerprint, text).unionByName(empty).repartition(min(buckets, max(partitions(spark), 1)), "key").sortWithinPartitions("kind", "key")
        found = cut(dealt.mapInArrow(_nonempty(merge_join, named, new), text), "shared-fingerprints")
        self.runs.append(new)
        if len(self.runs) > self.fan_in:
            self.compact(spark)
        self._commit()
        return found.select(F.col("key").alias("grp"), "docs", "prints")

    def keep_windows(self, docs: DataFrame) -> None:
        """Store all windows of a batch (doc_id, text), against which later batches are verified."""
        buckets, window, gram, new, named = self.buckets, self.window, self.gram, self._next(), self._name
        schema = pa.schema([("key", pa.int32()), ("a", pa.binary())])
        text = "key int, a binary"

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[dict] = []
            for batch in batches:
                for part, data, offsets in slices(batch, "text", _CHUNK):
                    ids = part.column(0).fill_null(NULL_ID).to_numpy()
                    w = _Windows(Words(data, offsets), window, gram)
                    strong, weak = w.strong(np.arange(len(w.row)))
                    strong, weak, own = _least(strong, weak, ids[w.row])
                    cuts = [0, *_bucket_cuts(strong, buckets), len(strong)]
                    for b in range(buckets):
                        if cuts[b + 1] > cuts[b]:
                            s = slice(cuts[b], cuts[b + 1])
                            rows.append({"key": b, "a": _pack_windows(strong[s], weak[s], own[s])})
                    yield _emit(rows, schema)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, gathered = None, []

            def close() -> None:
                if key is not None:
                    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
                    _write_windows(named(new, key), *_least(*(np.concatenate(x) for x in zip(none, *gathered, strict=True))))
                    gathered.clear()

            for batch in batches:
                for row in batch.to_pylist():
                    if row["key"] != key:
                        close()
                        key = row["key"]
                    if row["a"]:
                        gathered.append(_unpack_windows(row["a"]))
                yield batch.slice(0, 0)
            close()

        spark = docs.sparkSession
        blank = spark.range(buckets).select(F.col("id").cast("int").alias("key"), F.lit(b"").alias("a"))  # so that every bucket's file exists
        dealt = docs.mapInArrow(hashed, text).unionByName(blank)
        dealt.repartition(min(buckets, max(partitions(spark), 1)), "key").sortWithinPartitions("key").mapInArrow(write, text).count()
        self.windows.append(new)
        self._commit()

    @staticmethod
    def _name(run: str, bucket: int) -> str:
        return f"{run}/bucket-{bucket:06d}.fpr"

    def compact(self, spark: SparkSession) -> None:
        """Merge all runs into one; the old files stay for readers that have begun."""
        old, new, named = list(self.runs), self._next(), self._name

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    both = [_read_bucket(named(run, b)) for run in old]
                    _write_bucket(named(new, b), *_merge(np.concatenate([p for p, _ in both]), np.concatenate([d for _, d in both])))
                yield batch

        spark.range(0, self.buckets, 1, self.buckets).mapInArrow(merge, "id long").count()
        self.runs = [new]


def _nonempty(merge_join, named, new):
    """Buckets without entries get an empty file, so that a run is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        full: set[int] = set()

        def watch() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blank = np.array([len(x.as_buffer()) == 0 for x in batch.column(2)], bool)
                kind, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                seen.update(key[(kind == 0) & blank].tolist())
                full.update(key[(kind == 0) & ~blank].tolist())
                yield batch.filter(pa.array(~blank))

        yield from merge_join(watch())
        for b in seen - full:
            _write_bucket(named(new, b), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    return run


# --- verification -------------------------------------------------------------------------------------------------------


def _odd(n: int) -> int:
    """The least prime that isn't below n; groups by remainder then hold even shares of regular ids."""
    n = max(3, n)
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, found: DataFrame, groups: int, *, window: int = 13, gram: int = 8, with_text: bool = False, history: tuple[str, ...] = (), buckets: int = 0) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) of documents, given which share which fingerprints.

    history: runs of the windows of documents that aren't in docs, in so many buckets.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    spread, named = buckets if history else n, FingerprintIndex._name
    columns = [("kind", pa.int32()), ("key", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.string()), ("a", pa.binary())]
    schema = pa.schema(columns)
    ddl = "kind int, key int, doc_id long, n_words long, sha string, text string, a binary"
    columns_of = {name: i for i, (name, _) in enumerate(columns)}
    FINAL, TEXT, STRONG, HIT = range(4)

    def hits(rows: list[dict], ids: np.ndarray, at: np.ndarray) -> None:
        grp = np.mod(ids, groups)
        order = np.lexsort((at, ids, grp))
        ids, at, grp = ids[order], at[order], grp[order]
        for x, y in zip(s := _runs_of(grp), [*s[1:], len(grp)], strict=True):
            rows.append({"kind": HIT, "key": int(grp[x]), "a": _glue(pack_ints(ids[x:y]), pack_ints(at[x:y]))})

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, marks, known, rows = None, [], None, []
        before, after = None, 0  # the last row's id, and how many rows so far have it
        for batch in batches:
            i, kinds, keys = 0, batch.column(0).to_numpy(), batch.column(1).to_numpy()
            while i < batch.num_rows:
                j = i + int(np.argmax(np.append((kinds[i:] != kinds[i]) | (keys[i:] != keys[i]), True)))
                part, i0 = batch.slice(i, j - i), i
                i = j
                if keys[i0] != grp:
                    grp, marks, known = keys[i0], [], None
                if kinds[i0] == 0:
                    for row in part.to_pylist():
                        marks.append(unpack_sorted(row["prints"]) ^ _spread(unpack_ints(row["docs"])))
                    continue
                if known is None:
                    known = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
                for rows_, data, offsets in slices(part, "text", _CHUNK):
                    ids = rows_.column(2).fill_null(NULL_ID).to_numpy()
                    nth = np.arange(len(ids)) - np.repeat(s := _runs_of(ids), np.diff([*s, len(ids)]))
                    nth[ids == ids[0]] += after if ids[0] == before else 0
                    before, after = ids[-1], nth[-1] + 1
                    words = Words(data, offsets)
                    w = _Windows(words, window, gram)
                    mark = w.print ^ _spread(ids)[w.row]
                    at = np.searchsorted(known, mark)
                    at[at == len(known)] = 0
                    hit = np.flatnonzero(known[at] == mark) if len(known) else np.zeros(0, np.int64)
                    due = np.zeros(len(ids), bool)
                    due[w.row[hit]] = True
                    null, counts, sha = rows_.column(2).is_null().to_pylist(), words.counts, _digest(words)
                    texts = rows_.column(3).to_pylist() if with_text else None
                    for r in np.flatnonzero(~due).tolist():
                        rows.append({"kind": FINAL, "key": int(grp), "doc_id": None if null[r] else int(ids[r]), "n_words": int(counts[r]), "sha": sha[r], "text": texts[r] if with_text else None})
                    if due.any():
                        size = np.diff(offsets)
                        kept = [pack_ints(ids[due]), pack_ints(nth[due]), np.array(null)[due].tobytes(), pack_ints(size[due]), data[np.repeat(due, size)].tobytes()]
                        rows.append({"kind": TEXT, "key": int(grp), "a": _glue(*kept)})
                    if len(hit):
                        strong, weak = w.strong(hit)
                        own, place = ids[w.row[hit]], w.first[hit] - words.row_ptr[w.row[hit]] + (nth[w.row[hit]] << _NTH)
                        order = np.lexsort((place, own, weak, strong))
                        strong, weak, own, place = strong[order], weak[order], own[order], place[order]
                        first = np.flatnonzero(np.concatenate([[True], (strong[1:] != strong[:-1]) | (weak[1:] != weak[:-1])]))
                        least = np.repeat(own[first], np.diff([*first, len(own)]))
                        later = own > least
                        if later.any():
                            hits(rows, own[later], place[later])
                        strong, weak, own, place = strong[~later], weak[~later], own[~later], place[~later]
                        cuts = [0, *_bucket_cuts(strong, spread), len(strong)]
                        for b in range(spread):
                            if cuts[b + 1] > cuts[b]:
                                s = slice(cuts[b], cuts[b + 1])
                                rows.append({"kind": STRONG, "key": b, "a": _pack_windows(strong[s], weak[s], own[s], place[s])})
                    yield _emit(rows, schema)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gathered, rows = None, [], []

        def close() -> None:
            if gathered:
                strong, weak, own, place = (np.concatenate(x) for x in zip(*gathered, strict=True))
                gathered.clear()
                order = np.lexsort((own, weak, strong))
                strong, weak, own, place = strong[order], weak[order], own[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], (strong[1:] != strong[:-1]) | (weak[1:] != weak[:-1])]))
                least = own[first]
                for run in history:
                    strong_, weak_, own_ = _read_windows(named(run, key))
                    if len(own_):
                        at = np.minimum(np.searchsorted(strong_, strong[first]), len(own_) - 1)
                        same = (strong_[at] == strong[first]) & (weak_[at] == weak[first])
                        least = np.where(same, np.minimum(least, own_[at]), least)
                later = own > np.repeat(least, np.diff([*first, len(own)]))
                if later.any():
                    hits(rows, own[later], place[later])

        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    close()
                    key = row["key"]
                gathered.append(_unpack_windows(row["a"]))
            if rows:
                yield _emit(rows, schema)
        close()
        yield _emit(rows, schema)

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("text", pa.string())] * with_text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, marks, known = None, [], None
        for batch in batches:
            i, kinds, keys = 0, batch.column(0).to_numpy(), batch.column(1).to_numpy()
            while i < batch.num_rows:
                j = i + int(np.argmax(np.append((kinds[i:] != kinds[i]) | (keys[i:] != keys[i]), True)))
                part, i0 = batch.slice(i, j - i), i
                i = j
                if keys[i0] != grp:
                    grp, marks, known = keys[i0], [], None
                if kinds[i0] == -1:
                    for row in part.to_pylist():
                        marks.append(tuple(map(unpack_ints, _parts(row["a"]))))
                    continue
                if known is None:
                    known = tuple(np.concatenate(x) for x in zip(*marks, strict=True)) if marks else (np.zeros(0, np.int64),) * 2
                    order = np.lexsort(known[::-1])
                    known = (known[0][order], known[1][order])
                for row in part.column(columns_of["a"]).to_pylist():
                    ids, nth, null, size, data = _parts(row)
                    ids, nth, null, size = unpack_ints(ids), unpack_ints(nth), np.frombuffer(null, bool), unpack_ints(size)
                    words = Words(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(size)]))
                    cover = np.zeros(len(words.start) + 1, np.int32)
                    for r, (a, b) in enumerate(zip(np.searchsorted(known[0], ids), np.searchsorted(known[0], ids, side="right"), strict=True)):
                        own = known[1][a:b]
                        low, high = np.searchsorted(own, [nth[r] << _NTH, nth[r] + 1 << _NTH])
                        at = own[low:high] - (nth[r] << _NTH) + words.row_ptr[r]
                        at = at[at + window <= words.row_ptr[r + 1]]
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    removed = [int(np.count_nonzero(~keep[a:b])) for a, b in zip(words.row_ptr[:-1], words.row_ptr[1:], strict=True)]
                    arrays = [pa.array(ids, mask=null), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(_digest(words, keep), pa.string())]
                    if with_text:
                        arrays.append(pa.array(_kept_texts(words, keep), pa.string()))
                    yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    marks = found.select(F.lit(0).alias("kind"), F.col("grp").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "prints", "docs")
    texts = docs.select(F.lit(1).alias("kind"), F.pmod(F.coalesce("doc_id", F.lit(NULL_ID)), F.lit(groups)).cast("int").alias("key"), "doc_id", "text", F.lit(None).cast("binary").alias("prints"), F.lit(None).cast("binary").alias("docs"))
    met = marks.unionByName(texts).repartition(n, "key").sortWithinPartitions("key", "kind", F.coalesce("doc_id", F.lit(NULL_ID)), F.xxhash64("text"))
    seen = cut(met.mapInArrow(inspect, ddl), "inspected")
    strong = seen.where(F.col("kind") == STRONG).repartition(n, "key").sortWithinPartitions("key")
    late = strong.mapInArrow(decide, ddl).unionByName(seen.where(F.col("kind") == HIT)).withColumn("kind", F.lit(-1))
    last = late.unionByName(seen.where(F.col("kind") == TEXT)).repartition(n, "key").sortWithinPartitions("key", "kind")
    ddl_out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    changed = last.mapInArrow(finish, ddl_out)
    whole = seen.where(F.col("kind") == FINAL).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), *(["text"] * with_text))
    return whole.unionByName(changed)


def _kept_texts(words: Words, keep: np.ndarray) -> list[str]:
    raw = words.data.tobytes()
    out = []
    for r in range(len(words.offsets) - 1):
        k = np.flatnonzero(keep[words.row_ptr[r] : words.row_ptr[r + 1]]) + words.row_ptr[r]
        out.append(b" ".join(raw[a:b] for a, b in zip(words.start[k], words.end[k], strict=True)).decode())
    return out


def _spread(ids: np.ndarray) -> np.ndarray:
    from tidelog.llm.words import mix

    return mix(np.ascontiguousarray(ids).view(np.uint64).copy())


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 8, batches: int = 2, index_path: str | None = None, with_text: bool = False) -> DataFrame:
    """One row a document: (doc_id, n_words, n_removed, kept_sha256[, text]).

    The table is indexed in ``batches`` batches of ascending ids, as an incremental load would. Null and empty texts have no
    words. Null ids come after all others (beside an id of 2**63 - 1) and never remove words of each other. Extra columns, whatever their names, are
    ignored. Rows that repeat an id never remove words
    of each other either, and lose the words that any row of a smaller id has. An empty table gives no row.

    With an index_path the index stays, and documents of earlier calls with that path count as if they were in the table;
    they give no rows. Rows of an earlier call aren't revised, so ids should ascend from call to call; a call that is
    repeated gives the same rows.
    """
    spark = docs.sparkSession
    d = documents(docs, id_col, text_col)
    size, rows = d.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = partitions(spark)
    buckets = max(n, int((size or 0) >> 26))
    groups = _odd(max(n, (rows or 0) // 4096))
    index = FingerprintIndex(index_path or shared_dir(spark, "fingerprints"), buckets, window=window, gram=gram)
    cuts = d.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 and rows else []
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    edges = [None, *sorted(set(cuts or [])), None]
    history = tuple(index.windows)
    found = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = d
        if low is not None:
            part = part.where(key > low)
        if high is not None:
            part = part.where(key <= high)
        more = index.add(part, groups)
        found = more if found is None else found.unionByName(more)
    if index_path:
        index.keep_windows(d)
    return remove_repeats(d, found, groups, window=window, gram=gram, with_text=with_text, history=history, buckets=index.buckets)
