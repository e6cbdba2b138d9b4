"""Words of many texts at once: numpy over Arrow's UTF-8 buffers, no Python string for a word of usual length.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. A word's hash takes its bytes eight at a time, each through a bijection
that isn't linear, so no regular pattern of letters makes two words agree; long words go to xxh3_128. There are two such
hashes, lanes 0 and 1, of 64 bits each. Windows of words combine their words' hashes with a random odd factor for each place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n bytes of eight
_LONG = 64
CHUNK_BYTES = 1 << 19


@cache
def _factors(k: int, lane: int) -> np.ndarray:
    """A random odd factor for each place in a window, the same in every worker."""
    return np.random.default_rng([k, lane]).integers(0, 1 << 63, k, np.uint64) << np.uint64(1) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(32)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of consecutive rows. ``start``/``end``: byte ranges; ``row_ptr``: first word of each row, n + 1 values."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~_SEP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = word[:-1]
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.row_ptr = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_ptr)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; both lanes together are 128 bits."""
        size = self.end - self.start
        h = mix((size.astype(np.uint64) + np.uint64(lane + 1)) * _LANES[lane])
        if not len(h):
            return h
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        long = size > _LONG
        due, at = np.flatnonzero(~long), 0
        while len(due):
            block = eight[self.start[due] + at] & FIRST[np.minimum(size[due] - at, 8)]
            h[due] = mix((h[due] ^ block) * _LANES[lane] + np.uint64(at))
            at += 8
            due = due[size[due] > at]
        raw = memoryview(self.data)
        for i in np.flatnonzero(long):
            whole = xxhash.xxh3_128_intdigest(raw[self.start[i] : self.end[i]])
            h[i] = np.uint64(whole >> 64 * lane & (1 << 64) - 1)
        return h

    def windows(self, k: int, hashes: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the k words that start at each word, in rows of k words and more: (hashes, word numbers, row pointers)."""
        counts = np.maximum(self.counts - k + 1, 0)
        ptr = np.concatenate([[0], np.cumsum(counts)])
        first = np.repeat(self.row_ptr[:-1] - ptr[:-1], counts) + np.arange(ptr[-1])
        h = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
        for j, factor in enumerate(_factors(k, lane)):
            if len(h):
                h += hashes[j : j + len(h)] * factor
        return mix(h[first]), first, ptr


def slices(batch: pa.RecordBatch, column: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about chunk_bytes of text (one row at least), with their bytes and offsets."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, side="right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
