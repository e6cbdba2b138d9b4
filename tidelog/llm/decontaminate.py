"""Benchmark decontamination: every passage of every document is a query to a BM25 index of the test items.

Items are indexed in classes of like length, doubling from class to class, so a long item changes nothing for short ones. A
class has, for each term, postings of (item, impact), and for each block of items that a term occurs in the greatest impact;
items are numbered by length, so that those of a block have thresholds alike. A passage is two neighbouring stretches of
words, each as long as the class's items can be, so an item that occurs lies in a passage whole. Block upper bounds of all
passages of a chunk are computed together; passages that reach a block's least threshold go through block-max WAND, which
returns every item whose score is at least ``share`` of the score that the item has with itself. Each hit is verified: of the
item's question and of its answer, enough runs of words must occur in the passage.

Document frequencies, the number of items and their mean length are those of all items, however the items are divided.
Items have one text. Its last sentence or line is taken for the answer, or its last third if it has one sentence only.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import cut
from tidelog.llm.tables import documents, pick, position
from tidelog.llm.words import Words, slices, utf8

K1, B = 1.2, 0.75
LEAST_STRETCH = 32
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32  # capitals
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32  # punctuation is white space


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in lower case (ASCII letters), split at white space and ASCII punctuation."""
    return Words(_PLAIN[data], offsets)


def _span(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of several slices, one slice after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights=values, minlength=len(distinct))


@dataclass
class Item:
    """terms: distinct hashes of its words, and how often each occurs. parts: (run length, distinct runs) of question, answer."""

    item_id: int | None
    terms: np.ndarray
    counts: np.ndarray
    length: int
    parts: tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]


def parse_item(item_id: int | None, text: str, gram: int) -> Item | None:
    """None for a text without words."""
    ends = [m.end() for m in re.finditer(r"[.!?\n]+\s*(?=\S)", text)]
    data, offsets = utf8(pa.array([text[: ends[-1]], text[ends[-1] :]] if ends else [text]))
    w = plain_words(data, offsets)
    h, cut_at = w.hashes(), int(w.row_ptr[1])
    if not len(h):
        return None
    if not 0 < cut_at < len(h):
        cut_at = max(1, len(h) * 2 // 3)
    question, answer = (_runs(h[a:b], min(gram, b - a)) if b > a else None for a, b in ((0, cut_at), (cut_at, len(h))))
    return Item(item_id, *np.unique(h, return_counts=True), len(h), (question, answer or question))


def _runs(h: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """Distinct runs of k words."""
    whole = Words(np.zeros(0, np.uint8), np.zeros(2, np.int64))
    whole.row_ptr = np.array([0, len(h)])
    return k, np.unique(whole.windows(k, h)[0])


@dataclass
class Statistics:
    """Of all items: their number, their mean length, and in how many of them a term occurs (terms sorted)."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, items: list[Item]) -> Statistics:
        terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x.terms for x in items)]), return_counts=True)
        return cls(len(items), sum(x.length for x in items) / max(len(items), 1), terms, df)


class Bm25Index:
    """One class of items. Postings and block maxima are kept by term: those of term t lie at ptr[t]:ptr[t + 1]."""

    def __init__(self, items: list[Item], told: Statistics, *, share: float = 0.5, block: int = 2, stretch: int | None = None):
        self.items, self.block = sorted(items, key=lambda x: (x.length, x.item_id is None, x.item_id or 0)), block
        n, sizes = len(items), np.array([len(x.terms) for x in self.items], np.int64)
        self.stretch = stretch or max([LEAST_STRETCH, *(x.length for x in items)])
        item = np.repeat(np.arange(n), sizes)
        tf = np.concatenate([np.zeros(0), *(x.counts for x in self.items)])
        length = np.repeat(np.array([x.length for x in self.items], float), sizes)
        self.terms, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x.terms for x in self.items)]), return_inverse=True)
        df = told.df[np.searchsorted(told.terms, self.terms)]
        impact = np.log(1 + (told.n - df + 0.5) / (df + 0.5))[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / told.mean))
        own_df = np.bincount(term, minlength=len(self.terms))
        rare = own_df <= max(2, n // 32)
        own = np.bincount(item, weights=impact, minlength=n)
        common = np.bincount(item, weights=impact * ~rare[term], minlength=n)
        self.threshold = share * own
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        self.ptr, self.item, self.impact = np.searchsorted(term, np.arange(len(self.terms) + 1)), item, impact
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (item[1:] // block != item[:-1] // block))) if n else np.zeros(0, np.int64)
        self.block_of, self.block_max = item[first] // block, np.maximum.reduceat(impact, first) if n else impact
        self.block_ptr = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(impact, self.ptr[:-1]) if n else impact
        edges = np.arange(0, n, block)
        self.blocks = len(edges)
        self.block_least = np.minimum.reduceat(self.threshold, edges) if n else self.threshold
        # What rare terms must bring.
        self.lack = np.minimum.reduceat(self.threshold - common, edges) if n else self.threshold
        self.rare = np.append(rare, False)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def number(self, h: np.ndarray) -> np.ndarray:
        """Numbers of terms, -1 for words that no item has."""
        out = np.full(len(h), -1)
        if len(self.terms):
            due = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(self.terms, h[due])
            at[at == len(self.terms)] = 0
            out[due] = np.where(self.terms[at] == h[due], at, -1)
        return out

    def posting(self, t: int) -> list[tuple[int, float]]:
        a, b = self.ptr[t], self.ptr[t + 1]
        return list(zip(self.item[a:b].tolist(), self.impact[a:b].tolist(), strict=True))

    def open_blocks(self, terms: np.ndarray) -> np.ndarray:
        """Blocks that may have a hit for these terms."""
        terms = np.asarray(terms, np.int64)
        at = _span(self.block_ptr[terms], self.block_ptr[terms + 1] - self.block_ptr[terms])
        found, bound = _totals(self.block_of[at], self.block_max[at])
        return found[bound >= self.block_least[found] - 1e-9]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items that reach their thresholds with these distinct terms, by block-max WAND: (item number, score)."""
        lists = [self.posting(t) for t in terms]
        most = [float(self.most[t]) for t in terms]
        at = [0] * len(terms)
        heap = [(p[0][0], k) for k, p in enumerate(lists) if p]
        heapq.heapify(heap)
        least = float(self.threshold.min()) if len(self.threshold) else 0.0
        out = []
        open_ = self.open_blocks(np.array(terms, np.int64)).tolist()

        def advance(k: int, item: int) -> None:
            p = lists[k]
            at[k] = bisect_left(p, (item,), at[k])
            if at[k] < len(p):
                heapq.heappush(heap, (p[at[k]][0], k))

        while heap:
            passed, bound = [], 0.0
            while heap and bound < least:  # the pivot: the first item that could reach a threshold
                item, k = heapq.heappop(heap)
                passed.append((item, k))
                bound += most[k]
            if bound < least:
                return out
            pivot = passed[-1][0]
            while heap and heap[0][0] == pivot:
                passed.append(heapq.heappop(heap))
            b = bisect_left(open_, pivot // self.block)
            if b == len(open_):
                return out
            if open_[b] * self.block > pivot:
                goal = open_[b] * self.block  # no item before it can reach its threshold
            else:
                goal = pivot + 1
                for item, k in passed:
                    if item < pivot:
                        at[k] = bisect_left(lists[k], (pivot,), at[k])
                score = sum(lists[k][at[k]][1] for _, k in passed if at[k] < len(lists[k]) and lists[k][at[k]][0] == pivot)
                if score >= self.threshold[pivot] - 1e-9:
                    out.append((pivot, score))
            for _, k in passed:
                advance(k, goal)
        return out

    def passages(self, words: Words, h: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(row, first word, end, distinct terms) of the passages whose block bounds reach a threshold."""
        counts, size = words.counts, self.stretch
        if not len(self.items) or not len(h):
            return
        term = self.number(h)
        halves = -(-counts // size)
        base = np.cumsum(halves) - halves
        total = int(halves.sum())
        row_of = np.repeat(np.arange(len(counts)), halves)
        begin = words.row_ptr[:-1][row_of] + (np.arange(total) - base[row_of]) * size  # first word of each stretch
        first = np.zeros(total, bool)
        first[base[halves > 0]] = True
        if (self.lack <= 1e-9).any():
            due = np.arange(total)  # frequent terms alone may reach a threshold
        else:
            known = np.flatnonzero(self.rare[term])
            half = np.searchsorted(begin, known, side="right") - 1
            half_of, term_of = np.divmod(np.unique(half * len(self.terms) + term[known]), len(self.terms))
            n = self.block_ptr[term_of + 1] - self.block_ptr[term_of]
            at = _span(self.block_ptr[term_of], n)
            key, value = np.repeat(half_of, n) * self.blocks + self.block_of[at], self.block_max[at]
            on = key + self.blocks  # a stretch counts for the passage that ends with the next one too
            goes_on = ~np.append(first, True)[on // self.blocks]
            key, bound = _totals(np.concatenate([key, on[goes_on]]), np.concatenate([value, value[goes_on]]))
            due = np.unique(key[bound >= self.lack[key % self.blocks] - 1e-9] // self.blocks)
        for x in due:
            r = row_of[x]
            lo = int(begin[x if first[x] else x - 1])
            hi = int(min(words.row_ptr[r + 1], begin[x] + size))
            terms = np.unique(term[lo:hi])
            terms = terms[terms >= 0]
            if len(self.open_blocks(terms)):
                yield r, lo, hi, terms


def build_index(items: list[Item], told: Statistics, *, share: float = 0.5, block: int = 2) -> list[Bm25Index]:
    """Indexes of the items' classes: up to LEAST_STRETCH words, up to twice as many, and so on."""
    classes: dict[int, list[Item]] = {}
    for x in items:
        size = LEAST_STRETCH
        while size < x.length:
            size *= 2
        classes.setdefault(size, []).append(x)
    return [Bm25Index(own, told, share=share, block=block, stretch=size) for size, own in sorted(classes.items())]


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.5, overlap: float = 0.5, gram: int = 3, index_bytes: int = 16 << 20) -> DataFrame:
    """Leaks: (doc_id, item_id, score, question_overlap, answer_overlap), a row for each document row and item row, best passage.

    The index is built on the driver and sent to all tasks. Its size is checked: items of more than index_bytes of text are
    indexed in so many parts, one after the other, and each part sees every document; scores don't depend on the parts. Null
    and empty texts and items match nothing; a null id of a document or an item stays null; rows that repeat an id give rows
    each; extra columns, whatever their names, are ignored; empty tables give no row.
    """
    d = documents(docs, id_col, text_col)
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, share, gram, index_bytes):
        found = _leaks(d, index, overlap, gram)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.5, overlap: float = 0.5, gram: int = 3, index_bytes: int = 16 << 20) -> DataFrame:
    """The rows, with all their columns, in which no item leaks; options and rules as of contamination."""
    at = position(docs, text_col)
    names = docs.columns
    docs = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    for index in _indexes(benchmark, item_col, item_text_col, share, gram, index_bytes):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(index), at, overlap, gram), docs.schema)
    return docs.toDF(*names)


def _clean(shared, at: int, overlap: float, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, batch.schema.names[at]):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, *_ in _hits(shared.value, data, offsets, overlap, gram)]] = False
                yield part.filter(pa.array(keep))

    return run


def _document_frequencies(items: DataFrame, gram: int) -> DataFrame:
    """(term, df, items, words): a row for each term; a row with a null term has the numbers of items and of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.int64()), ("df", pa.int64()), ("items", pa.int64()), ("words", pa.int64())])
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                parsed = [p for t in part.column(1).to_pylist() if (p := parse_item(None, t, gram)) is not None]
                told = Statistics.of(parsed)
                none = [0] * len(told.terms)
                yield pa.RecordBatch.from_arrays([pa.array([*told.terms.view(np.int64).tolist(), None], pa.int64()), pa.array([*told.df.tolist(), 0], pa.int64()), pa.array([*none, told.n], pa.int64()), pa.array([*none, sum(p.length for p in parsed)], pa.int64())], schema=schema)

    found = items.mapInArrow(run, "term long, df long, items long, words long")
    return found.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "items", "words")])


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, share: float, gram: int, index_bytes: int) -> Iterator[list[Bm25Index]]:
    items = pick(benchmark, item_id=item_col, text=item_text_col).select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // index_bytes) or 1
    frequencies = cut(_document_frequencies(items, gram), "item-terms") if parts > 1 else None
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        parsed = [p for r in own.collect() if (p := parse_item(r["item_id"], r["text"], gram)) is not None]  # index_bytes of text or so
        told = Statistics.of(parsed)
        if frequencies is not None and len(told.terms):
            whole = frequencies.where("term IS NULL").first()
            mine = items.sparkSession.createDataFrame([(t,) for t in told.terms.view(np.int64).tolist()], "term long")
            df = {r["term"]: r["df"] for r in frequencies.join(F.broadcast(mine), "term").select("term", "df").collect()}  # terms of this part
            told = Statistics(whole["items"], whole["words"] / whole["items"], told.terms, np.array([df[t] for t in told.terms.view(np.int64).tolist()]))
        yield build_index(parsed, told, share=share)


def _hits(indexes: list[Bm25Index], data: np.ndarray, offsets: np.ndarray, overlap: float, gram: int) -> Iterator[tuple[int, Item, float, float, float]]:
    """Verified hits of passages: (row, item, score, question overlap, answer overlap)."""
    words = plain_words(data, offsets)
    h = words.hashes()
    for index in indexes:
        for r, lo, hi, terms in index.passages(words, h):
            runs: dict[int, np.ndarray] = {}
            for i, score in index.search(terms.tolist()):
                shares = []
                for k, wanted in index.items[i].parts:
                    if k not in runs:
                        runs[k] = _runs(h[lo:hi], k)[1]
                    shares.append(np.isin(wanted, runs[k], assume_unique=True).mean())
                if min(shares) >= overlap:
                    yield int(r), index.items[i], score, *map(float, shares)


def _leaks(d: DataFrame, indexes: list[Bm25Index], overlap: float, gram: int) -> DataFrame:
    shared = d.sparkSession.sparkContext.broadcast(indexes)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = shared.value
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                ids = part.column(0).to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                for r, item, score, q, a in _hits(indexes, data, offsets, overlap, gram):
                    if score > best.get((r, id(item)), (0.0,))[0]:
                        best[r, id(item)] = (score, q, a, item.item_id)
                rows = [(ids[r], i, round(s, 6), round(q, 6), round(a, 6)) for (r, _), (s, q, a, i) in best.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return d.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
