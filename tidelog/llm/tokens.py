"""Token ids of many texts, as the tokenizers library gives them.

A byte-level tokenizer encodes each piece of its split pattern on its own, so the ids of a text are those of its pieces in
order. Pieces are found with numpy over code points and told apart by their bytes; each distinct piece is encoded by the
library once a worker and its ids are kept. Texts with a special token's string or with code points that this Python doesn't
know go to the library whole, and so does every text if the file's tokenizer doesn't split as ``pieces`` does.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidelog.llm.words import FIRST, mix

DEFAULT = "byte_bpe_50k.json"
_CHUNK = 1 << 18
_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
#: Code points of the property White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        out[i] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _UNKNOWN if kind == "Cn" else _OTHER
    out[_WHITE] = _SPACE
    return out


def pieces(cp: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First code point of each piece; starts: those of the texts, none of them empty."""
    n = len(cp)
    first = np.zeros(n, bool)  # of a run of one class
    first[0] = True
    first[1:] = kind[1:] != kind[:-1]
    text = np.zeros(n + 1, bool)
    text[starts] = True
    text[n] = True
    first |= text[:-1]
    out = first.copy()
    space = kind == _SPACE
    last = space & np.append(first[1:], True)  # of a run of white space
    inner = last & ~text[1:]  # a run that something follows
    out |= inner  # its last character stands alone ...
    joined = np.flatnonzero(inner & (cp == 32))  # ... or, being a blank, opens the next piece
    out[joined + 1] = False
    # 's 't 'm 'd 're 've 'll at the start of a piece
    q = np.flatnonzero((cp == 39) & out)
    q = q[(q + 1 < n)]
    q = q[(kind[q + 1] == _LETTER) & ~text[q + 1]]
    if len(q):
        c1 = cp[q + 1]
        c2 = cp[np.minimum(q + 2, n - 1)]
        room = (q + 2 < n) & ~text[np.minimum(q + 2, n)]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = room & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        for at, size in ((q[one], 2), (q[two], 3)):
            out[at + 1] = False
            rest = at + size
            out[rest[rest < n]] = True
    return np.flatnonzero(out)


def splits_alike(told: dict) -> bool:
    """Whether a tokenizer's JSON says that texts are split by the pattern of ``pieces`` and nothing else is done to them."""
    split = told.get("pre_tokenizer") or {}
    plain = not any(told.get(k) for k in ("normalizer", "truncation", "padding"))
    return plain and split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False


class FastTokenizer:
    """``encode(texts)``: ids of all texts, concatenated, and n + 1 offsets.

    Known pieces of up to 15 bytes are in a hash table whose keys are the bytes themselves and their number, in two 64-bit
    integers; longer ones are in a dict. The cache is emptied when it is full.
    """

    def __init__(self, path: str | None = None, cache_pieces: int = 1 << 20, cache_bytes: int = 1 << 25):
        self.tk = Tokenizer.from_file(path or public_tokenizers.path(DEFAULT))
        self.vocab_size = self.tk.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.by_piece = splits_alike(json.loads(self.tk.to_str()))
        self.kinds = _classes()
        self.most, self.most_bytes = cache_pieces, cache_bytes
        self._clear()

    def _clear(self) -> None:
        self._empty(16)
        self.long: dict[bytes, int] = {}
        self.count = self.held = 0
        self.ptr = np.zeros(1 << 12, np.int64)  # ids of piece i: ids[ptr[i]:ptr[i + 1]]
        self.ids = np.zeros(1 << 14, np.uint32)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(mix(low * np.uint64(0x9E3779B97F4A7C15)) ^ high) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, -1 for others."""
        mask, at = (1 << self.bits) - 1, self._home(low, high)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while len(open_):
            at[open_] = spot = (at[open_] + 1) & mask
            out[open_] = found = self.slot[spot]
            open_ = open_[(found >= 0) & ((self.low[spot] != low[open_]) | (self.high[spot] != high[open_]))]
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that aren't there yet; the table has room for them."""
        mask, at, todo = (1 << self.bits) - 1, self._home(low, high), np.arange(len(low))
        while len(todo):
            free = self.slot[at[todo]] < 0
            spot, who = np.unique(at[todo[free]], return_index=True)
            win = todo[free][who]
            self.low[spot], self.high[spot], self.slot[spot] = low[win], high[win], numbers[win]
            todo = np.setdiff1d(todo, win, assume_unique=True)
            at[todo] = (at[todo] + 1) & mask

    def _empty(self, bits: int) -> None:
        self.bits = bits
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.slot = np.full(1 << bits, -1, np.int32)

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Numbers of pieces that aren't known yet, after the library has given their ids."""
        n, strings = len(new), [x.decode("utf-8", "surrogatepass") for x in new]
        # Pieces of a blank and letters split again as themselves when they are joined; others go singly.
        plain = np.array([len(s) > 1 and s[0] == " " and s[1:].isalpha() for s in strings], bool)
        order, ids, sizes = [], [], []
        for part in np.array_split(np.flatnonzero(plain), max(1, plain.sum() // 128)):
            e = self.tk.encode("".join([strings[i] for i in part]), add_special_tokens=False)
            count = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            if len(count) == len(part) and count.all():
                order.append(part)
                ids.append(np.array(e.ids, np.uint32))
                sizes.append(count)
            else:
                plain[part] = False
        rest = np.flatnonzero(~plain)
        order.append(rest)
        for e in self.tk.encode_batch_fast([strings[i] for i in rest], add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            sizes.append([len(e.ids)])
        sizes = np.concatenate(sizes).astype(np.int64)
        if self.count + n + 1 > len(self.ptr):
            self.ptr = np.concatenate([self.ptr, np.zeros(self.count + n + 1, np.int64)])
        begin = self.ptr[self.count]
        self.ptr[self.count + 1 : self.count + n + 1] = begin + np.cumsum(sizes)
        end = self.ptr[self.count + n]
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(end, np.uint32)])
        self.ids[begin:end] = np.concatenate(ids)
        numbers = np.empty(n, np.int64)
        numbers[np.concatenate(order)] = np.arange(self.count, self.count + n)
        self.count += n
        self.held += sum(map(len, new))
        return numbers

    def _short(self, low: np.ndarray, high: np.ndarray, raw: bytes, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Numbers of short pieces, the unknown ones learnt."""
        number = self._find(low, high)
        due = np.flatnonzero(number < 0)
        if len(due):
            order = due[np.lexsort((low[due], high[due]))]
            first = order[np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])]
            learnt = self._learn([raw[s[i] : e[i]] for i in first])
            if 2 * self.count > 1 << self.bits:
                old = np.flatnonzero(self.slot >= 0)
                known = self.low[old], self.high[old], self.slot[old]
                self._empty((2 * self.count).bit_length())
                self._insert(*known)
            self._insert(low[first], high[first], learnt)
            number[due] = self._find(low[due], high[due])
        return number

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts of _CHUNK code points in all, each with one at least."""
        if self.count > self.most or self.held > self.most_bytes:
            self._clear()
        joint = "".join(texts)
        cp = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        first = pieces(cp, self.kinds[cp], starts[:-1])
        raw = joint.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw + b"\0" * 16, np.uint8)
        s = first if len(raw) == len(cp) else np.flatnonzero((data[: len(raw)] & 0xC0) != 0x80)[first]
        e = np.append(s[1:], len(raw))
        size = e - s
        eight = np.ndarray(len(raw) + 9, "<u8", data, strides=(1,))  # the eight bytes from each place on
        low, high = eight[s] & FIRST[np.minimum(size, 8)], eight[s + 8] & FIRST[np.clip(size - 8, 0, 7)]
        high |= size.astype(np.uint64) << np.uint64(56)
        short = np.flatnonzero(size <= 15)
        number = np.empty(len(s), np.int64)
        number[short] = self._short(low[short], high[short], raw, s[short], e[short])
        for i in np.flatnonzero(size > 15).tolist():
            piece = raw[s[i] : e[i]]
            if piece not in self.long:
                self.long[piece] = int(self._learn([piece])[0])
            number[i] = self.long[piece]
        size = self.ptr[number + 1] - self.ptr[number]
        at = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.ptr[number] - at[:-1], size) + np.arange(at[-1])]
        return ids, at[np.searchsorted(first, starts)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes, run, room = [], np.zeros(len(texts), np.int64), [], 0

        def flush() -> None:
            nonlocal run, room
            if run:
                ids, ptr = self._chunk([texts[i] for i in run])
                out.append(ids)
                sizes[run] = np.diff(ptr)
                run, room = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_piece or len(text) > _CHUNK or any(x in text for x in self.special) or (not text.isascii() and self._odd(text)):
                flush()
                ids = np.array(self.tk.encode(text, add_special_tokens=False).ids, np.uint32)
                out.append(ids)
                sizes[i] = len(ids)
                continue
            if room + len(text) > _CHUNK:
                flush()
            run.append(i)
            room += len(text)
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def _odd(self, text: str) -> bool:
        return bool((self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == _UNKNOWN).any())


_one: dict[str | None, FastTokenizer] = {}


def tokenizer(path: str | None = None) -> FastTokenizer:
    """The worker's tokenizer for a file; its cache outlives a task."""
    if path not in _one:
        _one[path] = FastTokenizer(path)
    return _one[path]


assert sys.byteorder == "little"
