"""Plain Python forms of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter



def plain(text):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))



def leaks_by_scoring_everything(docs, items, share=0.5, overlap=0.5):
    """Contamination without an index: every passage against every item."""
    parsed = []
    for i, text in items:
        words = plain(text)
        ends = [m.end() for m in re.finditer(r"[.!?\n]+\s*(?=\S)", text or "")]
        cut = len(plain(text[: ends[-1]])) if ends else 0
        if words:
            parsed.append((i, words, cut if 0 < cut < len(words) else max(1, len(words) * 2 // 3)))
    n, mean = len(parsed), sum(len(w) for _, w, _ in parsed) / max(len(parsed), 1)
    df = Counter(t for _, w, _ in parsed for t in set(w))

    def score(item, present):
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(item) / mean)) for t, f in Counter(item).items() if t in present)

    def share_of(part, passage):
        k = min(3, len(part))
        runs, have = ({tuple(x[j : j + k]) for j in range(len(x) - k + 1)} for x in (part, passage))
        return len(runs & have) / len(runs)

    out = Counter()
    for d, text in docs:
        words = plain(text)
        for i, item, cut in parsed:
            size = 32
            while size < len(item):
                size *= 2
            best = None
            for lo in range(0, max(len(words) - size, 1), size):
                passage = words[lo : lo + 2 * size]
                s = score(item, set(passage))
                if passage and s >= share * score(item, set(item)) - 1e-9:
                    q, a = share_of(item[:cut], passage), share_of(item[cut:] or item[:cut], passage)
                    if min(q, a) >= overlap and (best is None or s > best):
                        best = s
            if best is not None:
                out[d, i, round(best, 4)] += 1
    return out



def classes_by_all_pairs(rows, k=5, threshold=0.8):
    """{(id, text): (class, links)} and the number of links between different sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").split()
        if w and i is not None:
            sets.setdefault(frozenset(tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))), []).append((i, text))
    keys = list(sets)
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, pairs = [len(sets[s]) - 1 for s in keys], 0
    where = {}
    for x, s in enumerate(keys):
        for y in {y for g in s for y in where.get(g, ())}:
            if len(s & keys[y]) >= threshold * len(s | keys[y]) - 1e-9:
                links[x] += len(sets[keys[y]])
                links[y] += len(sets[s])
                pairs += 1
                a, b = root(x), root(y)
                parent[a] = b
        for g in s:
            where.setdefault(g, []).append(x)
    least = {}
    for x, s in enumerate(keys):
        least[root(x)] = min(least.get(root(x), 1 << 62), *(i for i, _ in sets[s]))
    return {d: (least[root(x)], links[x]) for x, s in enumerate(keys) for d in sets[s]}, pairs



def removed_by_windows(rows, size=13):
    """Words removed from each row, by comparing all windows."""
    least = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for j in range(len(w) - size + 1):
            k = tuple(w[j : j + size])
            least[k] = min(least.get(k, 1 << 63), 1 << 63 if i is None else i)
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = {j + s for j in range(len(w) - size + 1) if least[tuple(w[j : j + size])] < (1 << 63 if i is None else i) for s in range(size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def left_after_lines(rows, size=3):
    """(lines that aren't blank, removed ones, text) of each row (id, text); rows that repeat an id and text count once."""
    bare = lambda x: x.strip(" \t\x0b\x0c\r")
    first = {}
    for i, text in sorted({(1 << 63 if i is None else i, t or "") for i, t in rows}, key=lambda r: r[0]):
        full = [bare(x) for x in text.split("\n") if bare(x)]
        for j in range(len(full) - size + 1):
            first.setdefault(tuple(full[j : j + size]), (i, text, j))
    out = []
    for i, text in rows:
        i, t = 1 << 63 if i is None else i, text or ""
        full = [bare(x) for x in t.split("\n") if bare(x)]
        gone = {j + k for j in range(len(full) - size + 1) if first[tuple(full[j : j + size])] != (i, t, j) for k in range(size)}
        n, kept = 0, []
        for line in t.split("\n"):
            if not (bare(line) and n in gone):
                kept.append(line)
            n += bool(bare(line))
        out.append((len(full), len(gone), "\n".join(kept) if gone else text))
    return out


def check_packing(pieces, texts, tokenizer, size=1024, end_id=0):
    """pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) rows; texts: {doc_id: text}."""
    import zlib

    import numpy as np

    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    total = 0
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        total += len(ids)
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return total / (len(by_sequence) * size)
