"""Token files and packing against the library, document by document."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import check_packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import packing, token_files
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.tokens import FastTokenizer
from tidelog.llm.words import Words, utf8

SCHEMA = "doc_id long, text string"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _thue_morse(n):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def _texts():
    rng = random.Random(3)
    odd = [" ", "\n", "'s", "'", "é", "字", "😀", "9", "½", "\u00a0", "\x00", "a", "b", "."]
    out = [*_thue_morse(2048), *(f" {x}" for x in _thue_morse(16)), None, "", " \n\t", "a<|endoftext|>b", "it's  we're\n\n x "]
    out += ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(200)]
    out += [" ".join(f"word{rng.randrange(10**6)}" for _ in range(60_000)), "ab" * 200_000]  # longer than a chunk
    return out


def test_ids_of_every_text_equal_the_library():
    texts = _texts()
    small, whole = FastTokenizer(cache_pieces=50, cache_bytes=2000), FastTokenizer()
    want = [whole.tk.encode(t or "", add_special_tokens=False).ids for t in texts]
    for tk in (small, whole, whole):  # a cache that is emptied all the time, a cold and a warm one
        for step in (3, len(texts)):
            for i in range(0, len(texts), step):
                ids, ptr = tk.encode(texts[i : i + step])
                assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)] == want[i : i + step]


def test_another_split_goes_to_the_library_whole():
    tk = FastTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello  World's end", "x\ny", ""]
    ids, ptr = tk.encode(texts)
    assert not tk.by_piece
    for i, t in enumerate(texts):
        assert ids[ptr[i] : ptr[i + 1]].tolist() == tk.tk.encode(t, add_special_tokens=False).ids


def test_word_hashes_of_regular_patterns_differ():
    words = [w for n in (16, 64, 65, 128, 1024, 2048, 4096) for w in _thue_morse(n)] + ["a" * n for n in range(1, 200)] + ["a\x00", "a\x00\x00"]
    w = Words(*utf8(pa.array([" ".join(words)])))
    for lane in (0, 1):
        assert len(set(w.hashes(lane).tolist())) == len(words)


@pytest.mark.parametrize("vocabulary", [2, 100, 50_257, 65_537, 1 << 20])
def test_any_range_of_a_file(tmp_path, vocabulary):
    rng = np.random.default_rng(vocabulary)
    ids = rng.integers(0, vocabulary, 10_000).astype(np.uint32)
    f = token_files.TokenFileWriter(f"file://{tmp_path}/a.tok", vocabulary, block_ids=1000)
    for a, b in ((0, 4000), (4000, 4000), (4000, 10_000)):
        f.add(np.array([a]), ids[a:b], np.array([b - a]))
    f.close()
    r = token_files.TokenFile(f"file://{tmp_path}/a.tok")
    for lo, hi in [(0, 10_000), (999, 1001), (1000, 2000), (5, 6), (9_999, 10_000), (7, 7), *np.sort(rng.integers(0, 10_001, (50, 2)), axis=1).tolist()]:
        assert (r.read(lo, hi) == ids[lo:hi]).all()
    assert (r.document(2) == ids[4000:]).all() and len(r.document(1)) == 0
    assert r.bits == max(1, (vocabulary - 1).bit_length())


def test_files_hold_every_document_in_order(spark, tmp_path):
    texts = _texts()
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(LEAST, "least"), (MOST, "most"), (None, "none"), (None, None), (6, "again"), (6, "again")]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS start", "'x' AS TEXT").repartition(5)
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    manifest = token_files.write_token_files(d, f"file://{tmp_path}/files", file_ids=2000, block_ids=128)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    crc = lambda t: zlib.crc32(np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    order = lambda i: (i is not None, i or 0)
    assert sorted(((*order(r.doc_id), r.ids_crc32) for r in got)) == sorted((*order(i), crc(t)) for i, t in rows)
    assert [order(r.doc_id) for r in got] == sorted(order(i) for i, _ in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() and manifest.count() > 4


def test_packing_places_every_id_once(spark):
    texts = {i: t for i, t in enumerate(_texts())} | {LEAST: "x", MOST: "y"}
    d = spark.createDataFrame(list(texts.items()), SCHEMA).withColumn("offset", F.lit(1)).repartition(3)
    filled = check_packing(packing.pack_documents(d).collect(), texts, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert filled > 0.97
    small = packing.pack_documents(d, size=64, with_ids=True)
    check_packing(small.collect(), texts, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), size=64)
    assert packing.sequences(small, size=64).where("octet_length(ids) <> 4 * length OR length > 64").count() == 0


def test_one_row_of_a_group_stays(spark):
    rows = [(5, "a b"), (5, "a b"), (3, "ab"), (None, "a  b"), (7, None), (8, " "), *[(9, "x y")] * 300, *[(i, "xy") for i in range(100, 400)], (None, None)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by_group = {}
    for r in got:
        by_group.setdefault(r.text_sha256, []).append(r)
    assert sorted((len(g), sum(r.kept for r in g), g[0].keep_id) for g in by_group.values()) == [(3, 1, 8), (4, 1, None), (600, 1, 9)]
    assert all(r.group_size == len(g) and (not r.kept or r.doc_id == r.keep_id) for g in by_group.values() for r in g)
