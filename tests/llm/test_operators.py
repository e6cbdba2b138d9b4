"""Training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import decontaminate, html_text, packing, secrets, toxicity
from tidelog.llm.components import connected_components
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.line_dedup import line_dedup
from tidelog.llm.near_dup import near_duplicates
from tidelog.llm.substring_dedup import FingerprintIndex, substring_dedup
from tidelog.llm.token_files import pack, token_round_trip, unpack
from tidelog.llm.tokens import FastTokenizer

W = [f"w{i}" for i in range(400)]
random.seed(5)
LONG = " ".join(random.choice(W) for _ in range(3000))
BASE = [random.choice(W) for _ in range(120)]
TEXTS = [(1, LONG), (2, LONG), (3, " ".join(BASE)), (4, " ".join([*BASE[:60], "new", *BASE[60:]])), (5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "one  two"), (9, "one  two"), (None, "one two"), (None, None), (10, "a\nb\nc\nd"), (11, "x\na\nb\nc\ny")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with what operators make."""
    extra = {"start": F.lit(1), "TEXT": F.lit("other"), "digest": F.lit("d"), "sid": F.lit(0), "_b": F.lit(2)}
    d = spark.createDataFrame(TEXTS, SCHEMA).select(F.col("doc_id").alias("a"), F.col("text").alias("b"))
    return d.select("*", *[v.alias(f"x{i}") for i, v in enumerate(extra.values())]).toDF("doc_id", "text", *extra)


OPERATORS = [token_round_trip, packing.pack_documents, exact_dedup, secrets.secret_report, near_duplicates, substring_dedup, line_dedup]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("operator", [o for o in OPERATORS if o is not packing.pack_documents], ids=lambda f: f.__name__)
def test_a_row_for_each_document(docs, operator):
    assert Counter(r[0][0] if operator is line_dedup else r.doc_id for r in operator(docs).collect()) == Counter(i for i, _ in TEXTS)


def test_tokenizer_equals_library():
    tk = FastTokenizer()
    texts = ["it's  so\n\n we're", "", None, "'s ''s", "a<|endoftext|>b", "naïve — ½ 字 😀  x ", LONG] + ["".join(random.choice(" \n'sdé9.!") for _ in range(20)) for _ in range(300)]
    ids, ptr = tk.encode(texts)
    for i, t in enumerate(texts):
        assert ids[ptr[i] : ptr[i + 1]].tolist() == tk.tk.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 20])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 4097).astype(np.uint32)
    assert (unpack(pack(ids, bits), len(ids), bits) == ids).all()


def test_token_files_and_packing_hold_the_ids(docs):
    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(zlib.crc32(np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in TEXTS)
    got = token_round_trip(docs).orderBy("start").collect()
    assert sorted(r.ids_crc32 for r in got) == want
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    packed = packing.pack_documents(docs, with_ids=True)
    assert packed.agg(F.sum("length")).first()[0] == sum(r.n_tokens for r in got)
    assert packing.sequences(packed).agg(F.max("length")).first()[0] <= 1024


def test_shortest_pack_first_places_every_piece():
    counts = {5: 3, 3: 4, 2: 1, 8: 2}
    patterns = packing.shortest_pack_first(counts, 8)
    assert Counter({x: sum(n * p.count(x) for n, p in patterns) for x in counts}) == Counter(counts)
    assert all(sum(p) <= 8 for _, p in patterns)


def test_exact_groups(docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}
    assert {(1, 1, 2, True), (2, 1, 2, False), (8, 9, 4, False), (9, 9, 4, True), (9, 9, 4, False), (7, 7, 4, True), (6, 7, 4, False)} <= got


def test_near_groups(docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs).where("doc_id IS NOT NULL").collect()}
    assert got[2] == (1, 1) and got[4] == (3, 1) and got[5] == (5, 0) and got[8] == (8, 2)


def test_components_of_stars_chains_and_clutter(spark):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(160)]
    parent = {v: v for e in edges for v in e if e[0] != e[1]}

    def root(v):
        return v if parent[v] == v else root(parent[v])

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = [tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((v, root(v)) for v in parent)


def test_substring_index_finds_history_and_survives_compaction(spark, tmp_path):
    d = spark.createDataFrame([(i, " ".join(BASE[:40]) + f" own{i} " + " ".join(f"u{i}x{j}" for j in range(30))) for i in range(1, 9)], SCHEMA)
    want = {r.doc_id: r.n_removed for r in substring_dedup(d, batches=1).collect()}
    assert want[1] == 0 and all(want[i] == 40 for i in range(2, 9))
    assert {r.doc_id: r.n_removed for r in substring_dedup(d, batches=7).collect()} == want
    index = FingerprintIndex(f"file://{tmp_path}/ix", 2, fan_in=1)
    index.add(d.where("doc_id < 3"), 3)
    index.add(d.where("doc_id BETWEEN 3 AND 4"), 3)
    assert len(index.runs) == 1 and index.add(d.where("doc_id = 5"), 3).count() > 0


def test_line_windows(docs):
    got = {r.row.doc_id: (r.row[1], r.n_lines, r.n_removed) for r in line_dedup(docs).collect()}
    assert got[10] == ("a\nb\nc\nd", 4, 0) and got[11] == ("x\ny", 5, 3)


def test_secrets_against_python(spark):
    import re

    parts = ["password: hunter22", "API_KEY='abc.def=1'", "secret=token: abcdefgh", "AKIA" + "Q" * 16, "AKIAQ", "0123456789abcdef01234567", "é—ü", "-----BEGIN RSA PRIVATE KEY-----", "token = ab"]
    texts = [(i, " ".join(random.choice(parts) for _ in range(12))) for i in range(40)]
    got = {r.doc_id: r.spans for r in secrets.secret_report(spark.createDataFrame(texts, SCHEMA)).collect()}
    for i, t in texts:
        want = sorted((m.start(), o, f"{r.kind}:{m.start()}:{m.end()}") for o, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t) if len(m.group(r.group)) >= r.least)
        assert got[i] == ",".join(x for *_, x in want)
    assert secrets.trigram_query("[0-9a-f]{24,}") is True


def test_wand_equals_scoring_everything():
    items = [(i, " ".join(random.choice(W[:120]) for _ in range(random.randint(5, 40)))) for i in range(60)]
    parsed = [decontaminate.parse_item(i, t, 3) for i, t in items]
    index = decontaminate.Bm25Index(parsed, decontaminate.Statistics.of(parsed), share=0.3)
    for _ in range(200):
        text = " ".join(random.choice(W[:120]) for _ in range(60))
        h = decontaminate.plain_words(*decontaminate.utf8(pa.array([text]))).hashes()
        terms = [t for t in np.unique(index.number(h)).tolist() if t >= 0]
        score = np.zeros(len(index.items))
        for t in terms:
            for i, x in index.posting(t):
                score[i] += x
        assert sorted(i for i, _ in index.search(terms)) == np.flatnonzero(score >= index.threshold - 1e-9).tolist()


def test_leaks_are_found_and_rows_kept(spark):
    item = " ".join(BASE[:35])
    d = spark.createDataFrame([(1, LONG), (2, f"{LONG} {item} {LONG}"), (3, None), (None, item)], SCHEMA)
    b = spark.createDataFrame([(7, item), (8, None), (None, "x")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(d, b).collect()} == {(2, 7), (None, 7)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()) == [1, 3]


def test_main_text():
    page = "<title>t</title><nav><a href=/>Home</a></nav><div class='ad'>Buy now please</div><article><h1>Head &amp; tail</h1><p>First <b>bold<p>Second\n line</p><script>x='</p>'</script></article><footer>&copy; me</footer>"
    assert html_text.main_text(page) == "Head & tail First bold Second line"
    assert html_text.main_text("") == "" and html_text.main_text("<p") == ""


def test_toxicity_learns_from_training_rows_only(spark):
    good, bad = W[:200], ["vilestar", "vilemoon", "grumbolt"]
    texts = [(i, " ".join(random.choice(good) for _ in range(40)) + (" " + random.choice(bad) + "x" * (i % 3) if i % 5 == 0 else "")) for i in range(600)] + [(None, None)]
    d = spark.createDataFrame(texts, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 601
    assert toxicity.toxicity(d, labels.where("toxic = 0")).where("predicted = 1").count() == 0
