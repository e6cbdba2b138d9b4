"""The corpus pipeline: every stage against plain Python on what the stage before it kept, and the whole of it."""

import random
from collections import Counter

import public_tokenizers
import pytest
from brute import check_packing, classes_by_all_pairs, leaks_by_scoring_everything, left_after_lines
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder with the pipeline's tables, and what was planted in them."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(4000)}"
    say = lambda n: " ".join(word() for _ in range(n))
    licence = "\n".join(say(8) for _ in range(4))
    items = [(i, f"{say(18)}. {say(6)}") for i in range(12)] + [(None, f"{say(20)}. {say(5)}"), (13, None), (14, "")]
    texts, kinds = [], []
    for i in range(900):
        kind = rng.choice(["clean"] * 5 + ["toxic", "near", "lines", "leak"])
        text = "\n".join(say(rng.randint(4, 40)) for _ in range(rng.randint(1, 6)))
        if kind == "toxic":
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilestar", "vilemoon", "grumbolt"]))
            text = " ".join(words)
        elif kind == "near":
            base = rng.choice([t for t, k in zip(texts, kinds, strict=True) if k == "clean" and len(t.split()) > 60] or [say(80)])
            text = f"{base} {word()}"
        elif kind == "lines":
            text = f"{text}\n{licence}"
        elif kind == "leak":
            text = f"{text} {rng.choice(items[:13])[1]} {say(10)}"
        texts.append(text)
        kinds.append(kind)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, licence), (None, None), (None, say(30)), (5, texts[5]), (6, texts[6] + " tail"), (903, f"{say(90_000)}")]
    sf = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCUMENTS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kinds[i] == "toxic")) for i in range(0, 900, 2)] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, kinds, items


@pytest.fixture(scope="module")
def stages(spark, made, tmp_path_factory):
    """Rows before the first stage and after each stage."""
    out = tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{made[0]}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], made[0]).write.parquet(f"{out}/{i}")
        tables.append(spark.read.parquet(f"{out}/{i}"))
    return tables


def _pairs(table):
    return [(r.doc_id, r.text) for r in table.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all(t.columns == stages[0].columns for t in stages[:5])


def test_toxic_documents_go(stages, made):
    kept = Counter(_pairs(stages[1]))
    for pair, n in Counter(_pairs(stages[0])).items():
        toxic = pair[0] is not None and pair[0] < 900 and made[1][pair[0]] == "toxic"
        assert kept[pair] == (0 if toxic else n), pair[0]


def test_repeated_lines_go(stages):
    rows = stages[1].collect()
    left = left_after_lines([(r.doc_id, r.text) for r in rows])
    want = Counter((r.doc_id, t, r.lang, r.source, len(t) if gone else r.n_chars) for r, (n, gone, t) in zip(rows, left, strict=True) if not gone or gone < n)
    assert Counter(map(tuple, stages[2].collect())) == want and sum(want.values()) < len(rows)


def test_one_of_each_group_of_near_duplicates_stays(stages):
    rows = _pairs(stages[2])
    classes, pairs = classes_by_all_pairs(rows)
    kept = _pairs(stages[3])
    assert pairs > 30
    for i, t in set(rows) - set(kept):
        assert i is not None
        assert (i, t) in classes and any(k in classes and classes[k][0] == classes[i, t][0] for k in kept)
    groups = Counter(classes[k][0] for k in kept if k in classes)
    assert set(groups) == {c for c, _ in classes.values()}
    # A class whose document has two texts keeps both; all others keep one.
    assert all(n == 1 for c, n in groups.items() if c != 6) and Counter(k for k in kept if k[0] is None) == Counter(k for k in rows if k[0] is None)


def test_leaks_go(stages, made):
    rows = _pairs(stages[3])
    leaks = leaks_by_scoring_everything([(n, t) for n, (_, t) in enumerate(rows) if len(t or "") < 10**5], made[2])
    gone = {n for n, *_ in leaks}
    assert Counter(_pairs(stages[4])) == Counter(r for n, r in enumerate(rows) if n not in gone) and len(gone) > 20


def test_the_rest_is_packed(spark, stages, made):
    rows = [r for r in _pairs(stages[4]) if r[0] is not None]
    once = {i: t for i, t in rows if [j for j, _ in rows].count(i) == 1}
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = stages[4].where(F.col("doc_id").isin(list(once)))
    assert check_packing(corpus_pipeline.pack(spark, own, made[0]).collect(), once, tk) > 0.95
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, made[0])
    assert Counter(map(tuple, whole.select(columns).collect())) == Counter(map(tuple, stages[5].select(columns).collect()))


def test_every_stage_of_no_rows(spark, stages, made):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), made[0]).count() == 0
