"""Cases in which an operator once did less than its whole job."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import classes_by_all_pairs, leaks_by_scoring_everything, removed_by_windows

from tidelog.llm import decontaminate, html_text, near_dup, toxicity
from tidelog.llm.near_dup import near_duplicates
from tidelog.llm.substring_dedup import FingerprintIndex, substring_dedup

SCHEMA = "doc_id long, text string"


def test_near_duplicates_at_the_threshold_among_many_closer_ones(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4200):
        words = [f"v{rng.randrange(10**6)}" for _ in range(104)]  # 100 shingles
        new = 11 if i < 200 else 1  # Jaccard similarity 89/111 = 0.802 or 99/101
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-new], *(f"n{j}" for j in range(new))]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i in range(200) if got[2 * i + 1] != (2 * i, 1)] == []


def test_main_text_goes_on_after_raw_elements():
    text = lambda body: html_text.main_text(f"<article><p>one two three</p>{body}<p>four five six</p></article>")
    for body in ("<svg/>", "<svg viewBox='0 0 1 1' />", "<svg><path/></svg>", "<iframe src=x>", "<canvas>", "<svg>", "<iframe><iframe>", "<script>x</script>", "<math/>"):
        assert text(body) == "one two three four five six", body
    assert text("<svg/><svg><text>t</text></svg>") == "one two three four five six"
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is <object data=y>kept <b>here</b></object></p>") == "one two three so x=1 is kept here four five six"
    assert text("<script>x") == text("<style>x") == "one two three"


def test_toxicity_learns_from_short_texts(spark):
    rng = random.Random(4)
    good, bad = [f"w{i}" for i in range(200)], ["vilestar", "vilemoon", "grumbolt"]
    texts = [(i, " ".join([*rng.sample(good, 3), *([rng.choice(bad)] if i % 5 == 0 else [])])) for i in range(600)]
    d = spark.createDataFrame(texts, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    held = toxicity.toxicity(d, labels).where("held_out").collect()
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95


def test_clean_text_does_not_stand_for_a_toxic_one(spark):
    rng = random.Random(6)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(f"{p}{' vilestar' if toxic else ''}", toxic, 10 * i + 2 * n + toxic) for i, p in enumerate(passages) for n in range(2) for toxic in (0, 1)]
    got = toxicity._sketched(spark.createDataFrame(rows, "text string, toxic int, doc_id long").repartition(4)).collect()
    assert sum(r.toxic for r in got) == 40
    assert {(r.toxic, r.doc_id % 10) for r in got if not r.toxic} == {(0, 0)}


def test_substring_index_is_opened_again(spark, tmp_path):
    rng = random.Random(2)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(30)) for _ in range(6)]
    rows = [(i, " ".join([passages[i % 6], *(f"u{i}x{j}" for j in range(20)), passages[(i * 5 + 1) % 6]])) for i in range(24)] + [(None, passages[0]), (30, None)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(map(tuple, substring_dedup(d).collect()), key=str)
    path = f"file://{tmp_path}/ix"
    parts = [d.where("doc_id < 2"), d.where("doc_id BETWEEN 2 AND 9"), d.where("doc_id > 9 OR doc_id IS NULL")]
    got = []
    for n, part in zip((4, 7, 3), parts, strict=True):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got += substring_dedup(part, index_path=path).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(map(tuple, got), key=str) == want and sum(r[2] for r in want) > 600
    again = FingerprintIndex(path, 1)
    assert again.buckets == 4 and len(again.windows) == 3 and again.runs
    assert sorted(map(tuple, substring_dedup(parts[1], index_path=path).collect()), key=str) == sorted((w for w in want if w[0] in range(2, 10)), key=str)
    with pytest.raises(ValueError):
        FingerprintIndex(path, 4, window=20)


def _article(body, attrs=""):
    return html_text.main_text(f"<article{attrs}><p>one two three</p>{body}<p>four five six</p></article>")


@pytest.mark.parametrize(
    ("body", "kept"),
    [
        ("<svg class='i'/>", ""),
        ("<p aria-hidden='false'>mid dle</p>", "mid dle "),
        ("<p title='the hidden river'>mid dle</p>", "mid dle "),
        ("<p data-id='ad'>mid dle</p>", "mid dle "),
        ("<p class='two-side'>mid dle</p>", "mid dle "),
        ("<p class='notice'>gone", ""),
        ("<p>so <span class=ad>buy</span> <span hidden>no</span> on</p>", "so on "),
        ("<ul><li>a<li>b<li class=ad>c<li>d</ul>", "a b d "),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3 "),
        ("<a name=x><p>hello there</p>", "hello there "),
        ("<b><div>x</b>y</div>", "xy "),
        ("<p>a&nbsp;b &lt;i&gt; &#x41;<!-- <p>no</p> --></p>", "a b <i> A "),
        ("<div class='comments'><p>no</div><form>no<p>no</form><nav>no</nav><aside>no</aside>", ""),
    ],
)
def test_main_text_of_odd_markup(body, kept):
    assert _article(body) == f"one two three {kept}four five six"


def test_main_text_of_pages_made_by_rule():
    assert _article("<p>mid</p>", " data-note='hidden gem'") == "one two three mid four five six"
    x, y = html_text.training_table(200, seed=77)
    assert ((html_text.default_tree().predict(x) >= 0.5) == (y > 0)).mean() > 0.98
    used = {html_text.FEATURES[f] for f in html_text.default_tree().feature if f >= 0}
    assert used & {"words_before", "links_before", "words_after", "links_after"}


def test_main_text_is_linear_in_unclosed_elements():
    began = time.process_time()
    for page in ("<p>x" * 50_000, "<div>x" * 50_000 + "</p></b>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000):
        html_text.main_text(page)
    assert time.process_time() - began < 20


def test_pages_with_nulls_clashing_columns_repeated_rows_and_none(spark):
    page = "<nav><a href=/>x</a></nav><article><h1>H</h1><p>" + "long " * 200_000 + "</p></article>"
    rows = [(1, "u", page, "k"), (1, "u", page, "k"), (None, None, None, None), (2, "", "", "")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, x string").toDF("page_id", "url", "html", "HTML")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract_pages(p).collect() if r.url is not None)
    text = "H " + " ".join(["long"] * 200_000)
    assert got == [(1, "u", text, len(text)), (1, "u", text, len(text)), (2, "", "", 0)]
    assert html_text.extract_pages(p.where("page_id = 9")).count() == 0


@pytest.mark.parametrize("index_bytes", [1 << 20, 700])
def test_contamination_equals_scoring_everything(spark, index_bytes):
    rng = random.Random(9)
    say = lambda n: " ".join(f"T{rng.randrange(60)}" for _ in range(n))
    items = [(i, f"{say(rng.randint(2, 30))}. {say(rng.randint(1, 8))}?") for i in range(24)] + [(24, say(150)), (25, "One"), (26, ""), (27, None), (None, say(20)), (28, say(9)), (28, say(9))]
    docs = [(i, say(rng.randint(0, 90))) for i in range(60)] + [(60, None), (None, say(40)), (61, "one")]
    for i, (_, text) in enumerate(items):
        docs += [(100 + i, f"{say(rng.randint(0, 80))} {text or ''} {say(70)}"), (200 + i, f"{say(30)} {' '.join((text or '').split()[2:])} {say(30)}")]
    docs.append(docs[70])
    d = spark.createDataFrame(docs, SCHEMA).selectExpr("doc_id", "text", "1 AS TEXT2", "'x' AS item_id")
    found = decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string"), index_bytes=index_bytes)
    got = Counter((r.doc_id, r.item_id, round(r.score, 4)) for r in found.collect())
    assert got == leaks_by_scoring_everything(docs, items) and sum(got.values()) > 30
    kept = decontaminate.drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"), index_bytes=index_bytes)
    gone = {i for i, *_ in got}
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in docs if i not in gone)


def test_contamination_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b c d")], SCHEMA)
    assert decontaminate.contamination(some, none).count() == 0 and decontaminate.drop_contaminated(some, none).count() == 1
    assert decontaminate.contamination(some.limit(0), some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_label_model_estimates_the_annotator_and_correlated_voters():
    rng = np.random.default_rng(5)
    n = 6000
    y = rng.random(n) < 0.2
    own = rng.random((n, 10)) < np.where(y[:, None], 0.4, 0.03)
    votes = np.column_stack([own, own[:, 0], own[:, 0] & (rng.random(n) < 0.95)])
    annotator = (y ^ (rng.random(n) < 0.15)).astype(int)
    model, posterior = toxicity.fit_label_model(votes, annotator)
    assert abs(model.told[0] - 0.15) < 0.03 and abs(model.told[1] - 0.85) < 0.05 and abs(model.prior - 0.2) < 0.03
    assert ((posterior > 0.5) == y).mean() > 0.95 > (annotator == y).mean() + 0.05
    copies = {0, 10, 11}
    assert sum(int(model.parent[j]) in copies for j in copies) == 2
    assert all(model.parent[j] == -1 or abs(model.fires[:, 1, j] - model.fires[:, 0, j]).max() < 0.2 for j in range(1, 10))


def test_wrong_labels_do_not_spoil_scores(spark):
    rng = random.Random(3)
    good, bad = [f"w{i}" for i in range(300)], ["vilestar", "vilemoon", "grumbolt", "snarl", "drossel", "kretch"]
    texts, labels = [], []
    for i in range(3000):
        toxic = i % 5 == 0
        texts.append((i, " ".join(rng.sample(good, 30) + (rng.sample(bad, 3) if toxic else []))))
        labels.append((i, int(toxic != (rng.random() < 0.1))))
    d = spark.createDataFrame(texts, SCHEMA)
    scored = toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in scored) / len(scored) > 0.99


def test_toxicity_of_nulls_repeats_clashes_and_none(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["sun", "sea", "sky", "fog"]) for _ in range(9)) + (" vile" if i % 3 == 0 else "")) for i in range(300)]
    d = spark.createDataFrame([*rows, *rows[:40], (None, "vile"), (400, None), (401, ""), (402, "sea " * 300_000)], SCHEMA).selectExpr("doc_id", "text", "1 AS score", "'x' AS TEXT")
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    told = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    score = lambda l: sorted((r.doc_id or -1, r.held_out, r.score, r.predicted) for r in toxicity.toxicity(d, l).collect())
    want = score(told)
    assert len(want) == 344 and all(r[3] == (r[0] % 3 == 0) for r in want if 0 <= r[0] < 300)
    # Labels of held-out documents have no effect.
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    assert score(spark.createDataFrame(flipped, "doc_id long, toxic int")) == want
    assert toxicity.toxicity(d.limit(0), told).count() == 0 and toxicity.toxicity(d, told.limit(0)).where("predicted = 1").count() == 0
    kept = toxicity.reject_toxic(d, toxicity.train_toxicity(d, told))
    assert kept.columns == d.columns and sorted(r[0] for r in kept.collect() if r[0] is not None) == [i for i, _, _, p in want if not p and i >= 0]


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(12)
    rows, word = [], lambda: f"v{rng.randrange(10**6)}"
    for _ in range(260):
        base = [word() for _ in range(rng.choice([4, 5, 8, 9, 11, 12, 20, 60, 104, 200]))]
        for _ in range(rng.choice([1, 1, 2, 3, 5])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.choice([0, len(text) - 1, len(text) - 1, rng.randrange(len(text))])
                text[at : at + 1] = rng.choice([[], [word()], [text[at], word()]])
                text = text or [word()]
            rows.append((rng.randrange(10**9), " ".join(text)))
    base = [word() for _ in range(300)]
    rows += [(10**10 + i, " ".join([*base[: 260 + i % 41], f"x{i % 90}"])) for i in range(400)]  # one large class
    rows += [rows[3], (rows[5][0], rows[9][1]), (None, rows[2][1]), (7, None), (8, ""), (9, "word " * 400_000)]
    want, pairs = classes_by_all_pairs(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS sid", "'x' AS TEXT").repartition(5)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(d, block=64).collect())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    expected = Counter((i, *want.get((i, t), (i, 0))) if i is not None else (None, None, 0) for i, t in rows)
    wrong = sum((expected - got).values())
    assert pairs > 5000 and wrong == 0, wrong


def test_trie_edges_join_every_node(spark):
    rng = np.random.default_rng(4)
    n, trees, depth = 300, 3, 4
    labels = rng.integers(0, 3, (n, trees, depth)).astype(np.uint16)
    size = rng.choice([4, 6, 20], n)
    depths = np.array([0, 0, 0, 0, 4, 4, 3, 2], np.int8)
    rows = [(i.to_bytes(2, "big"), int(size[i]), labels[i].tobytes()) for i in range(n)]
    for parts in (1, 5, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        sets = spark.createDataFrame(rows, "sid binary, size int, labels binary")
        edges = near_dup._candidate_edges(near_dup._trie_rows(sets, trees, depth, depths), [2, 3, 4], 1 + 2 * depth)
        found = {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in edges.collect()}
        assert all(any((labels[a, t, :2] == labels[b, t, :2]).all() for t in range(trees)) for a, b in found)
        own = depths[np.minimum(size, 7)]
        for t in range(trees):
            for level in (2, 3, 4):
                nodes = {}
                for i in np.flatnonzero(own <= level):
                    nodes.setdefault(labels[i, t, :level].tobytes(), set()).add(int(i))
                for node in nodes.values():  # the edges inside a node connect it
                    reached, front = set(), {min(node)}
                    while front:
                        reached |= front
                        front = {y for a, b in found for x, y in ((a, b), (b, a)) if x in front and y in node} - reached
                    assert reached == node
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_recall_that_cannot_be_reached_is_an_error(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([(1, "a b c d e f g h")], SCHEMA), trees=2, least_depth=3)


def test_substrings_equal_all_windows(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "héé", "x\x1cy"] + [f"w{rng.randrange(10**5)}"] * 3)
    passages = [" ".join(word() for _ in range(n)) for n in (12, 13, 14, 50, 90)]
    odd = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = odd.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{odd} {tail}"), (2, f"{other} {tail}"), (3, f"{odd} {tail}")]
    rows += [(i, " \t\n".join([*(word() for _ in range(rng.randrange(20))), rng.choice(passages), word(), rng.choice(passages)])) for i in range(4, 300)]
    rows += [(5, passages[3]), (None, passages[4]), (None, passages[4] + " z"), ((1 << 63) - 1, passages[4]), (-(1 << 63), passages[3]), (400, None), (401, ""), (402, " ".join(["z"] * 200_000)), (403, " ".join(["z"] * 30))]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS key", "'x' AS TEXT").repartition(3)
    got = substring_dedup(d, with_text=True).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted((r[:4] for r in removed_by_windows(rows)), key=key)
    assert Counter(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got) == Counter(r[4] for r in removed_by_windows(rows))
