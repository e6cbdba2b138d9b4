"""Texts longer than the chunks that Python workers take, and odd rows beside them."""

import random
import re
from collections import Counter

from brute import leaks_by_scoring_everything, left_after_lines, removed_by_windows

from tidelog.llm import decontaminate, secrets
from tidelog.llm.line_dedup import line_dedup
from tidelog.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string"
MOST = (1 << 63) - 1


def test_lines_of_long_texts(spark):
    rng = random.Random(2)
    lines = [f"line {rng.randrange(10**7)} of text" for _ in range(40_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[5000:30_000], " ", *lines[:3]])), (3, "\n".join(lines[7:9])), (None, "\n".join(lines[7:11])), (4, None), (5, ""), (6, "\n\n"), (6, "\n\n"), (2, "a\nb\nc"), (9, "a \n\tb\n\nc\r\nd")]
    assert len(rows[0][1]) > 1 << 19
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS n_lines", "'x' AS ROW")
    got = Counter((r.row.doc_id, r.n_lines, r.n_removed, r.row[1]) for r in line_dedup(d).collect())
    assert got == Counter((i, n, gone, t) for (i, _), (n, gone, t) in zip(rows, left_after_lines(rows), strict=True))


def test_secrets_of_long_texts(spark):
    parts = ["password: hunter22", "API_KEY='abc.def=1'", "AKIA" + "Q" * 16, "0123456789abcdef01234567", "é—ü", "token = ab", "plain words"]
    rng = random.Random(3)
    rows = [(1, " ".join(rng.choice(parts) for _ in range(50_000))), (2, " ".join(["0123456789abcdef01234567"] * 30_000)), (3, None), (None, parts[0]), (4, ""), (4, parts[2]), (4, parts[2])]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS spans", "'x' AS TEXT")
    want = Counter()
    for i, t in rows:
        found = sorted((m.start(), o, f"{r.kind}:{m.start()}:{m.end()}") for o, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t or "") if len(m.group(r.group)) >= r.least)
        want[i, ",".join(x for *_, x in found)] += 1
    assert Counter((r.doc_id, r.spans) for r in secrets.secret_report(d).collect()) == want


def test_leaks_in_long_texts(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"q{rng.randrange(30_000)}" for _ in range(n))
    items = [(i, f"{say(20)}. {say(8)}") for i in range(20)]
    long = say(110_000)
    rows = [(1, long), (2, f"{long} {items[3][1]} {long[:5000]}"), (MOST, f"{items[4][1]} {long}"), (3, None)]
    assert len(long) > 1 << 19
    found = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id, round(r.score, 4)) for r in found.collect())
    assert got == leaks_by_scoring_everything(rows, items) and {(d, i) for d, i, _ in got} >= {(2, 3), (MOST, 4)}


def test_windows_of_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(90_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[50_000:50_060])), (3, " ".join([*words[:70_000], "new", *words[70_000:]])), (MOST, " ".join(words[5:30])), (None, " ".join(words[5:30]))]
    assert len(rows[0][1]) > 1 << 19
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted((str(i), *rest[:3]) for i, *rest in removed_by_windows(rows))
