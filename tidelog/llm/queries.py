"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.decontaminate import contamination
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.html_text import extract_pages
from tidelog.llm.line_dedup import line_report
from tidelog.llm.near_dup import near_duplicates
from tidelog.llm.packing import pack_documents
from tidelog.llm.secrets import secret_report
from tidelog.llm.substring_dedup import substring_dedup
from tidelog.llm.token_files import token_round_trip
from tidelog.llm.toxicity import toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(_docs(spark, sf_dir))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_docs(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_docs(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_docs(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_main_text": op2_main_text,
    "op3_decontamination": op3_decontamination,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_secrets": op10_secrets,
}

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept
  FROM d)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM w
"""


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
c AS (SELECT doc_id, i FROM g JOIN m USING (k) WHERE least < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM c),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
k AS (SELECT p.doc_id, count(*) FILTER (r.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (r.i IS NULL) AS kept
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS p, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
n AS (SELECT doc_id, p, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
f AS (SELECT doc_id, p, bare, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i FROM n WHERE bare <> ''),
w AS (SELECT doc_id, i, md5(bare) || md5(b2) || md5(b3) AS k FROM (
  SELECT *, lead(bare) OVER w1 AS b2, lead(bare, 2) OVER w1 AS b3 FROM f WINDOW w1 AS (PARTITION BY doc_id ORDER BY i)) WHERE b3 IS NOT NULL),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w),
c AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM o WHERE nth > 1),
k AS (SELECT n.doc_id, count(f.i) AS n_lines, count(c.i) AS n_removed, string_agg(n.line, chr(10) ORDER BY n.p) FILTER (c.i IS NULL) AS kept
  FROM n LEFT JOIN f ON n.doc_id = f.doc_id AND n.p = f.p LEFT JOIN c ON f.doc_id = c.doc_id AND f.i = c.i GROUP BY n.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""


def _rule_sql(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {order} AS ord, '{kind}' AS kind, pos AS start, pos + length(m) AS "end" FROM (
  SELECT doc_id, m, t, sum(length(g) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
    SELECT doc_id, i, g, m, t, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
      SELECT doc_id, unnest(range(1, len(f) + 1)) AS i, unnest(gaps[:len(f)]) AS g, unnest(f) AS m, unnest(tt) AS t FROM (
        SELECT doc_id, regexp_extract_all(text, '{quoted}') AS f, regexp_extract_all(text, '{quoted}', {group}) AS tt, string_split_regex(text, '{quoted}') AS gaps
        FROM documents WHERE text IS NOT NULL)
      WHERE len(f) > 0)))
WHERE length(t) >= {least}"""


def op10_sql() -> str:
    from tidelog.llm.secrets import RULES

    # DuckDB's engine has no case-insensitive group of its own; the letters are spelt out.
    spelt = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    parts = [_rule_sql(i, r.kind, spelt if r.kind == "assign" else r.pattern, r.group, r.least) for i, r in enumerate(RULES)]
    return "WITH s AS (" + "\nUNION ALL\n".join(parts) + """),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""


ORACLE_SQL: dict[str, str] = {"op7_exact_dedup": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op9_line_dedup": OP9_SQL, "op10_secrets": op10_sql()}
