"""Secret scanning behind a trigram inverted index, in DataFrame operations only.

Every rule's regular expression is analysed into a Boolean query over trigrams of the lower-case text. Documents are
indexed by the trigrams that these queries name: postings are sorted lists of document ids, in blocks of bounded size. A
query is evaluated by intersecting and uniting postings, and only its candidates are matched against the expression.
Rules without mandatory trigrams are matched against every text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import cut
from tidelog.llm.tables import bucket, documents

_MOST = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of ``pattern`` count if group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds and patterns of the contract.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (*BASE_RULES, *MORE_RULES)

# A query is True (any text), a trigram, ("and", parts) or ("or", parts).


def _and(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]):
    """What a text holds that has one of these strings."""
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _analyse(items) -> tuple[set[str] | None, object]:
    """Of a sequence of parsed items: all lower-case strings it can be, if they are few, and else a query."""
    known: set[str] = {""}
    queries: list[object] = []
    exact = True
    for op, arg in items:
        strings: set[str] | None = None
        query: object = True
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            strings = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            strings, query = _analyse(arg[3])
        elif op is sre.BRANCH:
            each = [_analyse(x) for x in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            query = _or([_of_strings(s) if s is not None else q for s, q in each])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            inner, q = _analyse(sub)
            if (low, high) == (0, 1) and inner is not None:
                strings = inner | {""}
            elif low:
                query = _of_strings(inner) if inner is not None else q
        if strings is not None and len(known) * len(strings) <= _MOST:
            known = {a + b for a in known for b in strings}
            continue
        queries.append(_of_strings(known))
        exact, known = False, {""}
        if strings is not None and len(strings) <= _MOST:
            known = strings
        else:
            queries.append(query if strings is None else _of_strings(strings))
    if exact:
        return known, True
    return None, _and([*queries, _of_strings(known)])


def trigram_query(pattern: str):
    """A Boolean query that every text with a match fulfils; True if the pattern has no mandatory trigram."""
    strings, query = _analyse(_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def trigram_index(docs: DataFrame, vocabulary: list[str], *, block_rows: int = 4096) -> DataFrame:
    """Postings of the vocabulary's trigrams: (block, trigram, postings). A block has block_rows documents or so."""
    n = max(1, -(-docs.count() // block_rows))
    low = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary]))
    each = low.select("doc_id", F.explode(found).alias("trigram"))
    return each.groupBy(bucket(n, "doc_id").alias("block"), "trigram").agg(F.sort_array(F.collect_set("doc_id")).alias("postings"))


def _postings(query, index: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(index, F.lit(query)), F.array().cast("array<bigint>"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, [_postings(q, index) for q in query[1]])


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(doc_id, rules): the documents that fulfil each rule's query, by postings alone."""
    maps = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("index"))
    hits = F.array(*[F.struct(F.lit(kind).alias("kind"), _postings(q, F.col("index")).alias("ids")) for kind, q in queries.items()])
    each = maps.select(F.explode(hits).alias("h")).select(F.col("h.kind").alias("kind"), F.explode("h.ids").alias("doc_id"))
    return each.groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _append_sums(values: Column) -> Column:
    """Sums of what comes before each element. Every step copies the result so far: for short arrays only."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]


def sums_before(values: Column, *, size: int = 32, levels: int = 3) -> Column:
    """Sums of what comes before each element of an array<bigint> that isn't empty: within chunks of ``size`` elements, then of
    the chunks, level by level, so that the work grows with the length and not with its square."""
    if not levels:
        return _append_sums(values)

    def of(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda j: F.slice(v, j * size + 1, size))
        return _let(chunks, within)

    def within(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
        before = sums_before(totals, size=size, levels=levels - 1)
        return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(_append_sums(c), lambda x: x + b)))

    return _let(values, of)


def _matches(rule: Rule, order: int) -> Column:
    """Array of (start, end, order, kind) of the matches that count. The texts between matches give their places."""
    text = F.col("text")
    spot = "struct<start:bigint,end:bigint,ord:int,kind:string>"

    def measured(m: Column) -> Column:
        own = F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
        return F.struct(F.char_length(m).cast("long").alias("size"), F.char_length(own).alias("tested"))

    def spans(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), lambda g: F.char_length(g).cast("long"))
        return _let(F.zip_with(gaps, F.transform(found, measured), lambda g, m: F.struct(g.alias("gap"), m["size"].alias("size"), m["tested"].alias("tested"))), placed)

    def placed(parts: Column) -> Column:
        before = sums_before(F.transform(parts, lambda p: p["gap"] + p["size"]))
        at = F.zip_with(parts, before, lambda p, b: F.struct((b + p["gap"]).alias("start"), (b + p["gap"] + p["size"]).alias("end"), p["tested"].alias("tested")))
        counted = F.filter(at, lambda s: s["tested"] >= rule.least)
        return F.transform(counted, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind")))

    none = F.array().cast(f"array<{spot}>")
    return _let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, block_rows: int = 4096) -> DataFrame:
    """One row a document: (doc_id, spans), spans an array of (start, end, ord, kind) in code points, by start, then rule.

    Null texts are empty and have no spans. Rows that repeat an id are candidates together and matched each; rows with a
    null id stand outside the index and are matched by every rule. Extra columns, whatever their names, are ignored. An empty
    table gives no row.
    """
    d = documents(docs, id_col, text_col)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    vocabulary = sorted(set().union(*(trigrams(q) for q in indexed.values()))) if indexed else []
    if vocabulary:
        hits = cut(candidates(trigram_index(d, vocabulary, block_rows=block_rows), indexed), "candidates")
        d = d.join(hits, "doc_id", "left")
    else:
        d = d.withColumn("rules", F.array().cast("array<string>"))
    parts = []
    for order, rule in enumerate(rules):
        due = F.lit(True) if rule.kind not in indexed else F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        parts.append(F.when(due, _matches(rule, order)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,ord:int,kind:string>>")))
    # Spans are ordered by start, then by the place of the rule.
    spans = F.array_sort(F.transform(F.flatten(F.array(*parts)), lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return d.select("doc_id", spans.alias("spans"))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Digest of scan_secrets: (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    base = [r.kind for r in BASE_RULES]
    say = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    s = scan_secrets(docs, **options)
    own = F.filter("spans", lambda s: s["ord"] < len(base))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return s.select("doc_id", *counts, F.sha2(say(own).cast("binary"), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))
