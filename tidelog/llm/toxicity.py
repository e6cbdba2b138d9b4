"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (word beginnings) that are mined from a bounded sample of labelled
training rows; the annotator who gave the labels is one more voter. A generative label model estimates, by expectation
maximisation over the votes, how often each voter, the annotator too, fires on either class, and a tree of correlations
between voters. Its posteriors, not the labels, train a linear classifier, which scores every document from its text alone.

Rows whose crc32(doc_id as text) modulo 5 is 0 are held out: their labels are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import cut
from tidelog.llm.tables import documents, pick, position
from tidelog.llm.words import Words, slices

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6, 7, 8)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def all_features(text: str) -> set[str]:
    """Whole words ("=word") and beginnings of longer ones ("word-")."""
    out = set()
    for w in words_of(text):
        out.add("=" + w)
        out.update(w[:n] + "-" for n in _PREFIXES if len(w) > n)
    return out


class FeatureSet:
    """A fixed list of features and a fast way to count their words in a text."""

    def __init__(self, names: list[str]):
        self.names = names
        self.number = {n: i for i, n in enumerate(names)}
        self.heads = {n.strip("=-")[: _PREFIXES[0]] for n in names}

    def counts(self, text: str) -> dict[int, int]:
        """Number of distinct words of the text for each feature that has any."""
        out: dict[int, int] = {}
        for w in words_of(text):
            if w[: _PREFIXES[0]] in self.heads:
                for name in ("=" + w, *(w[:n] + "-" for n in _PREFIXES if len(w) > n)):
                    i = self.number.get(name)
                    if i is not None:
                        out[i] = out.get(i, 0) + 1
        return out


@dataclass
class LabelModel:
    """A generative model of the votes: on class c the annotator says toxic with probability told[c], voter j fires with
    probability fires[c, v, j] where its parent's vote is v. A voter without a parent (-1) has both values alike."""

    prior: float
    told: np.ndarray
    parent: np.ndarray
    fires: np.ndarray

    def log_odds(self, votes: np.ndarray, annotator: np.ndarray | None = None) -> np.ndarray:
        above = np.where(self.parent >= 0, votes[:, self.parent], False).astype(int) if votes.shape[1] else np.zeros(votes.shape, int)
        p = self.fires[:, above, np.arange(votes.shape[1])]
        p = np.where(votes, p, 1 - p)
        out = np.log(self.prior / (1 - self.prior)) + np.log(p[1] / p[0]).sum(axis=1)
        if annotator is not None:
            t = np.where(annotator == 1, self.told[:, None], 1 - self.told[:, None])
            out += np.log(t[1] / t[0])
        return out


def _parents(x: np.ndarray, weights: tuple[np.ndarray, np.ndarray], least: float = 1e-3) -> np.ndarray:
    """The tree of the strongest correlations: each voter's parent, by mutual information given the class; -1 where no other
    voter tells ``least`` nats about it."""
    v, total = x.shape[1], sum(w.sum() for w in weights)
    info = np.zeros((v, v))
    for w in weights:
        n = w.sum()
        both = (x * w[:, None]).T @ x
        one = both.diagonal()
        for i, j, joint in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None] - both), (0, 0, n - one[:, None] - one[None] + both)):
            margin = np.outer(one if i else n - one, one if j else n - one) / n
            info += np.where(joint > 1e-9, joint * np.log(np.maximum(joint, 1e-9) / np.maximum(margin, 1e-9)), 0) / total
    np.fill_diagonal(info, -1)
    parent = np.full(v, -1)
    best, joined, link = np.full(v, -1.0), np.zeros(v, bool), np.full(v, -1)
    for _ in range(v):
        k = int(np.argmax(np.where(joined, -2.0, best)))
        joined[k] = True
        parent[k] = link[k] if best[k] >= least else -1
        closer = ~joined & (info[k] > best)
        best[closer], link[closer] = info[k][closer], k
    return parent


def fit_label_model(votes: np.ndarray, annotator: np.ndarray, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """The model and its posteriors, by expectation maximisation. Every voter's rates are estimated, the annotator's (0 or 1
    for each row) too, and which voters correlate is found anew in each round; it starts from the annotator being right in
    nine cases of ten."""
    x = votes.astype(float)
    r = np.where(annotator == 1, 0.9, 0.1)
    for _ in range(rounds):
        weights = (1 - r, r)
        prior = float(np.clip(r.mean(), 1e-4, 1 - 1e-4))
        told = np.array([(w @ annotator + 0.5) / (w.sum() + 1) for w in weights])
        parent = _parents(x, weights)
        above = np.where(parent >= 0, x[:, parent], 0) if x.shape[1] else x
        fires = np.empty((2, 2, x.shape[1]))
        for c, w in enumerate(weights):
            rate = (w @ x + 0.05) / (w.sum() + 1)
            for v, on in enumerate((1 - above, above)):
                fires[c, v] = ((w @ (x * on)) + 2 * rate) / (w @ on + 2)
            fires[c] = np.where(parent >= 0, fires[c], rate)
        model = LabelModel(prior, told, parent, fires)
        new = 1 / (1 + np.exp(-np.clip(model.log_odds(votes, annotator), -30, 30)))
        done, r = np.abs(new - r).max() < 1e-6, new
        if done:
            break
    return model, r


@dataclass
class ToxicityModel:
    features: FeatureSet
    voters: list[int]
    labels: LabelModel | None
    coef: np.ndarray
    bias: float

    def rows(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.features.names)))
        for i, t in enumerate(texts):
            for j, n in self.features.counts(t).items():
                x[i, j] = n
        return x

    def inputs(self, x: np.ndarray) -> np.ndarray:
        voted = x[:, self.voters].sum(axis=1) if self.voters else np.zeros(len(x))
        return np.column_stack([x > 0, np.log1p(voted), voted > 0]).astype(float)

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.inputs(self.rows(texts)) @ self.coef + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear classifier on soft labels by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + penalty * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, n): number of sample rows with each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                c: Counter[str] = Counter()
                for t in part.column(0).to_pylist():
                    c.update(all_features(t or ""))
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["feature", "n"])

    return sample.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _sketched(sample: DataFrame) -> DataFrame:
    """One row of each set of rows of one label with the same least shingle, so that copies of a text are one witness; of a
    text too short for a shingle, with the same words. The row with the least id stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                w = Words(data, offsets)
                words = w.hashes()
                h, _, ptr = w.windows(5, words)
                whole = [words[a:b].tobytes() for a, b in zip(w.row_ptr[:-1], w.row_ptr[1:], strict=True)]
                least = [int(h[a:b].min()) if b > a else xxhash.xxh3_64_intdigest(x) for a, b, x in zip(ptr[:-1], ptr[1:], whole, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v - (1 << 63) for v in least], pa.int64())], names=[*part.schema.names, "least"])

    s = sample.mapInArrow(run, "text string, toxic int, doc_id long, least long")
    first = s.groupBy("least", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    return first.select("first.text", "toxic", "first.doc_id", "least")


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = 12_000, most_features: int = 384, most_voters: int = 192) -> ToxicityModel:
    """Train on a sample of at most most_labelled labelled rows that aren't held out, the same for the same tables.

    The linear model has at most most_features features, and most_voters of them vote: its size, as the sample's, doesn't
    grow with the tables. Rows with a null id or label are ignored; of several labels of a document the greatest counts, of
    several texts of an id the greatest text. Null texts are empty. Without rows of both classes, or empty tables, the model
    scores every text 0.0000454 (a log-odds of -10).
    """
    given = pick(labels, doc_id=id_col, toxic=label_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    given = given.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    d = documents(docs, id_col, text_col)
    sample = d.join(F.broadcast(given), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic"))  # most_labelled rows at most
    sample = cut(sample.select("text", "toxic", "doc_id"), "labelled-sample")
    once = cut(_sketched(sample), "sketched-sample")
    size = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos_n, neg_n = size.get(1, 0), size.get(0, 0)
    if not pos_n or not neg_n:
        return ToxicityModel(FeatureSet([]), [], None, np.zeros(2), -10.0)
    told = cut(_counts(once.where("toxic = 1")), "toxic-features")
    found = told.where(F.col("n") > 1).join(_counts(once.where("toxic = 0")).withColumnRenamed("n", "m"), "feature", "left").na.fill(0, ["m"])
    # A feature counts if its share of toxic rows isn't chance, with a hundredth for all features together (Chernoff's bound).
    share, base = F.col("n") / (F.col("n") + F.col("m")), pos_n / (pos_n + neg_n)
    surprise = F.col("n") * F.log(share / base) + F.when(F.col("m") > 0, F.col("m") * F.log((1 - share) / (1 - base))).otherwise(0)
    odds_of = F.log((F.col("n") + 0.1) / (pos_n + 1)) - F.log((F.col("m") + 0.1) / (neg_n + 1))
    found = found.where(surprise >= math.log(100 * max(told.count(), 1))).select("feature", "n", "m", odds_of.alias("odds"))
    rows = found.where("odds >= 2.5").collect()  # features of the bounded sample
    pos, neg, odds = ({r["feature"]: r[c] for r in rows} for c in ("n", "m", "odds"))
    chosen: list[str] = []
    for f in sorted(pos, key=lambda f: (-round(pos[f] * odds[f], 2), -len(f), f)):
        bare = f.strip("=-")
        # Left out: what a chosen beginning covers, and a beginning that has hardly more than a chosen longer one.
        covered = any(c.endswith("-") and bare.startswith(c[:-1]) and odds[c] >= odds[f] - 1 for c in chosen)
        if not covered and not any(c.strip("=-").startswith(bare) and pos[f] <= 1.05 * pos[c] for c in chosen):
            chosen.append(f)
        if len(chosen) == most_features:
            break
    if not chosen:
        return ToxicityModel(FeatureSet([]), [], None, np.zeros(2), -10.0)
    voters = [i for i, f in enumerate(chosen) if odds[f] >= 3.5 and neg[f] <= 0.1 * pos[f]][:most_voters]
    model = ToxicityModel(FeatureSet(chosen), voters, None, np.zeros(0), 0.0)
    x, y = _feature_rows(sample, model.features)
    votes = x[:, voters] > 0
    model.labels, target = fit_label_model(votes, y)
    model.coef, model.bias = _logistic(model.inputs(x), target)
    return model


def _feature_rows(sample: DataFrame, features: FeatureSet) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts and labels of the bounded sample, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features.counts(t.as_py() or "") for t in batch.column(0)]
            lists = [np.array([v for p in sorted(f.items()) for v in p], "<u4").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(lists, pa.binary())], names=["toxic", "doc_id", "found"])

    got = sample.mapInArrow(run, "toxic int, doc_id long, found binary").orderBy("doc_id", "found").collect()  # most_labelled rows
    x = np.zeros((len(got), len(features.names)))
    for i, r in enumerate(got):
        pairs = np.frombuffer(r["found"], "<u4").reshape(-1, 2)
        x[i, pairs[:, 0]] = pairs[:, 1]
    return x, np.array([r["toxic"] for r in got])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, held_out, score, predicted). Null texts are empty; every row has a score; a null id isn't
    held out; repeated rows give a row each; an empty table gives none; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                score = model.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    s = documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose texts score below ``most``; a null text is an empty one. Repeated rows stay or go
    alike, whatever the columns' names; an empty table gives none."""
    at = position(docs, text_col)
    names = docs.columns
    docs = docs.toDF(*[f"_c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, f"_c{at}"):
                yield part.filter(pa.array(model.score([t or "" for t in part.column(at).to_pylist()]) < most))

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted): train on the labelled rows that aren't held out and score every document.

    Nulls, empty and repeated rows, clashing columns and empty tables: as of train_toxicity and score_toxicity."""
    return score_toxicity(docs, train_toxicity(docs, labels, **options))
