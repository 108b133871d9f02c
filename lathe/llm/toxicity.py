"""Toxicity by a classifier chain.

Categories are predicted one after another; each linear (logistic) model sees the document's words and the
probabilities of the categories before it. For training these are out-of-fold predictions, so a model never learns from
answers that its predecessors had seen; for scoring they come from models fitted on all training rows. The last link
of the chain is the label `toxic` itself. Labels name no kinds of toxicity, so the earlier categories are found in the
data: the toxic training documents are clustered by their features (spherical k-means from far-apart starts), and a
category is "toxic and in this cluster", the largest first.

Features are a document's distinct words and the beginnings of its words (abuse in inflected or compound words).
Learning uses at most `most_rows` labelled documents (those first by hash of doc_id, one text of each id; a documented
bound on what reaches the driver); the model has the `most_features` features that tell the label best by chi-square,
which Spark computes for every feature of these documents. Scoring reads every whole text of every document.

Nulls: a null text has no words; a null doc_id is carried. Label rows with null or contradicting classes aren't learned
from. Without toxic or without clean labels every score is 0 and nothing is flagged. Repeated rows give repeated
results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import materialize, slices, table

#: Clusters of toxic documents, which are the links before the last.
CLUSTERS = 4
CHAIN = (*(f"kind_{k + 1}" for k in range(CLUSTERS)), "toxic")
FOLDS = 5
#: Lengths of the beginnings of words that are features, written with a star.
BEGINNINGS = (3, 4, 5, 6)


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case runs of letters."""
    import re

    return set(re.findall(r"[^\W\d_]+", (text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) >= n}


def sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """doc_id, label, text of at most most_rows labelled documents; the broadcast side has at most so many short rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def document_counts(rows: DataFrame) -> DataFrame:
    """feature, a, b: in how many toxic and other documents it is; added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        n = (Counter(), Counter())
        for b in slices(batches, "text"):
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[label].update(features_of(words_of(text)))
        every = sorted(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([n[1][w] for w in every], pa.int64()), pa.array([n[0][w] for w in every], pa.int64())], names=["feature", "a", "b"])

    return rows.select("label", "text").mapInArrow(run, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def selected(rows: DataFrame, most_features: int) -> list[str]:
    """Those features with the highest chi-square that speak for toxic, without near relatives."""
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    cross = a * (n0 - b) - b * (n1 - a)
    chi = cross * cross * (n1 + n0) / ((a + b) * (n1 + n0 - a - b) * n1 * n0 + 1.0)
    best = document_counts(rows).where(cross > 0).select("feature", "a", chi.alias("chi")).orderBy(F.desc("chi"), "a", "feature").limit(8 * most_features).collect()
    chosen: dict[str, int] = {}
    for w, a, _ in best:  # a word or beginning that is in about the same documents as a relative says nothing more
        stem = w.rstrip("*")
        related = (n for c, n in chosen.items() if stem.startswith(c.rstrip("*")) or c.startswith(stem))
        if not any(abs(n - a) <= 0.1 * a for n in related):
            chosen[w] = a
        if len(chosen) == most_features:
            break
    return list(chosen)


def clusters(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """The cluster of each row (0 the largest) by spherical k-means: starts are the row most like the mean, then each time the row least like those before."""
    x = np.hstack([x, np.full((len(x), 1), 1e-3)])  # rows without features aren't 0
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = [x[int((x @ x.mean(axis=0)).argmax())]]
    while len(centres) < k:
        centres.append(x[int((x @ np.array(centres).T).max(axis=1).argmin())])
    at = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        old, at = at, (x @ np.array(centres).T).argmax(axis=1)
        if (old == at).all():
            break
        sums = [x[at == c].sum(axis=0) if (at == c).any() else centres[c] for c in range(k)]
        centres = [s / np.linalg.norm(s) for s in sums]
    order = np.argsort(-np.bincount(at, minlength=k), kind="stable")
    return np.argsort(order)[at]


def logistic(x: np.ndarray, y: np.ndarray, decay: float, rounds: int = 25) -> np.ndarray:
    """Weights (bias last) of an L2-regularised logistic model by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    if not y.any():
        w[-1] = -20.0
        return w
    ridge = np.full(len(w), decay)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge), x1.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predicted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, targets: np.ndarray, folds: np.ndarray, decay: float = 0.05) -> list[np.ndarray]:
    """Weights of each link. x: rows by words; targets: rows by links; folds: the fold of each row."""
    links, earlier = [], np.zeros((len(x), 0))
    for k in range(targets.shape[1]):
        seen, y = np.hstack([x, earlier]), targets[:, k]
        links.append(logistic(seen, y, decay))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            own = folds == f
            if own.any():
                out[own] = predicted(seen[own], logistic(seen[~own], y[~own], decay)) if (~own).any() else predicted(seen[own], links[-1])
        earlier = np.hstack([earlier, out[:, None]])
    return links


def run_chain(x: np.ndarray, links: list[np.ndarray]) -> np.ndarray:
    """Probabilities of each link for rows of x."""
    out = np.zeros((len(x), 0))
    for w in links:
        out = np.hstack([out, predicted(np.hstack([x, out]), w)[:, None]])
    return out


class Matrix:
    """Rows of 0 and 1 for texts, a column a feature; remembers words while they fit."""

    def __init__(self, features: list[str]):
        self.place = {w: i for i, w in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}

    def row(self, text: str | None) -> list[int]:
        out: set[int] = set()
        for w in words_of(text):
            found = self.known.get(w)
            if found is None:
                if len(self.known) > 300_000:
                    self.known.clear()
                self.known[w] = found = tuple(self.place[x] for x in features_of({w}) if x in self.place)
            if found:
                out.update(found)
        return sorted(out)

    def rows(self, texts: list) -> np.ndarray:
        x = np.zeros((len(texts), len(self.place)))
        for i, text in enumerate(texts):
            x[i, self.row(text)] = 1
        return x


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_features: int = 128) -> tuple[list[str], list[np.ndarray]]:
    """The features and the links of the chain; no features: no model."""
    rows = materialize(sample(docs, labels, most_rows), "toxic-sample")
    features = selected(rows, most_features)
    if not features:
        return [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = Matrix(features)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([matrix.row(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "label", "x"])

    got = rows.mapInArrow(run, "doc_id long, label int, x array<int>").orderBy("doc_id").collect()
    x, targets = np.zeros((len(got), len(features))), np.zeros((len(got), len(CHAIN)))
    for i, r in enumerate(got):
        x[i, r["x"]] = 1
    targets[:, -1] = [r["label"] for r in got]
    toxic = np.flatnonzero(targets[:, -1])
    targets[toxic, clusters(x[toxic], CLUSTERS)] = 1
    folds = np.array([(r["doc_id"] * 2654435761 % (1 << 32)) >> 16 for r in got]) % FOLDS
    return features, fit_chain(x, targets, folds)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, a probability for each category, toxic_score (of the last link) and toxic (1 at threshold or more)."""
    features, links = learn(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = Matrix(features)
        for b in slices(batches, "text"):
            p = run_chain(matrix.rows(b.column(1).to_pylist()), links) if links else np.zeros((b.num_rows, len(CHAIN)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(len(CHAIN)))], names=["doc_id", *(f"p_{c}" for c in CHAIN)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN))
    return scored.withColumnRenamed("p_toxic", "toxic_score").withColumn("toxic", (F.col("toxic_score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
