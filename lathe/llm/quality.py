"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

One pass over the texts turns each into STATISTICS numbers. Class means and covariances are sums that the JVM
aggregates over every training row (no sample); the driver sees two rows. Each class covariance is shrunk towards the
pooled one and its diagonal, factored once (Cholesky) and kept in the model; the score is the logistic of the
difference of the classes' Mahalanobis log-densities.

Nulls: a null text counts as empty and gets a score like any other; a null doc_id gets held_out null-safe (crc32 of
''). Label rows with a null or other class, or that contradict each other on a doc_id, are not learned from. Without
rows of both classes the score is the prior 0.5. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm.common import materialize, slices, table

#: The transformed statistics, in order.
STATISTICS = (
    "log_words", "log_word_bytes", "upper", "marks", "stops", "digits", "bars", "bangs",
    "variety", "repeats", "top_word", "line_variety", "log_line_bytes", "entropy", "squeeze",
)
MARKS, STOPS = b"#$%&*<>{}[]\\^~=_@/", b".,;:?"


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; shares go through log(x + 0.002), which spreads them near 0."""
    import zlib

    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters = int(count[65:91].sum() + count[97:123].sum())
    share = lambda x: float(np.log(x + 0.002))
    words = raw.split()
    w = max(1, len(words))
    kinds = Counter(words)
    lines = raw.split(b"\n")
    p = count[count > 0] / n
    return [
        float(np.log1p(len(words))),
        float(np.log1p(sum(map(len, words)) / w)),
        share(int(count[65:91].sum()) / max(1, letters)),
        share(sum(int(count[c]) for c in MARKS) / n),
        share(sum(int(count[c]) for c in STOPS) / n),
        share(int(count[48:58].sum()) / n),
        share(int(count[124]) / n),
        share(int(count[33]) / n),
        float(np.log1p(len(kinds)) / np.log1p(w)),
        share(sum(map(bytes.__eq__, words, words[1:])) / w),
        share(max(kinds.values(), default=0) / w),
        float(len(set(lines)) / len(lines)),
        float(np.log1p(len(raw) / len(lines))),
        float(-(p * np.log2(p)).sum()) if raw else 0.0,
        float(np.log((len(zlib.compress(raw, 1)) + 20) / (n + 20))),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, x (array of STATISTICS) and the columns in carry: the only pass over texts."""
    names = ["doc_id", "x", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], type=pa.list_(pa.float64())), *b.columns[2:]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:1], T.StructField("x", T.ArrayType(T.DoubleType())), *rows.schema.fields[2:]]))


@dataclass
class Discriminant:
    """Means (2, d), inverse Cholesky factors (2, d, d), log-determinants and log-priors by class; None: no classes seen."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None
    priors: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of x."""
        if self.means is None:
            return np.full(len(x), 0.5)
        dens = [self.priors[k] - 0.5 * self.logdets[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(dens[0] - dens[1], -60, 60)))


def fit(rows: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.1) -> Discriminant:
    """rows: x, label (0 or 1). Sums of all rows by class are made in the JVM; 2 rows reach the driver."""
    d = len(STATISTICS)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    got = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    if any(k not in got or got[k]["n"] < 2 for k in (0, 1)):
        return Discriminant()
    n = np.array([got[k]["n"] for k in (0, 1)], dtype=float)
    mean = np.array([[got[k][f"s{i}"] for i in range(d)] for k in (0, 1)]) / n[:, None]
    cov = np.array([[[got[k][f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)] for k in (0, 1)]) / n[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
    pooled = np.einsum("k,kij->ij", n, cov) / n.sum()
    factors, logdets = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * cov[k] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(mean, np.array(factors), np.array(logdets), np.log(n / n.sum()))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label of the ids whose label rows agree and that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other").where(~held_out("doc_id"))


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns in carry for each row of docs, learned from the labels' quality."""
    stats = materialize(with_statistics(docs, carry=carry), "quality")
    names = ["doc_id", "score", *carry]
    model = fit(stats.join(training_labels(labels, "quality"), "doc_id").select("x", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x)), *b.columns[2:]], names=names)

    scored = stats.mapInArrow(run, T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType()), *stats.schema.fields[2:]]))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
