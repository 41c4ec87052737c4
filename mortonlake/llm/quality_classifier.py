"""Quality classifier: a regularised quadratic discriminant over statistics of whole texts.

Each text gives a short vector of transformed statistics. Class means and covariances
come from sums that tasks make of all labelled rows and Spark adds up (no sample), so
the driver holds a few hundred numbers. A class covariance is shrunk towards the
pooled one and towards a multiple of the identity; the score is the logistic function of the tempered
difference of log densities, which are Mahalanobis distances through
Cholesky factors made once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, load, small_batches, table

TO_POOLED, TO_IDENTITY, TEMPER, THRESHOLD = 0.1, 0.02, 0.25, 0.7
SYMBOLS = "#*$%&|<>"
DIM = 15


def statistics(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (DIM - 1) + [1.0]
    counts, lens = Counter(words), [*map(len, words)]
    total = sum(lens)
    mean = total / n
    lines = [x for x in text.split("\n") if x]
    per = lambda x: float(np.log1p(20.0 * x / n))
    return [
        float(np.log1p(n)),
        float(np.log(mean)),
        float(np.log1p(sum(x * x for x in lens) / n - mean * mean)),
        per(sum(map(text.count, SYMBOLS))),
        per(text.count("!")),
        per(text.count("|")),
        per(sum(map(str.isupper, words))),
        len(counts) / n**0.85,
        per(sum(map(eq, words, words[1:]))),
        float(np.sqrt(max(counts.values()) / n)),
        per(text.count(".")),
        per(text.count(",")),
        per(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        sum(x <= 3 for x in lens) / n,
    ]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t or "") for t in b.column("__text").to_pylist()]
        keep = [i for i, n in enumerate(b.schema.names) if n != "__text"]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(x, pa.list_(pa.float64()))], [*[b.schema.names[i] for i in keep], "x"])


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text, for every row."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("__text")).mapInArrow(_vectors, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        y = np.asarray(b.column("y").to_numpy(zero_copy_only=False))
        x = np.array(b.column("x").to_pylist(), float).reshape(len(y), -1)
        for k in np.unique(y).tolist():
            own = np.c_[np.ones((y == k).sum()), x[y == k]]
            sums[k] = sums.get(k, 0) + own.T @ own  # count, sums and products at once
    for k, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k), pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], ["y", "at", "v"])


class Discriminant:
    """What scoring needs: prior, means, inverses of Cholesky factors and log determinants."""

    def __init__(self, moments: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY, temper: float = TEMPER) -> None:
        self.temper, counts = temper, {k: m[0, 0] for k, m in moments.items()}
        whole = sum(counts.values())
        self.prior = counts.get(1, 0.0) / whole if whole else 0.5
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        if len(counts) < 2:
            return
        means = {k: m[0, 1:] / m[0, 0] for k, m in moments.items()}
        cov = {k: m[1:, 1:] / m[0, 0] - np.outer(means[k], means[k]) for k, m in moments.items()}
        pooled = sum(cov[k] * counts[k] for k in cov) / whole
        scale = np.sqrt(np.diag(pooled) + 1e-6)  # shrink in units of the pooled deviations
        for k in (0, 1):
            c = (1 - to_pooled) * cov[k] + to_pooled * pooled
            c = (1 - to_identity) * c / np.outer(scale, scale) + to_identity * np.eye(len(scale))
            factor = np.linalg.cholesky(c)
            self.classes.append((means[k], np.linalg.inv(factor) / scale, 2 * np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the prior alone if only one class, or none, was labelled."""
        if not self.classes:
            return np.full(len(x), self.prior)
        logs = [-0.5 * ((((x - mean) @ inverse.T) ** 2).sum(axis=1) + logdet) for mean, inverse, logdet in self.classes]
        z = self.temper * (logs[1] - logs[0]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: DataFrame, labels: DataFrame, **options: float) -> Discriminant:
    """x: doc_id and x; labels: doc_id and quality (0 or 1). Null keys and labels are left out."""
    rows = x.join(labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("y in (0, 1)"), "doc_id").select("y", "x")
    sums = rows.mapInArrow(_moments, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()  # 2 * (DIM + 1) ** 2 rows
    moments: dict[int, np.ndarray] = {}
    for r in sums:
        moments.setdefault(r.y, np.zeros((DIM + 1) ** 2))[r.at] = r.v
    return Discriminant({k: m.reshape(DIM + 1, -1) for k, m in moments.items()}, **options)


def score(x: DataFrame, model: Discriminant) -> DataFrame:
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(v.to_numpy())) if len(v) else np.zeros(0))

    return x.withColumn("score", run("x"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, learnt from labelled rows outside fold 2 of 4.

    Null and empty texts are scored too, as texts without words. Repeated rows are scored
    each. A row with several labels counts once for each. With labels of one class
    only, or none, every score is the share of class 1, or 0.5. Further columns are not used.
    """
    x = table(vectors(docs), "quality-vectors")
    out = F.col("doc_id"), (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    model = fit(x.filter(fold(F.col("doc_id"), 4) != 2), labels, **options)
    return score(x, model).select(*out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
