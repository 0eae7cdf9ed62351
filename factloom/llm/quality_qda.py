"""Operator 7: quality classifier. Regularised quadratic discriminant on transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one and then towards its own mean variance;
their Cholesky factors are computed once. The score is the difference of the Mahalanobis log densities, carried to a
probability by a two-parameter logistic fit. Fitted on a bounded sample (`max_labelled`) of the labelled rows in the
learning folds; labels, lang, source and doc_id are no inputs.

Defined results: null and empty texts are scored like a text of no words; a null doc_id is not held out; repeated rows
each get a row; other columns are ignored; without learning rows of both classes every score is the share of class 1
(1.0 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import text_stats as ts
from factloom.llm.calibration import logistic
from factloom.llm.common import fold, label_sample, map_arrow, utf8

FOLDS, HELD_OUT, CUT = 5, 0, 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, log_ratio double"


def features(m: np.ndarray) -> np.ndarray:
    """The smoothed shares of text_stats.ratios and transformed length, word length, variety, digits and punctuation."""
    x = m.astype(float)
    words = x[:, 0]
    return np.column_stack([
        ts.ratios(m), np.log1p(words), (x[:, 1] + 100) / (words + 20), (x[:, 12] + 20) / (words + 20),
        np.log1p(20 * x[:, 8] / (words + 10)), x[:, 9] / (words + 10),
    ])


class Qda:
    def __init__(self, to_pooled: float = 0.2, to_identity: float = 0.05):
        self.to_pooled, self.to_identity, self.only = to_pooled, to_identity, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Qda:
        if len(np.unique(y)) < 2:
            self.only = float(y.mean()) if len(y) else 1.0
            return self
        self.low, self.high = np.quantile(x, [0.002, 0.998], axis=0)
        x = np.clip(x, self.low, self.high)
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.centre) / self.scale
        parts = [z[y == k] for k in (0, 1)]
        scatter = [(p - p.mean(axis=0)).T @ (p - p.mean(axis=0)) for p in parts]
        pooled = (scatter[0] + scatter[1]) / len(z)
        self.means, self.factors, self.logdet = [], [], []
        for p, s in zip(parts, scatter, strict=True):
            cov = (1 - self.to_pooled) * s / len(p) + self.to_pooled * pooled
            cov = (1 - self.to_identity) * cov + self.to_identity * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.means.append(p.mean(axis=0))
            self.factors.append(np.linalg.inv(factor))  # a lower triangle: distances by one product
            self.logdet.append(2 * np.log(np.diag(factor)).sum())
        self.slope, self.shift = logistic(np.clip(self.log_ratio(x), -50, 50), y, 1e-3)
        return self

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (np.clip(x, self.low, self.high) - self.centre) / self.scale
        log = [-0.5 * (np.square((z - m) @ f.T).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.logdet, strict=True)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.only is not None:
            return np.full(len(x), self.only), np.zeros(len(x))
        ratio = self.log_ratio(x)
        return 1 / (1 + np.exp(-np.clip(self.slope * ratio + self.shift, -60, 60))), ratio


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000) -> Qda:
    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = ts.measure_all(utf8(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array(list(m), pa.list_(pa.int64()))], ["doc_id", "y", "m"])

    sample = label_sample(docs, labels, "quality", max_labelled, lambda i: fold(i, FOLDS) != HELD_OUT)
    rows = sorted(map_arrow(sample, stats, "doc_id long, y int, m array<long>").collect(), key=lambda r: r.doc_id)
    m = np.array([r.m for r in rows], np.int64).reshape(len(rows), len(ts.FIELDS))
    return Qda().fit(features(m), np.array([r.y for r in rows], float))


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """One row for each document: score of class 1, and 1 or 0 at the cut."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **parameters))  # a few matrices

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, ratio = model.value.score(features(ts.measure_all(utf8(batch.column(2)))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(ratio)], ["doc_id", "held_out", "score", "predicted", "log_ratio"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return map_arrow(rows, run, SCHEMA)
