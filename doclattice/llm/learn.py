"""Small numpy pieces shared by the operators that are trained here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

PART = 1 << 13
WIDE = 32


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, the intercept last, by damped Newton steps on the mean log-likelihood; rows weigh alike."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the share of the one class, kept finite
        w[-1] = 0.0 if not len(y) else 10.0 if y[0] else -10.0
        return w
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 0
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).mean() + (ridge * w * w).sum() / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge + 1e-9), grad)
        rate, now = 1.0, loss(w)
        while rate > 1e-4 and loss(w - rate * step) > now:
            rate /= 2
        w -= rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return w


def distinct_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of every labelled document. Of contradicting labels the greatest counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled rows, chosen by hash of doc_id: the bound of what is broadcast and fitted on."""
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bounded_labels(labels: DataFrame, column: str, most: int) -> DataFrame:
    return bounded(distinct_labels(labels, column), most)


def gather_counts(rows: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of per-task count arrays. count(batch, array) adds a batch; tasks send rows of ``WIDE`` cells, whose sums are
    combined row by row, so no task holds more than its own array however many tasks there are. ``shape`` bounds the result."""
    total = int(np.prod(shape))
    cells = [f"c{i}" for i in range(WIDE)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(shape, np.int64)
        for batch in batches:
            count(batch, own)
        flat = own.ravel()
        table = np.concatenate([flat, np.zeros(-total % WIDE, np.int64)]).reshape(-1, WIDE)
        some = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(some), PART):
            part = some[at : at + PART]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.ascontiguousarray(table[part, i])) for i in range(WIDE))], ["at", *cells])

    sums = rows.mapInArrow(tidy(scan), ", ".join(f"{c} long" for c in ["at", *cells])).groupBy("at").agg(*[F.sum(c).alias(c) for c in cells]).toArrow()
    flat = np.zeros((-(-total // WIDE), WIDE), np.int64)
    flat[sums["at"].to_numpy()] = np.column_stack([sums[c].to_numpy() for c in cells])
    return flat.ravel()[:total].reshape(shape)
