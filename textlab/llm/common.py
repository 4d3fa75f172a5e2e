"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows in small batches: what a task holds as Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 256) -> DataFrame:
    """Small Arrow batches of ``df`` through ``kernel``; a kernel keeps nothing between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            out = kernel(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def quantile_splits(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 distinct ascending values that cut a long column about evenly."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    cuts = df.agg(F.percentile_approx(column, shares, 20 * parts).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


class Forest:
    """Disjoint sets over 0..n-1, united in numpy steps; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            self.parent[x] = self.parent[up]
            x = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def worker_state(kind: str, key: str, build: Callable):
    """What ``build`` returned for ``key`` in this Python worker: a table or cache that outlives a
    task. A worker keeps one of a kind; another key takes its place."""
    import sys
    import types

    kept = sys.modules.setdefault("_textlab_worker_state", types.ModuleType("_textlab_worker_state"))
    if getattr(kept, kind, (None,))[0] != key:
        setattr(kept, kind, (key, build()))
    return getattr(kept, kind)[1]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; ``y`` may be soft. The last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.ones(len(y)) if weight is None else weight
    # half a row of either label keeps the intercept finite
    prior = np.zeros((2, x.shape[1]))
    prior[:, -1] = 1
    x, y, w = np.vstack([x, prior]), np.concatenate([y, [0.0, 1.0]]), np.concatenate([w, [0.5, 0.5]])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - penalty * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
