"""Checks and blocks of vectors that the vector operators share."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null, not empty and has neither null nor non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def packed(*arrays: object) -> bytes:
    """Arrays as one blob; read back only by `unpacked` in another task of the same job."""
    return pickle.dumps(arrays, protocol=5)


def unpacked(blob: bytes) -> tuple:
    return pickle.loads(blob)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k centroids of the rows of x (fewer if there are fewer rows), from a seeded start."""
    k = max(1, min(k, len(x)))
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        owner = squared_distances(x, centroids).argmin(1)
        sums, sizes = np.zeros_like(centroids), np.bincount(owner, minlength=k)
        np.add.at(sums, owner, x)
        filled = sizes > 0
        centroids[filled] = sums[filled] / sizes[filled, None]
    return centroids


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :], 0)


def wide(vectors: list, width: int, kind: type = np.float64) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out
