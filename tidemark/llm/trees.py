"""Histogram gradient-boosted trees for two classes, in numpy; small enough to fit on the driver."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of one depth, flattened: node i of a tree has the children 2i+1 and 2i+2, all trees side by side in arrays.

    A node without a useful split sends every row to the left. Values go to the leaves of the last level.
    """

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: int = 10) -> None:
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        inner = (1 << depth) - 1
        self.feature = np.zeros((trees, inner), np.int32)
        self.threshold = np.full((trees, inner), np.inf)
        self.value = np.zeros((trees, 1 << depth))
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fits on features x (rows, features) and labels y (0 or 1). Without rows, or with one class, only the base rate is learned."""
        n, width = x.shape
        self.base = float(np.log((y.sum() + 1.0) / (n - y.sum() + 1.0)))
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        score = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, nodes = (1 << level) - 1, 1 << level
                place = ((at - first)[:, None] * width + np.arange(width)) * self.bins + binned
                shape = (nodes, width, self.bins)
                g, h, c = (np.bincount(place.ravel(), np.repeat(w, width) if w is not None else None, minlength=nodes * width * self.bins).reshape(shape) for w in (grad, hess, None))
                gl, hl, cl = g.cumsum(2), h.cumsum(2), c.cumsum(2)
                gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain = np.where((cl >= self.least) & (ct - cl >= self.least), gain, -np.inf).reshape(nodes, -1)
                best = gain.argmax(1)
                right = np.zeros(n, np.int64)
                for k in range(nodes):
                    f, b = divmod(int(best[k]), self.bins)
                    if gain[k, best[k]] > 1e-9 and b < len(edges[f]):
                        self.feature[t, first + k], self.threshold[t, first + k] = f, edges[f][b]
                        mine = at == first + k
                        right[mine] = x[mine, f] > edges[f][b]
                at = 2 * at + 1 + right
            leaf = at - ((1 << self.depth) - 1)
            total = np.bincount(leaf, grad, 1 << self.depth) / (np.bincount(leaf, hess, 1 << self.depth) + self.ridge)
            self.value[t] = self.rate * total
            score += self.value[t][leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all trees and rows stepped down one level at a time."""
        n = len(x)
        at, tree, row = np.zeros((n, self.trees), np.int64), np.arange(self.trees), np.arange(n)[:, None]
        for _ in range(self.depth):
            f = self.feature[tree, at]
            at = 2 * at + 1 + (x[row, f] > self.threshold[tree, at])
        score = self.base + self.value[tree, at - ((1 << self.depth) - 1)].sum(1)
        return 1 / (1 + np.exp(-score))
