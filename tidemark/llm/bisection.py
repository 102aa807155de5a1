"""Recursive graph bisection: an order of documents in which those that share terms lie near each other.

A node of the tree halves its documents so that terms fall to one half rather than to both: halves start by chance, and
documents whose move shortens the logarithmic gaps of their terms most change places in pairs until none gain. The tree
is fitted on a bounded sample; a node keeps what each term says for its left half, so every other document goes down the
same tree by its own terms alone, whichever task holds it.
"""

from __future__ import annotations

import numpy as np

#: Levels of the tree, rounds of exchanges in a node, and the sample's most frequent terms that decide which way.
LEVELS, ROUNDS, FEATURES = 7, 12, 4096
#: Documents that a node must have in the sample to be split.
LEAST = 16


def _gaps(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    return left * np.log2(n_left / (left + 1)) + right * np.log2(n_right / (right + 1))


class Bisection:
    """The tree: nodes in heap order, for each the evidence of each feature and the evidence from which on left is taken."""

    def __init__(self, levels: int = LEVELS) -> None:
        self.levels = levels
        self.features: dict[int, int] = {}
        self.evidence = np.zeros((0, 0), np.float32)
        self.border = np.zeros(0)

    def fit(self, terms: np.ndarray, sizes: np.ndarray) -> Bisection:
        """Fits the tree to a sample: its documents' different terms one after another, and how many each has."""
        known, counts = np.unique(terms, return_counts=True)
        chosen = np.sort(known[np.lexsort((known, -counts))][:FEATURES])
        self.features = {int(t): i for i, t in enumerate(chosen.tolist())}
        self.evidence = np.zeros(((1 << self.levels) - 1, len(chosen)), np.float32)
        self.border = np.zeros((1 << self.levels) - 1)
        owner, feature = self._known(terms, sizes)
        node = np.zeros(len(sizes), np.int64)
        chance = np.random.default_rng(1)
        for level in range(self.levels):
            for at in range((1 << level) - 1, (1 << (level + 1)) - 1):
                docs = np.flatnonzero(node == at)
                if len(docs) >= LEAST:
                    place = np.full(len(node), -1)
                    place[docs] = np.arange(len(docs))
                    mine = place[owner] >= 0
                    self._split(at, len(docs), place[owner[mine]], feature[mine], chance)
            node = self._down(node, owner, feature)
        return self

    def _split(self, at: int, n: int, doc: np.ndarray, word: np.ndarray, chance: np.random.Generator) -> None:
        """Halves the n documents of node `at`, whose terms are pairs of document and word."""
        width = self.evidence.shape[1]
        left = np.zeros(n, bool)
        left[chance.permutation(n)[: n // 2]] = True
        n_left, n_right = n // 2, n - n // 2
        for _ in range(ROUNDS):
            there = np.bincount(word[left[doc]], minlength=width).astype(float)
            here = np.bincount(word[~left[doc]], minlength=width).astype(float)
            now = _gaps(there, here, n_left, n_right)
            to_right = now - _gaps(np.maximum(there - 1, 0), here + 1, n_left, n_right)
            to_left = now - _gaps(there + 1, np.maximum(here - 1, 0), n_left, n_right)
            gain = np.bincount(doc, np.where(left[doc], to_right[word], to_left[word]), minlength=n)
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            pairs = min(len(a), len(b))
            swaps = int((gain[a[:pairs]] + gain[b[:pairs]] > 1e-9).sum())
            if not swaps:
                break
            left[a[:swaps]], left[b[:swaps]] = False, True
        there = np.bincount(word[left[doc]], minlength=width) + 0.5
        here = np.bincount(word[~left[doc]], minlength=width) + 0.5
        self.evidence[at] = np.log(there / (n_left + 1)) - np.log(here / (n_right + 1))
        self.border[at] = np.median(np.bincount(doc, self.evidence[at][word], minlength=n))

    def _known(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and feature of every term that is a feature."""
        feature = np.array([self.features.get(t, -1) for t in terms.tolist()], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return owner[feature >= 0], feature[feature >= 0]

    def _down(self, node: np.ndarray, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        says = np.bincount(owner, self.evidence[node[owner], feature], minlength=len(node))
        return 2 * node + np.where(says >= self.border[node], 1, 2)

    def leaves(self, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The leaf of each document, numbered from the left; what is given is as in fit."""
        owner, feature = self._known(terms, sizes)
        node = np.zeros(len(sizes), np.int64)
        for _ in range(self.levels if len(self.border) else 0):
            node = self._down(node, owner, feature)
        return node - len(self.border)
