"""Gradient-boosted regression trees on histograms, in numpy: the labelled sample is small and bounded."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Squared-error boosting of depth-limited trees over quantile bins.

    Deterministic for a given ``seed``.  NaN counts as the smallest value.
    """

    def __init__(self, trees: int = 150, rate: float = 0.08, depth: int = 4, bins: int = 48, least: int = 12, rows: float = 0.7, columns: float = 0.6, l2: float = 1.0, seed: int = 7):
        self.n, self.rate, self.depth, self.bins, self.least, self.rows, self.columns, self.l2, self.seed = trees, rate, depth, bins, least, rows, columns, l2, seed

    def _binned(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(np.asarray(x, np.float64), nan=-1e18)
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        x, y = np.nan_to_num(np.asarray(x, np.float64), nan=-1e18), np.asarray(y, np.float64)
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        b, rng = self._binned(x), np.random.default_rng(self.seed)
        self.base, self.trees = float(y.mean()), []
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            r = np.flatnonzero(rng.random(len(y)) < self.rows)
            cols = np.flatnonzero(rng.random(x.shape[1]) < self.columns)
            if not len(r) or not len(cols):
                continue
            tree = self._grow(b[r], (y - f)[r], cols)
            self.trees.append(tree)
            f += self.rate * self._walk(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, cols: np.ndarray) -> tuple:
        """Complete binary tree as arrays: feature (-1: leaf), threshold bin, value."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(g), int)
        for at in range(size):
            own = np.flatnonzero(node == at)
            if not len(own):
                continue
            s = g[own].sum()
            value[at] = s / (len(own) + self.l2)
            if at >= 2**self.depth - 1 or len(own) < 2 * self.least:
                continue
            best, where = s * s / (len(own) + self.l2) + 1e-9, None
            for j in cols:
                k = len(self.edges[j]) + 1
                if k < 2:
                    continue
                n = np.bincount(b[own, j], minlength=k).cumsum()[:-1]
                t = np.bincount(b[own, j], weights=g[own], minlength=k).cumsum()[:-1]
                ok = (n >= self.least) & (len(own) - n >= self.least)
                if not ok.any():
                    continue
                gain = np.where(ok, t * t / (n + self.l2) + (s - t) ** 2 / (len(own) - n + self.l2), -1)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, where = gain[i], (j, i)
            if where:
                feature[at], cut[at] = where
                node[own] = np.where(b[own, where[0]] <= where[1], 2 * at + 1, 2 * at + 2)
        return feature, cut, value

    def _walk(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            step = 2 * at + np.where(b[rows, np.maximum(f, 0)] <= cut[at], 1, 2)
            at = np.where(inner, step, at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + self.rate * sum((self._walk(t, b) for t in self.trees), np.zeros(len(b)))
