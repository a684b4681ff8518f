"""A small random forest for binary labels, in numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    """Bagged trees on random feature subsets; a leaf holds its share of ones.
    The same rows and seed give the same forest."""

    def __init__(self, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 5):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.nodes = []
        for _ in range(self.trees):
            pick = rng.integers(0, len(x), len(x))
            self.nodes.append(self._grow(x[pick], y[pick].astype(float), rng))
        return self

    def _grow(self, x, y, rng):
        feature, cut, left, right, share = [], [], [], [], []

        def node(at, depth) -> int:
            k = len(feature)
            for column, value in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (share, float(y[at].mean()))):
                column.append(value)
            if depth == 0 or len(at) < 2 * self.least or share[k] in (0.0, 1.0):
                return k
            best = (0.0, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                order = np.argsort(x[at, f], kind="stable")
                v, ones = x[at, f][order], np.cumsum(y[at][order])
                n = np.arange(1, len(at))
                p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(at) - n)
                impurity = (n * p * (1 - p) + (len(at) - n) * q * (1 - q)) / len(at)
                gain = share[k] * (1 - share[k]) - impurity
                gain[(v[1:] <= v[:-1]) | (n < self.least) | (len(at) - n < self.least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-12:
                    best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
            if best[1] >= 0:
                feature[k], cut[k] = best[1], best[2]
                low = x[at, best[1]] <= best[2]
                left[k] = node(at[low], depth - 1)
                right[k] = node(at[~low], depth - 1)
            return k

        node(np.arange(len(x)), self.depth)
        return tuple(map(np.array, (feature, cut, left, right, share)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of ones over the trees."""
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                own = at[inner]
                at[inner] = np.where(x[inner, feature[own]] <= cut[own], left[own], right[own])
            total += share[at]
        return total / max(len(self.nodes), 1)
