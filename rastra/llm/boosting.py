"""Gradient-boosted trees on binned dense features, and isotonic calibration.

Both are fitted on the driver on a sample of bounded size and are plain arrays
afterwards, so that they can be broadcast.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Logistic loss, trees of a fixed depth, Newton leaf values, second-order gains."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, min_leaf: int = 5, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.min_leaf, self.ridge = trees, depth, rate, bins, min_leaf, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(col, q)) for col in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)], axis=1)
        prior = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(prior / (1 - prior)))
        margin = np.full(len(y), self.base)
        n_nodes, width = 2**self.depth - 1, self.bins + 1
        self.feature = np.zeros((self.trees, n_nodes), np.int64)
        self.cut = np.full((self.trees, n_nodes), np.inf)
        self.leaf = np.zeros((self.trees, 2**self.depth))
        for t in range(self.trees):
            p = sigmoid(margin)
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            for d in range(self.depth):
                first, nodes = 2**d - 1, 2**d
                key = (node - first) * width
                best = np.full(nodes, 1e-6)
                pick_f, pick_b = np.zeros(nodes, np.int64), np.full(nodes, -1)
                for f in range(x.shape[1]):
                    k = key + binned[:, f]
                    gs, hs, ns = (np.bincount(k, w, nodes * width).reshape(nodes, width).cumsum(axis=1) for w in (g, h, None))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(ns < self.min_leaf) | (nt - ns < self.min_leaf)] = -1
                    gain = gain[:, : len(self.cuts[f])]
                    if not gain.shape[1]:
                        continue
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), at]
                    better = top > best
                    best[better], pick_f[better], pick_b[better] = top[better], f, at[better]
                for i in range(nodes):
                    self.feature[t, first + i] = pick_f[i]
                    if pick_b[i] >= 0:
                        self.cut[t, first + i] = self.cuts[pick_f[i]][pick_b[i]]
                right = x[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node]
                node = 2 * node + 1 + right
            leaf = node - n_nodes
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            self.leaf[t] = -self.rate * gs / (hs + self.ridge)
            margin += self.leaf[t, leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t, node - self.feature.shape[1]]
        return out


class Isotonic:
    """The monotone fit of labels on scores by pooling adjacent violators, linear between the pools' means."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # sum of labels, count, sum of scores
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            pools.append([v, 1.0, s])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.x = np.array([s / n for _, n, s in pools])
        self.y = np.array([v / n for v, n, _ in pools])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
