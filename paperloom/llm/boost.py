"""Gradient-boosted trees on a bounded sample, in numpy: logistic loss, histogram splits, Newton leaves."""
from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        b = self._binned(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._values(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree as arrays by heap position: feature, bin (left: at most), value of the leaves."""
        inner = 2**self.depth - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(len(g), np.int64)
        for level in range(self.depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j in range(b.shape[1]):
                key = (node - base) * (BINS + 1) + b[:, j]
                gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[base : base + width][better], cut[base : base + width][better] = j, at[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return feature, cut, -self.rate * gs / (hs + self.ridge)

    def _values(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.start + sum((self._values(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to ``y`` over ``score``: steps' first scores and their values."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist()):
        blocks.append([s, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, v2, n2 = blocks.pop()
            blocks[-1][1] += v2
            blocks[-1][2] += n2
    return np.array([x[0] for x in blocks]), np.array([x[1] / x[2] for x in blocks])
