"""Gradient-boosted trees for two classes in numpy: logistic loss, Newton leaf values, histogram splits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[at]
            go = x[inner, f[inner]] <= self.cut[at[inner]]
            at[inner] = np.where(go, self.left[at[inner]], self.right[at[inner]])


@dataclass
class Boosted:
    """fit() learns from at most `most_rows` rows (the caller bounds them); predict() gives probabilities."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    least_weight: float = 1.0
    ridge: float = 1.0
    cuts: int = 32
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if x.shape[1] else np.zeros((len(x), 0), int)
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-raw))
            tree = self._grow(bins, edges, prob - y, prob * (1 - prob))
            self.trees.append(tree)
            raw += tree.predict(x)
        return self

    def _grow(self, bins, edges, g, h) -> Tree:
        nodes: list[list] = []

        def node(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, -1, -1, -self.rate * total_g / (total_h + self.ridge)])
            gain, pick = 1e-6, None
            if depth < self.depth and total_h >= 2 * self.least_weight:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    sg = np.bincount(bins[rows, j], g[rows], len(e) + 1).cumsum()[:-1]
                    sh = np.bincount(bins[rows, j], h[rows], len(e) + 1).cumsum()[:-1]
                    fit = sg**2 / (sh + self.ridge) + (total_g - sg) ** 2 / (total_h - sh + self.ridge) - total_g**2 / (total_h + self.ridge)
                    fit[(sh < self.least_weight) | (total_h - sh < self.least_weight)] = -1
                    if (best := int(fit.argmax())) >= 0 and fit[best] > gain:
                        gain, pick = fit[best], (j, best)
            if pick:
                j, cut = pick
                low = bins[rows, j] <= cut
                nodes[me][:2] = [j, float(edges[j][cut])]
                nodes[me][2] = node(rows[low], depth + 1)
                nodes[me][3] = node(rows[~low], depth + 1)
            return me

        node(np.arange(len(g)), 0)
        f, c, a, b, v = zip(*nodes, strict=True)
        return Tree(np.array(f), np.array(c, float), np.array(a), np.array(b), np.array(v, float))

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for t in self.trees:
            raw += t.predict(x)
        return 1 / (1 + np.exp(-raw))
