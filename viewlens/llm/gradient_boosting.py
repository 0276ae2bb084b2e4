"""Gradient-boosted regression trees for two classes, fitted on a bounded sample (numpy).

Each tree may use a share of the columns only, the same ones at every run.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, Newton leaf values, splits on quantile bins; complete trees of ``depth``."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0,
                 columns: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.columns = columns

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        splits = 2 ** self.depth - 1
        self.feature = np.zeros((self.n_trees, splits), np.int64)
        self.cut = np.full((self.n_trees, splits), np.inf)
        self.leaf = np.zeros((self.n_trees, splits + 1))
        rng, usable = np.random.default_rng(1), np.flatnonzero([len(c) > 0 for c in cuts])
        for t in range(self.n_trees):
            mine = usable if self.columns >= 1 else np.sort(rng.permutation(usable)[:max(1, int(self.columns * len(usable)))])
            p = 1 / (1 + np.exp(-score))
            slope, curve = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2 ** level - 1, 2 ** level
                best = np.full(width, 1e-6)
                at = np.full((width, 2), -1)
                for f in mine.tolist():
                    size = len(cuts[f]) + 1
                    key = node * size + binned[:, f]
                    g = np.bincount(key, slope, width * size).reshape(width, size).cumsum(axis=1)
                    h = np.bincount(key, curve, width * size).reshape(width, size).cumsum(axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = (g ** 2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge)
                            - all_g ** 2 / (all_h + self.ridge))[:, :-1]
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best
                    best = np.where(better, gain[np.arange(width), k], best)
                    at[better] = np.stack([np.full(width, f), k], axis=1)[better]
                side = np.zeros(len(y), np.int64)
                for n in range(width):
                    if at[n, 0] >= 0:
                        self.feature[t, first + n] = at[n, 0]
                        self.cut[t, first + n] = cuts[at[n, 0]][at[n, 1]]
                        here = node == n
                        side[here] = binned[here, at[n, 0]] > at[n, 1]
                node = 2 * node + side
            g = np.bincount(node, slope, splits + 1)
            h = np.bincount(node, curve, splits + 1)
            self.leaf[t] = self.rate * g / (h + self.ridge)
            score += self.leaf[t, node]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            score += self.leaf[t, node - (2 ** self.depth - 1)]
        return score
