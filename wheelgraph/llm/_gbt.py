"""Histogram gradient-boosted trees for logistic loss, kept as flat arrays.

Every tree is a complete binary tree of one depth, so node i has the children
2i+1 and 2i+2 and a whole forest is three rectangular arrays. Scoring walks all
rows down one level at a time with numpy; `column` writes the same forest as a
Spark SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; a row goes right if its value is above the cut
    leaf: np.ndarray  # trees x leaves, learning rate included
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:  # all rows are on the same level
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))

    def sql(self, names: list[str]) -> str:
        """The forest's probability as SQL over expressions named per feature."""

        def node(t: int, i: int) -> str:
            inner = self.feature.shape[1]
            if i >= inner:
                return f"{self.leaf[t, i - inner]:.9e}D"
            left, right = node(t, 2 * i + 1), node(t, 2 * i + 2)
            if left == right or not np.isfinite(self.cut[t, i]):
                return left
            return f"IF({names[self.feature[t, i]]} > {self.cut[t, i]:.9e}D, {right}, {left})"

        total = " + ".join([f"{self.base:.9e}D", *(node(t, 0) for t in range(len(self.feature)))])
        return f"(1D / (1D + exp(-({total}))))"


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0, weight: np.ndarray | None = None) -> Forest:
    """Boost `trees` trees on x (rows x features), y in {0, 1}. An empty or one-class y gives a constant forest."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
    inner = 2**depth - 1
    mean = float((np.sum(y * w) + 0.5) / (np.sum(w) + 1))
    base = float(np.log(mean / (1 - mean)))
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if len(y) == 0 or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])  # value > edges[k] <=> code > k
    margin = np.full(len(y), base)
    all_feature, all_cut, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * w, np.maximum(p * (1 - p), 1e-6) * w
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = at - first
            gt, ht = np.bincount(local, g, n), np.bincount(local, h, n)
            best = np.full(n, 1e-9)
            where = np.full((n, 2), -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                gs = np.bincount(local * k + codes[f], g, n * k).reshape(n, k).cumsum(1)[:, :-1]
                hs = np.bincount(local * k + codes[f], h, n * k).reshape(n, k).cumsum(1)[:, :-1]
                gr, hr = gt[:, None] - gs, ht[:, None] - hs
                gain = gs**2 / (hs + l2) + gr**2 / (hr + l2) - (gt**2 / (ht + l2))[:, None]
                gain[(hs < least) | (hr < least)] = -1
                j = gain.argmax(1)
                top = gain[np.arange(n), j]
                better = top > best
                best[better], where[better] = top[better], np.stack([np.full(n, f), j], 1)[better]
            right = np.zeros(len(y), np.int64)
            for i in range(n):
                if where[i, 0] >= 0:
                    f, j = where[i]
                    feature[first + i], cut[first + i] = f, edges[f][j]
                    mine = local == i
                    right[mine] = codes[f][mine] > j
            at = 2 * at + 1 + right
        local = at - inner
        leaf = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + l2)
        margin += leaf[local]
        all_feature.append(feature), all_cut.append(cut), all_leaf.append(leaf)
    return Forest(np.array(all_feature), np.array(all_cut), np.array(all_leaf), base)
