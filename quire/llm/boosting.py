"""Gradient-boosted trees for two classes (logistic loss, histogram splits)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of equal depth: a feature and threshold per inner node, a value per leaf."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class."""
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Fit to features ``x`` and labels ``y`` in {0, 1}; the same input gives the same trees."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    width = max(len(c) for c in cuts) + 1
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(y), base)
    inner, features, thresholds, values = 2**depth - 1, [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for d in range(depth):
            first, n = 2**d - 1, 2**d
            best = np.full(n, 1e-6)
            for j in range(x.shape[1]):
                key = (at - first) * width + binned[:, j]
                gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(axis=1)
                hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(cuts[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                better = gain[np.arange(n), k] > best
                best = np.where(better, gain[np.arange(n), k], best)
                f[first : first + n][better] = j
                t[first : first + n][better] = cuts[j][k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > t[at])
        leaf = at - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += v[leaf]
        features.append(f), thresholds.append(t), values.append(v)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(values))
