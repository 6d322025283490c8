"""Gradient-boosted regression trees for log loss, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: node i splits feature[t, i] at cut[t, i]; leaf[t] has 2**depth values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = self.leaf.shape[1].bit_length() - 1
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Trees of the best second-order gain, level by level. Splits are at quantiles of the rows."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], 1)  # value > cuts[b] iff bin > b
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            for j in range(d):
                key = local * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gl, hl = gs[:, :-1], hs[:, :-1]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + l2)
                gain[(hl < least * 0.05) | (hr < least * 0.05)] = 0
                gain[:, len(cuts[j]) :] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                for i in np.flatnonzero(top > best):
                    best[i] = top[i]
                    feature[t, first + i], cut[t, first + i] = j, cuts[j][b[i]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        local = at - inner
        leaf[t] = rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + l2)
        margin += leaf[t][local]
    return Trees(feature, cut, leaf, base)
