"""Gradient-boosted trees for two classes, small enough to be trained on the driver and applied with numpy."""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass
class Trees:
    start: float
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each tree: features, thresholds, leaf values; heap order

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, leaf in self.splits:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.25, penalty: float = 1.0) -> Trees:
    """Logistic loss, second-order leaves, splits between distinct values (at most 32 of a feature)."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33), method="lower"))[:-1] for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    width = max(len(c) for c in cuts) + 1
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(len(y), np.log(mean / (1 - mean)))
    out = Trees(float(score[0]), [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        inner = 2**depth - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows) > 10:
                gs, hs = g[rows], h[rows]
                whole = gs.sum() ** 2 / (hs.sum() + penalty)
                for f, c in enumerate(cuts):
                    if len(c):
                        gl = np.cumsum(np.bincount(bins[rows, f], gs, width))[: len(c)]
                        hl = np.cumsum(np.bincount(bins[rows, f], hs, width))[: len(c)]
                        gain = gl**2 / (hl + penalty) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + penalty) - whole
                        gain[(hl < 0.5) | (hs.sum() - hl < 0.5)] = -1
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, feature[node], cut[node] = gain[k], f, c[k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        for k in range(inner + 1):
            rows = at == inner + k
            leaf[k] = rate * g[rows].sum() / (h[rows].sum() + penalty)
        score += leaf[at - inner]
        out.splits.append((feature, cut, leaf))
    return out
