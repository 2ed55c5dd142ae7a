"""A linear-chain conditional random field with labels 0 and 1 over binary features, trained and applied in batches.

A sequence's positions have lists of active features; the weights of these add up to the position's score for label 1
against 0. Sequences of a batch are padded, and a mask tells the padding.
"""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass
class Chain:
    weights: np.ndarray  # of each feature; feature 0 is no feature and weighs nothing
    bias: float
    moves: np.ndarray  # 2 x 2, from the label before to the next one

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=-1) + self.bias


def padded(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences one after another as the rows of a matrix, and the mask of what isn't padding."""
    mask = np.arange(int(counts.max(initial=0)))[None, :] < counts[:, None]
    out = np.zeros(mask.shape, flat.dtype)
    out[mask] = flat
    return out, mask


def forward_backward(u: np.ndarray, counts: np.ndarray, moves: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None):
    """Marginals of label 1 (0 in the padding), expected numbers of moves, and the log of the partition function.

    u: scores, sequences x positions, of which the first counts hold; start, end: messages into the first and last ones.
    """
    s, n = u.shape
    order = np.argsort(-counts, kind="stable")  # at each position only the first rows are still alive
    alive = np.searchsorted(-counts[order], -np.arange(1, n + 1), side="right")
    v = np.exp(np.clip(u[order], -30, 30))
    e, pairs, logz = np.exp(moves), np.zeros((2, 2)), 0.0
    forward, p = np.zeros((n, s, 2)), np.zeros((s, n))
    for t in range(n):
        k = alive[t]
        if t:
            a = forward[t - 1, :k] @ e
        else:
            a = np.ones((k, 2)) if start is None else np.tile(start @ e, (k, 1))
        a[:, 1] *= v[:k, t]
        total = a.sum(axis=1, keepdims=True)
        logz += float(np.log(total).sum())
        forward[t, :k] = a / total
    last = np.ones(2) if end is None else end
    b = np.tile(last, (s, 1))
    for t in range(n - 1, -1, -1):
        k = alive[t]
        both = forward[t, :k] * b[:k]
        p[:k, t] = both[:, 1] / both.sum(axis=1)
        if t:
            out = b[:k].copy()
            out[:, 1] *= v[:k, t]
            joint = forward[t - 1, :k, :, None] * e[None] * out[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = out @ e.T
            b[:k] = back / back.sum(axis=1, keepdims=True)
    result = np.empty_like(p)
    result[order] = p
    return result, pairs, logz


def train(features: np.ndarray | tuple[np.ndarray, np.ndarray], labels: np.ndarray, counts: np.ndarray, n_features: int, steps: int = 80, rate: float = 0.2, penalty: float | np.ndarray = 2.0) -> Chain:
    """Penalised maximum likelihood by full gradients with per-weight step sizes; the penalty may be one for each feature.

    features (positions x active ones, or the positions and features of just the active ones) and labels of all sequences, one after another.
    """
    w, size = np.zeros(n_features + 5), max(1, len(labels))  # features, bias, moves
    weigh = np.full(n_features + 5, 2.0)
    weigh[:n_features] = penalty
    weigh[n_features] = 0.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    if isinstance(features, tuple):
        at, active = features
    else:
        at, column = np.nonzero(features)
        active = features[at, column]
    y = labels.astype(float)
    seen = np.zeros((2, 2))
    inner = np.ones(max(0, len(labels) - 1), bool)
    inner[np.cumsum(counts)[:-1] - 1] = False
    np.add.at(seen, (labels[:-1][inner], labels[1:][inner]), 1)
    for step in range(1, steps + 1):
        moves = w[n_features + 1 :].reshape(2, 2)
        u, mask = padded(np.bincount(at, w[active], len(labels)) + w[n_features], counts)
        p, pairs, _ = forward_backward(u, counts, moves)
        g = np.zeros_like(w)
        miss = p[mask] - y
        g[:n_features] = np.bincount(active, miss[at], minlength=n_features)
        g[n_features], g[n_features + 1 :] = miss.sum(), (pairs - seen).ravel()
        g = (g + weigh * w) / size
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w[0] = 0
    return Chain(w[:n_features], float(w[n_features]), w[n_features + 1 :].reshape(2, 2))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of the columns of x and, last, the constant, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.ones(len(x)) if weight is None else weight
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + ridge
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge @ w)
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def at_threshold(p: np.ndarray, y: np.ndarray, threshold: float, weight: np.ndarray | None = None) -> float:
    """The shift in log-odds after which cutting at threshold is right most often on (p, y), both classes alike."""
    z = np.log(p / (1 - p))
    order = np.argsort(z)
    z, y = z[order], np.asarray(y)[order]
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    # with the cut before position i: ones from i on are right, zeros before i are
    right = (y.sum() - np.concatenate([[0], np.cumsum(y)])) / n1 + np.concatenate([[0], np.cumsum(1 - y)]) / n0
    best = np.flatnonzero(right >= right.max() - 1e-12)
    i = int(best[len(best) // 2])
    low = z[i - 1] if i else z[0] - 1
    high = z[i] if i < len(z) else z[-1] + 1
    return float(np.log(threshold / (1 - threshold)) - (low + high) / 2)
