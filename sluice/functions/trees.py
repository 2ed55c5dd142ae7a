"""Trees over binned columns, in numpy: what one task fits, and what a batch of rows is scored by."""

from __future__ import annotations

import dataclasses
import io

import numpy as np

#: Bins of a column at most, cells of a histogram held at once, and the gain that a split must exceed.
BINS, CELLS, GAIN = 64, 1 << 17, 1e-9
#: Nodes of so many rows at most have histograms by the rank of a row's code in its node, of as many places.
FEW = (4, 8, 16, 32)
#: Trees with more nodes in all stay packed, and one at a time is unpacked.
NODES = 1 << 19
#: A leaf's cut: every code is at most this, so that rows stay in it.
_STAY = 255


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Cut points of each column, midway between distinct neighbours: all, or those next to quantiles where there are more than the bins."""
    out = []
    for column in x.T:
        known = np.sort(column[np.isfinite(column)])
        values = np.unique(known)
        after = np.arange(len(values) - 1)
        if len(values) > BINS:
            at = np.quantile(known, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")
            after = np.unique(np.minimum(np.searchsorted(values, at), len(values) - 2))
        out.append(values[after] / 2 + values[after + 1] / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value; NaN is above all."""
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)


@dataclasses.dataclass
class Trees:
    """Nodes of all trees: rows whose code is above the cut go to child + 1, others to child; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        rows = np.arange(len(codes))[:, None]
        at = np.repeat(self.roots[None], len(codes), axis=0)
        for _ in range(self.depth):
            at = self.child[at] + (codes[rows, self.feature[at]] > self.cut[at])
        return at

    def total(self, codes: np.ndarray, batch: int = 512) -> np.ndarray:
        """(rows, outputs), values added up over the trees."""
        parts = [self.value[self.leaves(codes[i : i + batch])].sum(axis=1) for i in range(0, len(codes), batch)]
        return np.concatenate(parts) if parts else np.zeros((0, self.value.shape[1]))

    def pack(self) -> bytes:
        """Values that recur, as of pure leaves, are stored once."""
        out, (values, which) = io.BytesIO(), np.unique(self.value, axis=0, return_inverse=True)
        few = {"value": values, "which": which.ravel().astype(np.int32)} if 2 * len(values) < len(self.value) else {}
        np.savez_compressed(out, **vars(self) | few)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Trees:
        with np.load(io.BytesIO(data)) as f:
            parts = {k: f[k] if k != "depth" else int(f[k]) for k in f.files}
        if "which" in parts:
            parts["value"] = parts["value"][parts.pop("which")]
        return cls(**parts)


def together(trees: list[Trees]) -> Trees:
    starts = np.cumsum([0, *(len(t.feature) for t in trees)])
    moved = {k: np.concatenate([getattr(t, k) + s for t, s in zip(trees, starts, strict=False)]).astype(np.int32) for k in ("roots", "child")}
    same = {k: np.concatenate([getattr(t, k) for t in trees]) for k in ("feature", "cut", "value")}
    return Trees(**moved, **same, depth=max(t.depth for t in trees))


def sized(packed: list[bytes]) -> list[Trees] | list[bytes]:
    """One group of all trees, or what was given if they have many nodes."""
    if sum(len(Trees.unpack(p).feature) for p in packed) > NODES:
        return packed
    return [together([Trees.unpack(p) for p in packed])]


def _middle(gain: np.ndarray, width: int) -> np.ndarray:
    """Of each row the place of its maximum: the middle one, if cuts of one column tie because bins between are empty."""
    first, last = gain.argmax(axis=1), gain.shape[1] - 1 - gain[:, ::-1].argmax(axis=1)
    rows, end = np.arange(len(gain)), np.minimum(last, (first // width + 1) * width - 1)
    middle = (first + end) // 2
    return np.where(gain[rows, middle] == gain[rows, first], middle, first)


def _dense(codes: np.ndarray, bins: int, rows: np.ndarray, counts: np.ndarray, gains) -> np.ndarray:
    """The best cut of each node, feature * (bins - 1) + code, or -1. Rows stand node by node, counts says how many each has."""
    f = codes.shape[1]
    place = (np.repeat(np.arange(len(counts)), counts)[:, None] * f + np.arange(f)) * bins + codes[rows]
    gain = gains(rows, place, len(counts), bins)
    best = _middle(gain, bins - 1)
    return np.where(gain[np.arange(len(counts)), best] > GAIN, best, -1)


def _few(codes: np.ndarray, bins: int, rows: np.ndarray, counts: np.ndarray, gains, most: int) -> np.ndarray:
    """As _dense, the same cuts, for nodes of few rows: cuts between codes that a node has are all there is to try."""
    f, k = codes.shape[1], np.arange(len(counts))
    there = np.arange(most) < counts[:, None]
    code = np.full((len(counts), most, f), _STAY, np.uint8)
    code[there] = codes[rows]
    rank = np.zeros_like(code)
    for i in range(most):
        rank += code[:, i : i + 1] < code
    place = (np.repeat(k, counts)[:, None] * f + np.arange(f)) * most + rank[there]
    gain = gains(rows, place, len(counts), most)
    first, last = gain.argmax(axis=1), gain.shape[1] - 1 - gain[:, ::-1].argmax(axis=1)
    column, other = first // (most - 1), last // (most - 1)
    code, rank = (v[k, :, column].astype(np.int64) for v in (code, rank))
    low = np.where(there & (rank <= (first % (most - 1))[:, None]), code, 0).max(axis=1)
    above = np.where(rank > (last % (most - 1))[:, None], code, _STAY).min(axis=1)  # ties go as far as the next code that is there
    middle = (low + np.where(other == column, above - 1, bins - 2)) // 2
    at = (code <= middle[:, None]).sum(axis=1) - 1
    same = (at < most - 1) & (gain[k, column * (most - 1) + np.clip(at, 0, most - 2)] == gain[k, first])
    return np.where(gain[k, first] > GAIN, column * (bins - 1) + np.where(same, middle, low), -1)


def grow(codes: np.ndarray, sums, score, enough, divisible, depth: int, bins: int = 0) -> tuple[Trees, np.ndarray]:
    """A tree without values, level by level, and the leaf of each row.

    sums(rows, place, size, f) adds the rows' figures up by place, (figures, size), each row f times; score values a group
    by its sums, enough says whether it may stand alone, divisible whether a split is worth a search. Nodes of a level are
    taken in blocks of a bounded histogram, those of few rows with a narrower one.
    """
    n, f = codes.shape
    bins = bins or int(codes.max(initial=0)) + 1
    feature, cut, child = np.zeros(1, np.int32), np.full(1, _STAY, np.uint8), np.zeros(1, np.int32)
    at, rows, first, levels = np.zeros(n, np.int32), np.arange(n), 0, 0

    def gains(some, place, k, width):
        left = sums(some, place.ravel(), k * f * width, f).reshape(-1, k, f, width).cumsum(axis=3)
        total, left = left[..., -1:], left[..., :-1]
        right = total - left
        return np.where(enough(left) & enough(right), score(left) + score(right) - score(total), -np.inf).reshape(k, -1)

    while levels < depth and bins > 1 and len(rows):
        m = len(feature) - first
        may = divisible(sums(rows, at[rows] - first, m, 1))
        rows, slot, tried = rows[may[at[rows] - first]], np.cumsum(may) - 1, np.flatnonzero(may)
        where = slot[at[rows] - first]
        rows = rows[np.argsort(where, kind="stable")]
        counts = np.bincount(where, minlength=len(tried))
        starts, found = np.cumsum(counts) - counts, np.full(len(tried), -1)
        widths = [w for w in FEW if w < bins]
        kind = np.searchsorted(widths, counts)
        for i, width in enumerate([*widths, bins]):
            nodes, step = np.flatnonzero(kind == i), max(1, CELLS // (f * width))
            for lo in range(0, len(nodes), step):
                some = nodes[lo : lo + step]
                c = counts[some]
                here = rows[np.repeat(starts[some] - np.cumsum(c) + c, c) + np.arange(c.sum())]
                found[some] = _dense(codes, bins, here, c, gains) if width == bins else _few(codes, bins, here, c, gains, width)
        split = np.flatnonzero(found >= 0)
        if not len(split):
            break
        nodes = first + tried[split]
        feature[nodes], cut[nodes] = found[split] // (bins - 1), found[split] % (bins - 1)
        child[nodes] = first + m + 2 * np.arange(len(split))
        rows = rows[np.repeat(found >= 0, counts)]
        first, levels, more = first + m, levels + 1, 2 * len(split)
        here = at[rows]
        at[rows] = child[here] + (codes[rows, feature[here]] > cut[here])
        feature = np.concatenate([feature, np.zeros(more, np.int32)])
        cut = np.concatenate([cut, np.full(more, _STAY, np.uint8)])
        child = np.concatenate([child, np.arange(first, first + more, dtype=np.int32)])
    return Trees(np.zeros(1, np.int32), feature, cut, child, np.zeros((len(feature), 1)), levels), at


@dataclasses.dataclass(frozen=True)
class Boosting:
    """Rounds at most, and after how many without gain on the validation rows training ends; the settings of a tree.

    rows and columns are the parts that a round sees, leaf and weight a leaf's rows and curvature at least, penalty the
    one on leaves' squared values.
    """

    rounds: int
    patience: int
    depth: int
    step: float
    rows: float = 1.0
    columns: float = 1.0
    leaf: int = 1
    weight: float = 0.0
    penalty: float = 0.0


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) with the least loss before patience rounds bring no gain, and whether it came to that."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boost(codes: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, how: Boosting, seed: int) -> Trees:
    """Logistic boosting of y (0 or 1) with weights w, ended by the rows that are held and cut after the best round.

    The first tree is a leaf, the logarithm of the odds. Without held rows all rounds are made.
    """
    def loss() -> float:
        return float(np.average(np.logaddexp(0, margin[held]) - y[held] * margin[held], weights=w[held]))

    learn = np.flatnonzero(~held)
    f = codes.shape[1]
    p = np.clip(np.average(y[learn], weights=w[learn]), 1e-6, 1 - 1e-6)
    margin = np.full(len(y), np.log(p / (1 - p)))
    made = [Trees(np.zeros(1, np.int32), np.zeros(1, np.int32), np.full(1, _STAY, np.uint8), np.zeros(1, np.int32), np.full((1, 1), margin[0]), 0)]
    losses: list[float] = []
    for i in range(how.rounds):
        rng = np.random.default_rng([seed, i])
        rows = learn if how.rows >= 1 else np.sort(rng.choice(learn, max(1, round(how.rows * len(learn))), replace=False))
        columns = np.arange(f) if how.columns >= 1 else np.sort(rng.choice(f, max(1, round(how.columns * f)), replace=False))
        p = 1 / (1 + np.exp(-margin[rows]))
        g, h = w[rows] * (p - y[rows]), w[rows] * p * (1 - p)

        def sums(some, place, size, f, g=g, h=h):
            return np.stack([np.bincount(place, np.repeat(v[some], f), size) for v in (g, h)] + [np.bincount(place, minlength=size)])

        def score(s):
            return s[0] ** 2 / (s[1] + how.penalty + 1e-12)

        def enough(s):
            return (s[2] >= how.leaf) & (s[1] >= how.weight)

        def divisible(s):
            return (s[2] >= max(2, 2 * how.leaf)) & (s[1] >= 2 * how.weight)

        tree, at = grow(codes[np.ix_(rows, columns)], sums, score, enough, divisible, how.depth)
        tree.feature = columns[tree.feature].astype(np.int32)
        gs, hs = (np.bincount(at, v, len(tree.feature)) for v in (g, h))
        tree.value = (-how.step * gs / (hs + how.penalty + 1e-12))[:, None]
        margin += tree.total(codes)[:, 0]
        made.append(tree)
        if held.any():
            losses.append(loss())
            if best_round(losses, how.patience)[1]:
                break
    return together(made[: 1 + best_round(losses, how.patience)[0]] if losses else made)


def bag(codes: np.ndarray, label: np.ndarray, w: np.ndarray, classes: int, depth: int, seed: int) -> Trees:
    """A tree on rows drawn with replacement; its leaves' values are the classes' shares."""
    n = len(codes)
    drawn = np.bincount(np.random.default_rng(seed).integers(0, n, n), minlength=n)
    rows = np.flatnonzero(drawn)
    return full(codes[rows], label[rows], (w * drawn)[rows], classes, depth)


def full(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, depth: int, bins: int = 0) -> Trees:
    """A tree on all rows; its leaves' values are the classes' shares. bins: of the codes of other rows too, as ties between cuts depend on it."""
    label = label.astype(np.int64)

    def sums(some, place, size, f):
        return np.bincount(place + np.repeat(label[some] * size, f), np.repeat(weight[some], f), size * classes).reshape(classes, size)

    def score(s):
        return (s**2).sum(axis=0) / np.maximum(s.sum(axis=0), 1e-12)

    def enough(s):
        return s.sum(axis=0) > 1e-9

    def divisible(s):
        return s.max(axis=0) < s.sum(axis=0) - 1e-9

    tree, at = grow(codes, sums, score, enough, divisible, depth, bins)
    shares = np.bincount(at.astype(np.int64) * classes + label, weight, len(tree.feature) * classes).reshape(-1, classes)
    tree.value = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-12)
    return tree
