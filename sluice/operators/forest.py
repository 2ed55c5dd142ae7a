"""Bagged trees on more rows than one task takes: cuts and upper nodes from counts over all rows, each smaller node in a task.

Rows travel as blocks of codes, a byte a cell. What a tree draws of a block follows from the seed, so that nothing is kept between jobs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions import trees

#: Rows of a block, places that a column's values are counted in at once, and bytes of drawn rows shuffled at once.
BLOCK, PLACES, BYTES = 4096, 2048, 1 << 28


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _values(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.float64)


def _few(rows: DataFrame, width: int) -> list[np.ndarray | None]:
    """The values of each column, None where there are more than the bins."""

    def run(batches):
        had = [np.zeros(0)] * width
        for b in batches:
            x = _matrix(b.x)
            had = [h if h is None else np.unique(np.concatenate([h, c[np.isfinite(c)]])) for h, c in zip(had, x.T, strict=True)]
            had = [h if h is None or len(h) <= trees.BINS else None for h in had]
        yield pd.DataFrame({"c": range(width), "v": [None if h is None else list(h) for h in had]})

    parts = rows.mapInPandas(run, "c int, v array<double>").groupBy("c")
    made = parts.agg(F.bool_or(F.col("v").isNull()).alias("many"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v")).collect()
    out = {r.c: None if r.many or len(r.v) > trees.BINS else np.array(r.v, np.float64) for r in made}
    return [out.get(c, np.zeros(0)) for c in range(width)]


def _counted(rows: DataFrame, edges: dict[int, np.ndarray]) -> pd.DataFrame:
    """(c, i, n, low, high): how many values of a column are from edge i to the next, and the outer ones."""

    def run(batches):
        for b in batches:
            x = _matrix(b.x)
            for c, e in edges.items():
                keys = np.sort(_ordered(x[np.isfinite(x[:, c]), c]))
                at = np.append(np.searchsorted(keys, e), len(keys))
                i = np.flatnonzero(np.diff(at))
                yield pd.DataFrame({"c": c, "i": i, "n": np.diff(at)[i], "low": keys[at[i]], "high": keys[at[i + 1] - 1]})

    made = rows.mapInPandas(run, "c int, i int, n long, low long, high long").groupBy("c", "i")
    return made.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values(["c", "i"])


def cuts_of(rows: DataFrame, width: int) -> list[np.ndarray]:
    """As trees.cuts_of, of all rows' x: values at quantiles are counted in, place by place, until each is alone in its place."""
    few = _few(rows, width)
    edges = {c: np.linspace(-(2.0**63), 2.0**63, PLACES, endpoint=False).astype(np.int64) for c in range(width) if few[c] is None}
    cuts = [None if v is None else v[:-1] / 2 + v[1:] / 2 for v in few]
    while edges:
        for c, got in _counted(rows, edges).groupby("c"):
            ends, low, high = got.n.cumsum().to_numpy(), got.low.to_numpy(), got.high.to_numpy()
            want = np.floor(np.linspace(0, 1, trees.BINS + 1)[1:-1] * (ends[-1] - 1)).astype(np.int64)
            at = np.unique(np.minimum(np.searchsorted(ends, want, side="right"), len(ends) - 1))
            last = at[-1] == len(ends) - 1 and low[-1] == high[-1]
            at = np.unique(np.where(last & (at == len(ends) - 1), at - 1, at))  # above a column's greatest value there is no cut
            wide = at[low[at] != high[at]]
            if len(wide):
                parts = max(2, PLACES // (2 * len(at)))
                inner = [int(low[a]) + (int(high[a]) - int(low[a]) + 1) * k // parts for a in wide for k in range(parts)]
                edges[c] = np.unique(np.array([*inner, *(int(high[a]) + 1 for a in wide if high[a] < 2**63 - 1), *low[at], *low[np.minimum(at + 1, len(low) - 1)], -(2**63)], np.int64))
            else:
                cuts[c] = _values(low[at]) / 2 + _values(low[at + 1]) / 2
                del edges[c]
    return cuts


def blocks_of(rows: DataFrame, cuts: list[np.ndarray], n: int) -> DataFrame:
    """(block, codes, label, w, copies, size), rows dealt by a digest: the same for any partitions. Equal rows are one with its number of copies."""

    def binned(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"codes": [r.tobytes() for r in trees.binned(_matrix(b.x), cuts)], "label": b.label, "w": b.w})

    def packed(batches):
        for b in batches:
            for block, some in zip(b.block, b.some, strict=True):
                columns = {k: [r[k] for r in some] for k in ("label", "w", "n")}
                arrays = [np.array(columns[k], t).tobytes() for k, t in (("label", np.int32), ("w", np.float64), ("n", np.int64))]
                yield pd.DataFrame({"block": [block], "codes": [b"".join(r["codes"] for r in some)], "label": [arrays[0]], "w": [arrays[1]], "copies": [arrays[2]], "size": [sum(columns["n"])]})

    equal = rows.mapInPandas(binned, "codes binary, label int, w double").groupBy("codes", "label", "w").agg(F.count("*").alias("n"))
    dealt = equal.withColumn("block", F.pmod(F.xxhash64("codes", "label", "w"), F.lit(-(-n // BLOCK))).cast("int"))
    some = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("codes", "label", "w", "n"))).alias("some"))
    with staging.small_batches(rows.sparkSession, 8):
        return staging.stage(some.mapInPandas(packed, "block int, codes binary, label binary, w binary, copies binary, size long"), "blocks")


def _reached(batches, made: dict[int, trees.Trees], wanted: dict[int, list[int]], sizes: np.ndarray, seed: int):
    """(tree, node, block, codes, labels, weights) of the rows that each tree draws and that come to a wanted node.

    A tree draws with replacement as many rows as there are: how many of each block, and of these how often each row.
    """
    of_blocks = {t: np.random.default_rng([seed, t]).multinomial(sizes.sum(), sizes / sizes.sum()) for t in made}
    for b in batches:
        for r in b.itertuples(index=False):
            label, w, copies = np.frombuffer(r.label, np.int32), np.frombuffer(r.w), np.frombuffer(r.copies, np.int64)
            codes = np.frombuffer(r.codes, np.uint8).reshape(len(label), -1)
            for t, tree in made.items():
                drawn = np.random.default_rng([seed, t, r.block]).multinomial(of_blocks[t][r.block], copies / copies.sum())
                at = np.where(drawn > 0, tree.leaves(codes)[:, 0], -1)
                for node in np.intersect1d(at, wanted.get(t, [])):
                    here = at == node
                    yield t, int(node), r.block, codes[here], label[here], (w * drawn)[here]


def _best(hist: np.ndarray) -> tuple[int, int, int, int]:
    """(feature, cut, rows on the left, on the right) of (classes and number of rows, features, bins), feature -1 without a gain."""
    left = hist.cumsum(axis=2)
    total, left = left[..., -1:], left[..., :-1]
    right = total - left
    score = [(s[:-1] ** 2).sum(axis=0) / np.maximum(s[:-1].sum(axis=0), 1e-12) for s in (left, right, total)]
    mixed = total[:-1, 0, 0].max() < total[:-1, 0, 0].sum() - 1e-9
    fit = mixed & (left[:-1].sum(axis=0) > 1e-9) & (right[:-1].sum(axis=0) > 1e-9)
    gain = np.where(fit, score[0] + score[1] - score[2], -np.inf).reshape(1, -1)
    at = int(trees._middle(gain, hist.shape[2] - 1)[0])
    feature, cut = divmod(at, hist.shape[2] - 1)
    return (feature if gain[0, at] > trees.GAIN else -1), cut, int(left[-1, feature, cut]), int(right[-1, feature, cut])


def fit(rows: DataFrame, classes: int, n: int, depth: int, seed: int, within: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Cuts and n packed trees of (x, label, w); nodes of more rows than within are split by counts over all blocks."""
    width = len(rows.first().x)
    with staging.scope():
        rows = staging.stage(rows, "training")
        cuts = cuts_of(rows, width)
        total = rows.count()
        blocks = blocks_of(rows, cuts, total)
        sizes = np.zeros(-(-total // BLOCK), np.int64)
        for r in blocks.select("block", "size").toLocalIterator():
            sizes[r.block] = r.size
        step = max(1, BYTES // (total * (width + 12)))
        packed: list[bytes] = []
        for lo in range(0, n, step):
            packed += _round(blocks, sizes, range(lo, min(n, lo + step)), classes, width, max(map(len, cuts)) + 1, depth, seed, within)
    return cuts, packed


def _round(blocks: DataFrame, sizes: np.ndarray, numbers: range, classes: int, width: int, bins: int, depth: int, seed: int, within: int) -> list[bytes]:
    def empty(m: int) -> trees.Trees:
        return trees.Trees(np.zeros(1, np.int32), np.zeros(m, np.int32), np.full(m, trees._STAY, np.uint8), np.arange(m, dtype=np.int32), np.zeros((m, classes)), 0)

    def counts(made, wanted) -> Callable:
        def run(batches):
            sums: dict[tuple[int, int], np.ndarray] = {}
            for t, node, _, codes, label, w in _reached(batches, made, wanted, sizes, seed):
                place = np.arange(width) * bins + codes
                size = width * bins
                hist = np.bincount((label[:, None].astype(np.int64) * size + place).ravel(), np.repeat(w, width), classes * size)
                hist = np.concatenate([hist, np.bincount(place.ravel(), minlength=size)]).reshape(classes + 1, width, bins)
                sums[t, node] = sums[t, node] + hist if (t, node) in sums else hist
            for (t, node), hist in sums.items():
                yield pd.DataFrame({"tree": [t], "node": [node], "hist": [hist.tobytes()]})

        return run

    def best(some: pd.DataFrame) -> pd.DataFrame:
        hist = sum(np.frombuffer(h) for h in some["hist"]).reshape(classes + 1, width, bins)
        feature, cut, left, right = _best(hist) if bins > 1 else (-1, 0, 0, 0)
        return pd.DataFrame({"tree": some.tree[:1], "node": some.node[:1], "feature": feature, "cut": cut, "left": left, "right": right, "value": [list(hist[:-1, 0].sum(axis=1))]})

    def sent(made, wanted) -> Callable:
        def run(batches):
            for t, node, block, codes, label, w in _reached(batches, made, wanted, sizes, seed):
                yield pd.DataFrame({"tree": [t], "node": [node], "block": [block], "codes": [codes.tobytes()], "label": [label.tobytes()], "w": [w.tobytes()]})

        return run

    def grown(level) -> Callable:
        def run(some: pd.DataFrame) -> pd.DataFrame:
            some = some.sort_values("block")
            codes, label, w = (np.frombuffer(b"".join(some[k]), t) for k, t in (("codes", np.uint8), ("label", np.int32), ("w", np.float64)))
            t, node = int(some.tree.iloc[0]), int(some.node.iloc[0])
            tree = trees.full(codes.reshape(len(label), -1), label, w, classes, depth - level[t, node], bins)
            return pd.DataFrame({"tree": [t], "node": [node], "made": [tree.pack()]})

        return run

    level = {(t, 0): 0 for t in numbers}
    made, wide, small = {t: empty(1) for t in numbers}, {t: [0] for t in numbers}, {t: [] for t in numbers}
    while any(wide.values()):
        found = blocks.mapInPandas(counts(made, wide), "tree int, node int, hist binary").groupBy("tree", "node")
        found = found.applyInPandas(best, "tree int, node int, feature int, cut int, left long, right long, value array<double>").collect()
        wide = {t: [] for t in numbers}
        for r in sorted(found):
            tree, m = made[r.tree], len(made[r.tree].feature)
            tree.value[r.node] = np.array(r.value) / max(sum(r.value), 1e-12)
            if r.feature < 0 or level[r.tree, r.node] >= depth:
                continue
            more = empty(2)
            for k in ("feature", "cut", "value"):
                setattr(tree, k, np.concatenate([getattr(tree, k), getattr(more, k)]))
            tree.child = np.append(tree.child, np.array([m, m + 1], np.int32))
            tree.feature[r.node], tree.cut[r.node], tree.child[r.node] = r.feature, r.cut, m
            tree.depth = max(tree.depth, level[r.tree, r.node] + 1)
            for node, size in ((m, r.left), (m + 1, r.right)):
                level[r.tree, node] = level[r.tree, r.node] + 1
                (wide if size > within else small)[r.tree].append(node)
    with staging.small_batches(blocks.sparkSession, 100):
        rest = blocks.mapInPandas(sent(made, small), "tree int, node int, block int, codes binary, label binary, w binary").groupBy("tree", "node")
        for r in sorted(rest.applyInPandas(grown(level), "tree int, node int, made binary").collect()):
            sub = trees.Trees.unpack(bytes(r.made))
            _graft(made[r.tree], r.node, sub)
            made[r.tree].depth = max(made[r.tree].depth, level[r.tree, r.node] + sub.depth)
    return [made[t].pack() for t in numbers]


def _graft(tree: trees.Trees, node: int, sub: trees.Trees) -> None:
    """sub takes a leaf's place; its other nodes come last."""
    shift = len(tree.feature) - 1
    tree.feature[node], tree.cut[node], tree.value[node] = sub.feature[0], sub.cut[0], sub.value[0]
    tree.child[node] = sub.child[0] + shift if sub.child[0] else node
    tree.child = np.append(tree.child, (sub.child[1:] + shift).astype(np.int32))
    for k in ("feature", "cut", "value"):
        setattr(tree, k, np.concatenate([getattr(tree, k), getattr(sub, k)[1:]]))
