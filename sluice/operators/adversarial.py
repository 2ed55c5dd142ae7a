"""Rows that a fitted classifier takes for another class: gradient attacks on nets, and attacks that only ask a model.

Every attack works on a batch of rows in step, row by row on its own: what a row becomes depends on it and its key, not on
its batch or partition. Columns that must not change are masked: attacks move the others only, within the box of low and
high. y is each row's class; attacks look for any other class, or with targeted for y itself.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import nets
from sluice.functions.arrow import tidy

# Parameters of the attacks, as configured for the two data sets alike (but for jsma's max_iter, which bounds its steps).
PARAMETERS = {
    "zoo": {"confidence": 0.0, "targeted": False, "learning_rate": 0.05, "max_iter": 150, "binary_search_steps": 3, "initial_const": 1e-3, "abort_early": True, "nb_parallel": 10, "batch_size": 64, "variable_h": 0.02},
    "hsja": {"batch_size": 16, "targeted": False, "max_iter": 10, "max_eval": 600, "init_eval": 20, "init_size": 20},
    "jsma": {"theta": 0.02, "gamma": 0.1, "batch_size": 64, "max_iter": 1000},
    "fgsm": {"eps": 0.1, "batch_size": 64, "targeted": False},
    "pgd": {"num_random_init": 10, "eps": 0.2, "eps_step": 0.01, "batch_size": 64, "targeted": True, "max_iter": 200},
    "deepfool": {"max_iter": 100, "batch_size": 64, "nb_grads": 5, "epsilon": 1e-6},
    "cw": {"confidence": 0.0, "learning_rate": 0.01, "binary_search_steps": 3, "max_iter": 3, "batch_size": 64, "initial_const": 0.01, "max_halving": 5, "max_doubling": 5},
}
#: Attacks that need derivatives; the others ask any model for its answers.
GRADIENT = ("fgsm", "pgd", "deepfool", "cw", "jsma")


def parameters(name: str, given: dict | None = None) -> dict:
    """Defaults with known names replaced; others are ignored."""
    if name not in PARAMETERS:
        raise ValueError(f"unknown attack: {name}")
    base = PARAMETERS[name]
    return base | {k: v for k, v in (given or {}).items() if k in base}


@dataclasses.dataclass
class Batch:
    """Rows x with classes y, which columns may move, bounds of their values, a source of random numbers for each row, and when to give up."""

    x: np.ndarray
    y: np.ndarray
    free: np.ndarray
    low: float
    high: float
    keys: np.ndarray
    seed: int = 42
    until: float = float("inf")

    def __post_init__(self):
        self._sources = None

    def sources(self):
        if self._sources is None:
            self._sources = [np.random.Generator(np.random.Philox(key=[self.seed, int(k) & (1 << 64) - 1])) for k in self.keys]
        return self._sources

    def drawn(self, rows: np.ndarray, draw: Callable) -> np.ndarray:
        own = self.sources()
        return np.stack([draw(own[i]) for i in rows])

    def boxed(self, x: np.ndarray) -> np.ndarray:
        """Within the box, but for columns that must not change: a value beyond the box stays there."""
        return np.where(self.free, np.clip(x, self.low, self.high), x)

    def check(self) -> None:
        if time.monotonic() > self.until:
            raise TimeoutError


def classes(p: np.ndarray) -> np.ndarray:
    """The class of each row, ties to the smaller one."""
    return p.argmax(axis=1)


def _hit(model, x: np.ndarray, y: np.ndarray, targeted: bool) -> np.ndarray:
    return (classes(model.shares(x)) == y) == targeted


@dataclasses.dataclass
class Scaled:
    """A model as it looks where every column lies between 0 and 1; one that is constant stays at 0."""

    model: object
    low: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, model, low: np.ndarray, high: np.ndarray) -> Scaled:
        """With derivatives only if the model has them."""
        return (_ScaledNet if hasattr(model, "pull") else cls)(model, low, high - low)

    def shares(self, x: np.ndarray) -> np.ndarray:
        return self.model.shares(x * self.width + self.low)

    def inside(self, x: Column) -> Column:
        flat = [float(w) if w else 1.0 for w in self.width]
        return F.zip_with(F.zip_with(x, F.lit(self.low.tolist()), lambda v, a: v - a), F.lit(flat), lambda v, w: v / w)

    def outside(self, x: Column) -> Column:
        return F.zip_with(F.zip_with(x, F.lit(self.width.tolist()), lambda v, w: v * w), F.lit(self.low.tolist()), lambda v, a: v + a)


class _ScaledNet(Scaled):
    @property
    def classes(self) -> int:
        return self.model.classes

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.model.logits(x * self.width + self.low)

    def pull(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.model.pull(x * self.width + self.low, weights) * self.width

    def jacobian(self, x: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return self.model.jacobian(x * self.width + self.low, classes) * self.width


# --- by derivatives -------------------------------------------------------------------------------------------------------
def _uphill(net: nets.Net, x: np.ndarray, y: np.ndarray, targeted: bool) -> np.ndarray:
    """Where the cross-entropy of y rises, or falls if y is the target."""
    p = net.shares(x)
    g = net.pull(x, p - nets.one_hot(y, p.shape[1]))
    return -g if targeted else g


def fgsm(net: nets.Net, b: Batch, eps: float, targeted: bool, **_) -> np.ndarray:
    """One step of eps along the signs of the loss's gradient."""
    return b.boxed(b.x + eps * np.sign(_uphill(net, b.x, b.y, targeted)) * b.free)


def pgd(net: nets.Net, b: Batch, eps: float, eps_step: float, max_iter: int, num_random_init: int, targeted: bool, **_) -> np.ndarray:
    """Signed steps, each taken back to within eps of the row, from the row or from random starts. A row is done with its first hit."""
    out, left = b.x.copy(), np.flatnonzero(~_hit(net, b.x, b.y, targeted))
    for _ in range(max(1, num_random_init)):
        if not len(left):
            break
        start = b.x[left]
        if num_random_init:
            start = b.boxed(start + b.drawn(left, lambda r: r.uniform(-eps, eps, b.x.shape[1])) * b.free)
        now, rows = start, left
        for _ in range(max_iter):
            b.check()
            now = now + eps_step * np.sign(_uphill(net, now, b.y[rows], targeted)) * b.free
            now = b.boxed(np.clip(now, b.x[rows] - eps, b.x[rows] + eps))
            out[rows] = now
            on = ~_hit(net, now, b.y[rows], targeted)
            now, rows = now[on], rows[on]
            if not len(rows):
                break
        left = rows
    return out


def deepfool(net: nets.Net, b: Batch, max_iter: int, nb_grads: int, epsilon: float, **_) -> np.ndarray:
    """Moves to the nearest boundary of the classifier made linear where the row is, until the class changes, and a bit beyond."""
    now = b.x.copy()
    first = classes(net.shares(b.x))
    rows = np.arange(len(now))
    for _ in range(max_iter):
        b.check()
        f = net.logits(now[rows])
        on = f.argmax(axis=1) == first[rows]
        rows, f = rows[on], f[on]
        if not len(rows):
            break
        own = first[rows]
        others = np.argsort(-np.where(nets.one_hot(own, net.classes) > 0, np.inf, f), axis=1, kind="stable")[:, 1 : 1 + min(nb_grads, net.classes - 1)]
        w = (net.jacobian(now[rows], others) - net.jacobian(now[rows], own[:, None])) * b.free
        gap = np.take_along_axis(f, others, 1) - np.take_along_axis(f, own[:, None], 1)
        square = (w**2).sum(axis=2)
        far = np.where(square > 0, np.abs(gap) / np.sqrt(np.where(square > 0, square, 1)), np.inf)
        best = far.argmin(axis=1)
        at = np.arange(len(rows))
        can = square[at, best] > 0
        step = ((np.abs(gap[at, best]) + 1e-9) / np.where(can, square[at, best], 1) * can)[:, None] * w[at, best]
        now[rows] = b.boxed(now[rows] + step)
    return b.boxed(b.x + (1 + epsilon) * (now - b.x))


def _margin(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the row's class is ahead of the best other one, and that one."""
    own = np.take_along_axis(z, y[:, None], 1)[:, 0]
    rest = np.where(nets.one_hot(y, z.shape[1]) > 0, -np.inf, z)
    return own - rest.max(axis=1), rest.argmax(axis=1)


def cw(net: nets.Net, b: Batch, confidence: float, learning_rate: float, binary_search_steps: int, max_iter: int, initial_const: float, max_halving: int, max_doubling: int, **_) -> np.ndarray:
    """The squared distance plus a constant times the class's lead, made small along its gradient in a space where the box has no borders.

    A step's length is halved until the loss falls, else doubled while it falls further. The constant is searched for: it
    rises tenfold until a row is hit, then lies between the largest that missed and the smallest that hit.
    """
    span = (b.high - b.low) / 2
    inner = lambda x: np.arctanh(np.clip((x - b.low) / span - 1, -1 + 1e-6, 1 - 1e-6))
    n = len(b.x)
    best, best_far = b.x.copy(), np.full(n, np.inf)
    const, under, over = np.full(n, initial_const), np.zeros(n), np.full(n, np.inf)

    def outer(w, rows):
        return np.where(b.free, (np.tanh(w) + 1) * span + b.low, b.x[rows])

    def loss(w, rows):
        x = outer(w, rows)
        lead, _ = _margin(net.logits(x), b.y[rows])
        return ((x - b.x[rows]) ** 2).sum(axis=1) + const[rows] * np.maximum(lead + confidence, 0), x, lead

    for _ in range(binary_search_steps):
        w, rows = inner(b.x), np.arange(n)
        value, x, lead = loss(w, rows)
        hit = np.zeros(n, bool)
        for _ in range(max_iter):
            b.check()
            _, other = _margin(net.logits(x), b.y)
            pull = nets.one_hot(b.y, net.classes) - nets.one_hot(other, net.classes)
            g = 2 * (x - b.x) + const[:, None] * (lead + confidence > 0)[:, None] * net.pull(x, pull)
            g = g * b.free * span * (1 - np.tanh(w) ** 2)
            rate = np.full(n, learning_rate)
            ahead, *_ = loss(w - rate[:, None] * g, rows)
            for _ in range(max_halving):
                rate = np.where(ahead >= value, rate / 2, rate)
                ahead, *_ = loss(w - rate[:, None] * g, rows)
            for _ in range(max_doubling):
                further, *_ = loss(w - 2 * rate[:, None] * g, rows)
                rate = np.where(further < ahead, 2 * rate, rate)
                ahead = np.minimum(ahead, further)
            w = w - np.where(ahead < value, rate, 0)[:, None] * g
            value, x, lead = loss(w, rows)
            far = ((x - b.x) ** 2).sum(axis=1)
            won = lead + confidence < 0
            hit |= won
            closer = won & (far < best_far)
            best[closer], best_far[closer] = x[closer], far[closer]
        over = np.where(hit, np.minimum(over, const), over)
        under = np.where(hit, under, np.maximum(under, const))
        const = np.where(np.isfinite(over), (under + over) / 2, const * 10)
    return best


def jsma(net: nets.Net, b: Batch, theta: float, gamma: float, max_iter: int, **_) -> np.ndarray:
    """The two columns that speak most for the likeliest other class move by theta, again and again, until it is the row's class or more than a share gamma of all columns has moved. A column moves in one direction only."""
    now = b.x.copy()
    n, width = now.shape
    target = _margin(net.logits(now), b.y)[1]
    way = np.zeros((n, width))  # in which direction a column has moved
    rows = np.flatnonzero(classes(net.shares(now)) == b.y)
    for _ in range(max_iter):
        if not len(rows):
            break
        b.check()
        x = now[rows]
        p = net.shares(x)
        own = np.take_along_axis(p, target[rows][:, None], 1)
        g = net.pull(x, own * (nets.one_hot(target[rows], net.classes) - p)) * b.free
        room = np.where(g > 0, x < b.high, x > b.low) & b.free & (g != 0) & (way[rows] * g >= 0)
        salient = np.where(room, np.abs(g), -1.0)
        pair = np.argsort(-salient, axis=1, kind="stable")[:, :2]
        moves = np.zeros_like(x)
        np.put_along_axis(moves, pair, np.where(np.take_along_axis(salient, pair, 1) > 0, np.sign(np.take_along_axis(g, pair, 1)) * theta, 0.0), 1)
        moved = np.where(moves != 0, np.sign(moves), way[rows])
        fits = ((moved != 0).sum(axis=1) <= max(1, gamma * width)) & (moves != 0).any(axis=1)
        rows, moves, moved = rows[fits], moves[fits], moved[fits]
        way[rows] = moved
        now[rows] = b.boxed(now[rows] + moves)
        rows = rows[classes(net.shares(now[rows])) != target[rows]]
    return now


# --- by answers -----------------------------------------------------------------------------------------------------------
def _lead(model, x: np.ndarray, y: np.ndarray, targeted: bool) -> np.ndarray:
    lead, _ = _margin(np.log(np.maximum(model.shares(x), 1e-30)), y)
    return -lead if targeted else lead


def zoo(model, b: Batch, confidence: float, targeted: bool, learning_rate: float, max_iter: int, binary_search_steps: int, initial_const: float, abort_early: bool, nb_parallel: int, variable_h: float, **_) -> np.ndarray:
    """The same loss as cw by shares, its slopes taken from differences along a few random columns a step, each column with its own moments."""
    n, width = b.x.shape
    movable = np.flatnonzero(b.free)
    best, best_far = b.x.copy(), np.full(n, np.inf)
    if not len(movable):
        return best
    const, under, over = np.full(n, initial_const), np.zeros(n), np.full(n, np.inf)
    k = min(nb_parallel, len(movable))
    start = np.flatnonzero(~_hit(model, b.x, b.y, targeted))
    best_far[np.setdiff1d(np.arange(n), start)] = 0.0

    def loss(x, rows):
        lead = _lead(model, x, b.y[rows], targeted)
        far = ((x - b.x[rows]) ** 2).sum(axis=1)
        return far + const[rows] * np.maximum(lead + confidence, 0), lead, far

    for _ in range(binary_search_steps):
        rows, now = start, b.x.copy()
        mean, spread, steps = np.zeros((n, width)), np.zeros((n, width)), np.zeros((n, width))
        hit, before = np.zeros(n, bool), np.full(n, np.inf)
        for i in range(max_iter):
            b.check()
            if not len(rows):
                break
            at = movable[b.drawn(rows, lambda r: r.permutation(len(movable))[:k])]
            up, down = (np.repeat(now[rows], k, axis=0) for _ in range(2))
            each, column = np.arange(len(up)), at.ravel()
            up[each, column] += variable_h
            down[each, column] -= variable_h
            twice = np.repeat(rows, k)
            slope = ((loss(up, twice)[0] - loss(down, twice)[0]) / (2 * variable_h)).reshape(len(rows), k)
            r = rows[:, None]
            steps[r, at] += 1
            mean[r, at] = 0.9 * mean[r, at] + 0.1 * slope
            spread[r, at] = 0.999 * spread[r, at] + 0.001 * slope**2
            t = steps[r, at]
            move = learning_rate * (mean[r, at] / (1 - 0.9**t)) / (np.sqrt(spread[r, at] / (1 - 0.999**t)) + 1e-8)
            now[r, at] -= move
            now[rows] = b.boxed(now[rows])
            value, lead, far = loss(now[rows], rows)
            won = lead + confidence < 0
            hit[rows] |= won
            closer = won & (far < best_far[rows])
            best[rows[closer]], best_far[rows[closer]] = now[rows[closer]], far[closer]
            if abort_early and (i + 1) % max(1, max_iter // 10) == 0:  # no longer gets better
                on = value < 0.9999 * before[rows]
                before[rows] = np.minimum(before[rows], value)
                rows = rows[on]
        over = np.where(hit, np.minimum(over, const), over)
        under = np.where(hit, under, np.maximum(under, const))
        const = np.where(np.isfinite(over), (under + over) / 2, const * 10)
    return best


def hsja(model, b: Batch, targeted: bool, max_iter: int, max_eval: int, init_eval: int, init_size: int, **_) -> np.ndarray:
    """From a random row of another class to the boundary by halving, then along it: the boundary's direction is estimated from random
    answers around it, a step is taken there, shortened until it hits, and halved back towards the row. Only classes are asked for.

    Rows for which no start of another class is found, and targeted ones, whose start can't be random, stay as they are.
    """
    n, width = b.x.shape
    out = b.x.copy()
    if targeted or not b.free.any():
        return out
    moving = int(b.free.sum())
    theta = 1 / (moving * np.sqrt(moving))
    rows = np.flatnonzero(~_hit(model, b.x, b.y, False))
    start = b.x.copy()
    found = np.zeros(n, bool)
    for _ in range(init_size):
        b.check()
        left = rows[~found[rows]]
        if not len(left):
            break
        tried = np.where(b.free, b.drawn(left, lambda r: r.uniform(b.low, b.high, width)), b.x[left])
        good = _hit(model, tried, b.y[left], False)
        start[left[good]], found[left[good]] = tried[good], True
    rows = rows[found[rows]]

    def to_boundary(rows, x):
        low, high = np.zeros(len(rows)), np.ones(len(rows))
        while len(rows) and (high - low > theta).any():
            b.check()
            middle = (low + high) / 2
            good = _hit(model, b.x[rows] + middle[:, None] * (x - b.x[rows]), b.y[rows], False)
            high, low = np.where(good, middle, high), np.where(good, low, middle)
        return b.x[rows] + high[:, None] * (x - b.x[rows])

    now = start
    now[rows] = to_boundary(rows, now[rows])
    out[rows] = now[rows]
    best = np.linalg.norm(out - b.x, axis=1)
    for t in range(1, max_iter + 1):
        if not len(rows):
            break
        b.check()
        far = np.linalg.norm(now[rows] - b.x[rows], axis=1)
        reach = np.full(len(rows), 0.1 * (b.high - b.low)) if t == 1 else np.sqrt(moving) * theta * far
        reach = np.maximum(reach, 1e-9)
        m = int(min(init_eval * np.sqrt(t), max_eval))
        noise = b.drawn(rows, lambda r: r.standard_normal((m, width))) * b.free
        noise /= np.linalg.norm(noise, axis=2, keepdims=True)
        around = b.boxed(now[rows][:, None, :] + reach[:, None, None] * noise)
        noise = (around - now[rows][:, None, :]) / reach[:, None, None]
        answer = np.where(_hit(model, around.reshape(-1, width), np.repeat(b.y[rows], m), False).reshape(len(rows), m), 1.0, -1.0)
        mean = answer.mean(axis=1, keepdims=True)
        answer = np.where(np.abs(mean) == 1, answer, answer - mean)
        along = (answer[:, :, None] * noise).mean(axis=1)
        size = np.linalg.norm(along, axis=1, keepdims=True)
        along = along / np.where(size > 0, size, 1)
        step, ahead, still = far / np.sqrt(t), now[rows].copy(), np.ones(len(rows), bool)
        for _ in range(30):
            tried = b.boxed(now[rows] + step[:, None] * along)
            good = still & _hit(model, tried, b.y[rows], False)
            ahead[good] = tried[good]
            still &= ~good
            if not still.any():
                break
            step = np.where(still, step / 2, step)
        now[rows] = to_boundary(rows, ahead)
        far = np.linalg.norm(now[rows] - b.x[rows], axis=1)
        closer = far < best[rows]
        out[rows[closer]], best[rows[closer]] = now[rows[closer]], far[closer]
    return out


_ATTACKS = {"fgsm": fgsm, "pgd": pgd, "deepfool": deepfool, "cw": cw, "jsma": jsma, "zoo": zoo, "hsja": hsja}
_OUT = "row_id long, x array<double>, y int, before int, after int, l2 double, linf double, failed boolean"


def _attempt(run: Callable, b: Batch, seconds: float | None, retries: int) -> np.ndarray | None:
    """The batch's moved rows; None if every try took longer than it may or ended in an error of arithmetic."""
    for _ in range(max(1, retries)):
        b.until = time.monotonic() + seconds if seconds else float("inf")
        b._sources = None  # every try draws the same numbers
        try:
            return run(b)
        except (TimeoutError, ArithmeticError, np.linalg.LinAlgError):
            continue
    return None


def attacked(df: DataFrame, model, name: str, given: dict | None = None, immutable: tuple[int, ...] = (), low: float = 0.0, high: float = 1.0, seed: int = 42, seconds: float | None = None, retries: int = 3, placeholder: str = "original") -> DataFrame:
    """(row_id, x, y, before, after, l2, linf, failed) from (row_id, features, label): each row as the attack leaves it, the model's class
    for it before and after, and how far it has moved.

    model has shares(), and for attacks by derivatives logits(), pull() and jacobian() too; it is broadcast. immutable: places in features. A batch that
    takes longer than so many seconds at every try is given up: its rows stay as they are ("original") or go ("drop").
    Rows without features or label are left out.
    """
    how = parameters(name, given)
    if name in GRADIENT and not hasattr(model, "pull"):
        raise ValueError(f"{name} needs the derivatives of a model")
    if placeholder not in ("original", "drop"):
        raise ValueError(f"unknown placeholder: {placeholder}")
    sent = df.sparkSession.sparkContext.broadcast(model)
    size = how["batch_size"]

    @tidy
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                keys, y = part.column(0).to_numpy(), part.column(2).to_numpy().astype(np.int64)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                free = np.ones(x.shape[1], bool)
                free[list(immutable)] = False
                moved = _attempt(lambda b: _ATTACKS[name](sent.value, b, **how), Batch(x, y, free, low, high, keys, seed), seconds, retries)
                failed = moved is None
                if failed and placeholder == "drop":
                    continue
                moved = x if failed else np.where(free, moved, x)
                before, after = (classes(sent.value.shares(v)) for v in (x, moved))
                d = moved - x
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * x.shape[1]), pa.array(moved.ravel()))
                columns = [part.column(0), lists, *(pa.array(v.astype(np.int32)) for v in (y, before, after)), pa.array(np.linalg.norm(d, axis=1)), pa.array(np.abs(d).max(axis=1, initial=0.0)), pa.array(np.full(len(y), failed))]
                yield pa.record_batch(columns, names=["row_id", "x", "y", "before", "after", "l2", "linf", "failed"])

    features = F.col("features") if dict(df.dtypes)["features"].startswith("array") else vector_to_array("features")
    rows = df.select(F.col("row_id").cast("long"), features.cast("array<double>").alias("x"), F.col("label").cast("int").alias("y"))
    return rows.where("row_id is not null and x is not null and y is not null").mapInArrow(run, _OUT)


def report(moved: DataFrame, *by: str) -> DataFrame:
    """Of what attacked() gives: rows, accuracy before and after, the share of right rows that are wrong now, and how far those have moved in the mean."""
    right, wrong = F.col("before") == F.col("y"), F.col("after") != F.col("y")
    won = F.when(right & wrong, F.lit(1.0)).otherwise(0.0)
    return moved.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg(right.cast("double")).alias("accuracy"),
        F.avg((~wrong).cast("double")).alias("accuracy_after"),
        (F.sum(won) / F.sum(right.cast("double"))).alias("evaded"),
        F.avg(F.when(right & wrong, F.col("l2"))).alias("mean_l2"),
        F.avg(F.when(right & wrong, F.col("linf"))).alias("mean_linf"),
        F.sum(F.col("failed").cast("long")).alias("failed"),
    )
