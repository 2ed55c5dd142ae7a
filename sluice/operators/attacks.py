"""Adversarial rows against a linear score, as column expressions.

The score is bias + the sum of weight * column; a row's class is whether it is above 0. Each attack moves a row towards
the other class. Immutable columns stay, and where low and high are given, moved ones are kept within them. On a linear
score the gradient is the same everywhere, so that what iterative attacks reach has a closed form.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import scalars


def _score(weights: dict[str, float], bias: float, values: dict[str, Column] | None = None) -> Column:
    values = values or {}
    return functools.reduce(lambda a, b: a + b, [F.lit(float(bias)), *(F.lit(float(w)) * values.get(c, F.col(c)).cast("double") for c, w in weights.items())])


def _away(score: Column) -> Column:
    """-1 where the score is to fall, 1 where it is to rise."""
    return F.when(score > 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def _mutable(weights: dict[str, float], immutable: tuple[str, ...]) -> dict[str, float]:
    return {c: w for c, w in weights.items() if w and c not in immutable}


def _within(x: Column, low: float | None, high: float | None) -> Column:
    return scalars.clip(x, low, high) if low is not None and high is not None else x


def pgd(df: DataFrame, weights: dict[str, float], bias: float, eps: float, step: float, steps: int, immutable: tuple[str, ...] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """Projected signed steps: each mutable column moves by step so many times, by eps at most. One step of eps is the fast gradient sign."""
    away, far = _away(_score(weights, bias)), min(float(eps), step * steps)
    return df.withColumns({c: _within(F.col(c) + away * F.lit(math.copysign(far, w)), low, high) for c, w in _mutable(weights, immutable).items()})


def _shortest(df: DataFrame, weights: dict[str, float], factor: Column, immutable, low, high) -> DataFrame:
    """Rows moved along the mutable weights, by factor in parts of their squared length."""
    free = _mutable(weights, immutable)
    square = sum(w * w for w in free.values())
    return df.withColumns({c: _within(F.col(c) + factor * F.lit(w / square), low, high) for c, w in free.items()}) if free else df


def deepfool(df: DataFrame, weights: dict[str, float], bias: float, overshoot: float = 0.02, immutable: tuple[str, ...] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """The shortest move to the boundary, and a bit beyond it."""
    return _shortest(df, weights, -_score(weights, bias) * F.lit(1.0 + overshoot), immutable, low, high)


def carlini(df: DataFrame, weights: dict[str, float], bias: float, confidence: float = 0.0, immutable: tuple[str, ...] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """The shortest move after which the other class has the score by a margin of confidence."""
    score = _score(weights, bias)
    return _shortest(df, weights, _away(score) * (F.abs(score) + F.lit(float(confidence))), immutable, low, high)


def jsma(df: DataFrame, weights: dict[str, float], bias: float, theta: float, gamma: float, immutable: tuple[str, ...] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """Columns move by theta one after another, the most salient (of the largest weight) first, ties by name, until the class changes or a share gamma of all columns has moved."""
    free = _mutable(weights, immutable)
    score, values = _score(weights, bias), {}
    away = _away(score)
    order = sorted(free, key=lambda c: (-abs(free[c]), c))[: math.floor(gamma * len(weights))]
    for c in order:
        still = _away(_score(weights, bias, values)) == away
        moved = _within(F.col(c) + away * F.lit(math.copysign(theta, free[c])), low, high)
        values = values | {c: F.when(still, moved).otherwise(F.col(c))}
    return df.withColumns(values) if values else df
