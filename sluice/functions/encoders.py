"""Fitted column transforms. A fit is one aggregate; what it learns is small and becomes literals of expressions.

Each has fit(df, columns), transform(df), inverse(df) and state(), a JSON-ready dict from which load() makes it anew.
"""

from __future__ import annotations

import dataclasses
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import ranking, scalars


@dataclasses.dataclass
class Linear:
    """x to (x - shift) / scale; a scale of 0 counts as 1."""

    shift: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def minmax(cls, df: DataFrame, columns: list[str]) -> Linear:
        row = df.agg(*(x for i, c in enumerate(columns) for x in (F.min(F.col(f"`{c}`").cast("double")).alias(f"a{i}"), F.max(F.col(f"`{c}`").cast("double")).alias(f"b{i}")))).first()
        return cls({c: row[f"a{i}"] for i, c in enumerate(columns)}, {c: (row[f"b{i}"] - row[f"a{i}"]) or 1.0 for i, c in enumerate(columns)})

    @classmethod
    def standard(cls, df: DataFrame, columns: list[str]) -> Linear:
        row = df.agg(*(x for i, c in enumerate(columns) for x in (F.avg(F.col(f"`{c}`").cast("double")).alias(f"a{i}"), F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"b{i}")))).first()
        return cls({c: row[f"a{i}"] for i, c in enumerate(columns)}, {c: row[f"b{i}"] or 1.0 for i, c in enumerate(columns)})

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """keep: columns that aren't scaled after all."""
        return df.withColumns({c: (F.col(f"`{c}`") - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in self.shift if c not in keep and c in df.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(f"`{c}`") * F.lit(self.scale[c]) + F.lit(self.shift[c]) for c in self.shift if c in df.columns})

    def state(self) -> dict:
        return {"kind": "linear", "shift": self.shift, "scale": self.scale}


@dataclasses.dataclass
class Quantile:
    """x to its place among a column's quantiles, uniform in 0 to 1 or normal; the mean of the ascending and the descending interpolation."""

    grids: dict[str, list[float]]
    normal: bool = False
    #: Rows that quantiles are taken from at most, those of the smallest digests: a fit's cost doesn't grow with the table.
    SUBSAMPLE = 100_000
    EDGE = 1e-7

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], keys: list[str], quantiles: int = 1000, normal: bool = False, seed: int = 42) -> Quantile:
        some = df.orderBy(ranking.digest(*keys, seed=seed), *keys).limit(cls.SUBSAMPLE)
        places = [float(x) for x in np.linspace(0, 1, quantiles)]
        row = some.agg(*(F.expr(f"percentile(`{c}`, array({', '.join(f'{p!r}D' for p in places)}))").alias(f"q{i}") for i, c in enumerate(columns))).first()
        return cls({c: [float(x) for x in row[f"q{i}"]] for i, c in enumerate(columns)}, normal)

    def _apply(self, df: DataFrame, one) -> DataFrame:
        def on(c: str):
            grid = np.array(self.grids[c])

            @F.pandas_udf("double")
            def run(x: pd.Series) -> pd.Series:
                v = x.to_numpy(np.float64)
                return pd.Series(np.where(np.isnan(v), np.nan, one(v, grid)))

            return run(F.col(f"`{c}`").cast("double"))

        return df.withColumns({c: on(c) for c in self.grids if c in df.columns})

    def extended(self, df: DataFrame) -> DataFrame:
        """Uniform places with the last interval's line going on beyond the largest quantile; null below the smallest one. A subsample's
        quantiles may leave out a table's ends, where transform() gives 1 and 0."""

        def one(v, grid):
            if len(grid) < 2:
                return np.full(len(v), np.nan)
            i = np.clip(np.searchsorted(grid, v, side="right") - 1, 0, len(grid) - 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(v < grid[0], np.nan, (i + (v - grid[i]) / (grid[i + 1] - grid[i])) / (len(grid) - 1))

        out = self._apply(df, one)
        return out.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in self.grids if c in df.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        normal, edge = self.normal, self.EDGE

        def one(v, grid):
            places = np.linspace(0, 1, len(grid))
            u = 0.5 * (np.interp(v, grid, places) - np.interp(-v, -grid[::-1], -places[::-1]))
            u = np.where(v >= grid[-1], 1.0, np.where(v <= grid[0], 0.0, u))
            return _probit(np.clip(u, edge, 1 - edge)) if normal else u

        return self._apply(df, one)

    def inverse(self, df: DataFrame) -> DataFrame:
        normal = self.normal

        def one(v, grid):
            return np.interp(_phi(v) if normal else v, np.linspace(0, 1, len(grid)), grid)

        return self._apply(df, one)

    def state(self) -> dict:
        return {"kind": "quantile", "grids": self.grids, "normal": self.normal}


def _phi(x: np.ndarray) -> np.ndarray:
    from math import erf

    return 0.5 * (1 + np.vectorize(erf, otypes=[float])(np.asarray(x) / np.sqrt(2)))


def _probit(p: np.ndarray) -> np.ndarray:
    """The normal distribution's inverse: the standard library's."""
    from statistics import NormalDist

    return np.vectorize(NormalDist().inv_cdf, otypes=[float])(p)


def _distinct(df: DataFrame, columns: list[str], most: int) -> dict[str, list]:
    """Sorted distinct values of each column; an error beyond so many, since they become literals."""
    out = {}
    for c in columns:
        values = [r[0] for r in df.select(F.col(f"`{c}`")).where(F.col(f"`{c}`").isNotNull()).distinct().orderBy(F.col(f"`{c}`")).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} values")
        out[c] = values
    return out


@dataclasses.dataclass
class OneHot:
    """A column {feature}_{value} for each value, 1.0 or 0.0, before the other columns; unknown values give zeros alone."""

    values: dict[str, list]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], most: int = 1000) -> OneHot:
        return cls(_distinct(df, columns, most))

    def names(self, c: str) -> list[str]:
        return [f"{c}_{v}" for v in self.values[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        hot = [F.coalesce((F.col(f"`{c}`") == F.lit(v)).cast("double"), F.lit(0.0)).alias(n) for c in self.values for v, n in zip(self.values[c], self.names(c), strict=True)]
        return df.select(*hot, *(F.col(f"`{c}`") for c in df.columns if c not in self.values))

    def inverse(self, df: DataFrame) -> DataFrame:
        """The value of the first of the largest columns."""
        made = {n for c in self.values for n in self.names(c)}
        back = [F.get(F.array(*(F.lit(v) for v in self.values[c])), scalars.argmax(F.array(*(F.col(f"`{n}`") for n in self.names(c))))).alias(c) for c in self.values if self.values[c]]
        return df.select(*back, *(F.col(f"`{c}`") for c in df.columns if c not in made))

    def state(self) -> dict:
        return {"kind": "onehot", "values": self.values}


@dataclasses.dataclass
class Ordinal:
    """A value's number in sorted order; ports by arithmetic over their whole range; unknown gives -1 or, if strict, an error."""

    values: dict[str, list]
    ports: list[str] = dataclasses.field(default_factory=list)
    strict: bool = False

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], ports: list[str] | None = None, strict: bool = False, most: int = 10_000) -> Ordinal:
        return cls(_distinct(df, [c for c in columns if c not in (ports or [])], most), list(ports or []), strict)

    @property
    def cardinalities(self) -> dict[str, int]:
        return {c: len(v) for c, v in self.values.items()} | dict.fromkeys(self.ports, 65535)

    def transform(self, df: DataFrame) -> DataFrame:
        columns = {c: scalars.port(F.col(f"`{c}`")) - 1 for c in self.ports if c in df.columns}
        for c, values in self.values.items():
            if c in df.columns:
                found = (F.array_position(F.array(*(F.lit(v) for v in values)), F.col(f"`{c}`")) - 1).cast("int") if values else F.lit(-1)
                known = F.coalesce(found, F.lit(-1))
                columns[c] = F.when(known >= 0, known).otherwise(F.raise_error(F.lit(f"unknown value of {c}")).cast("int")) if self.strict else known
        return df.withColumns(columns)

    def inverse(self, df: DataFrame) -> DataFrame:
        columns = {c: F.col(f"`{c}`").cast("int") + 1 for c in self.ports if c in df.columns}
        return df.withColumns(columns | {c: F.get(F.array(*(F.lit(v) for v in values)), F.col(f"`{c}`").cast("int")) for c, values in self.values.items() if c in df.columns})

    def state(self) -> dict:
        return {"kind": "ordinal", "values": self.values, "ports": self.ports, "strict": self.strict}


def label_encoder(column: str, labels: list[str] | None = None, df: DataFrame | None = None) -> Ordinal:
    """Labels to numbers in sorted order, of a fixed list or of a table; an unknown label is an error."""
    return Ordinal({column: sorted(labels)} if labels is not None else _distinct(df, [column], 10_000), [], True)


def clamp_decoded(df: DataFrame, binary: list[str], numeric: list[str], ports: list[str] = ()) -> DataFrame:
    """After an inverse: flags by one half, tiny and negative numbers to 0, ports into their range."""
    columns = {c: scalars.as_flag(F.col(f"`{c}`")) for c in binary if c in df.columns}
    columns |= {c: scalars.clamp_decoded(F.col(f"`{c}`")) for c in numeric if c in df.columns and c not in ports}
    return df.withColumns(columns | {c: scalars.port(F.col(f"`{c}`"), fill=False) for c in ports if c in df.columns})


def load(state: dict):
    kind, rest = state["kind"], {k: v for k, v in state.items() if k != "kind"}
    return {"linear": Linear, "quantile": Quantile, "onehot": OneHot, "ordinal": Ordinal}[kind](**rest)


def save_all(spark, encoders: dict, path: str) -> None:
    """Named encoders as one line of JSON each."""
    rows = [(name, json.dumps(e.state())) for name, e in sorted(encoders.items())]
    spark.createDataFrame(rows, "name string, state string").coalesce(1).write.mode("overwrite").json(path)


def load_all(spark, path: str) -> dict:
    return {r["name"]: load(json.loads(r["state"])) for r in spark.read.schema("name string, state string").json(path).collect()}
