"""More rows for rare classes: generate, judge, drop what is known, accept, until there are enough."""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions import scalars, trees
from sluice.operators import clean, metrics, models


def postfilter(scored: DataFrame, need: int, threshold: float | None, score: str = "score", tie: str = "row_id") -> DataFrame:
    """Rows that reach the threshold; if none does, or without one, the need best."""
    if threshold is not None:
        good = scored.where(F.col(score) >= threshold)
        if not good.isEmpty():
            return good
    return clean.top_by(scored, F.desc(score), tie, need)


def request_size(need: int, rate: float, factor: int = 4, most: int = 60_000) -> int:
    """How many rows to ask a generator for, given the part that was accepted last."""
    return int(min(max(need * factor, need / max(rate, 1e-3) * factor), most))


def topk_per_batch(scored: DataFrame, batch: str, rate: float, score: str = "score", tie: str = "row_id") -> DataFrame:
    """Of each generated batch of n rows the max(1, floor(rate n)) best."""
    sizes = scored.groupBy(batch).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(float(rate)))).alias("_k"))
    joined = scored.join(sizes, batch)
    return clean.top_per_group(joined, [batch], F.desc(score), tie, F.col("_k")).drop("_k")


def critic_set(minority: DataFrame, opposite: DataFrame, label: str, own: int) -> DataFrame:
    """Both classes, target 1 for rows that aren't of the class in question."""
    return clean.union_by_name(minority, opposite).withColumn("target", (F.col(label) != own).cast("int"))


def fit_postfilter(positives: DataFrame, negatives: DataFrame, columns: list[str], seed: int = 7, rounds: int = 500, depth: int = 6, min_precision: float | None = None):
    """A function that adds score to a table, and a threshold or None: boosted trees, the rarer class weighted up."""
    data = positives.select(*columns, F.lit(1).alias("target")).unionByName(negatives.select(*columns, F.lit(0).alias("target")))
    weight = metrics_weight(data)
    held = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(5)) == 0
    ready = models.assembled(data.where(~held).select(*columns, F.col("target").alias("label"), F.when(F.col("target") == 1, F.lit(weight)).otherwise(1.0).alias("weight")), columns)
    model = models.boosted(ready, 2, trees.Boosting(rounds, rounds, depth, 0.05, rows=0.8, columns=0.8, weight=1.0, penalty=1.0), seed)

    def score(df: DataFrame) -> DataFrame:
        out = model.with_shares(VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep").transform(df), "_features", "_p")
        return out.withColumn("score", F.col("_p")[1]).drop("_features", "_p")

    threshold = None
    if min_precision is not None:
        threshold = metrics.calibrate_threshold(score(data.where(held)), min_precision).first()["threshold"]
    return score, threshold


def metrics_weight(data: DataFrame) -> float:
    from sluice.operators.profile import class_weight

    return float(class_weight(data, "target").first()["weight"])


@dataclasses.dataclass
class GaussianGenerator:
    """Rows around a class's: means and a Cholesky factor, sampled in partitions by a counter-based seed."""

    columns: list[str]
    mean: list[float]
    factor: list[list[float]]
    seed: int = 42

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], seed: int = 42) -> GaussianGenerator:
        n = len(columns)
        row = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns))).first()
        mean = [row[f"m{i}"] or 0.0 for i in range(n)]

        def moments(batches):
            count, total = 0, np.zeros((n, n))
            for pdf in batches:
                x = pdf.to_numpy(np.float64) - np.array(mean)
                x = x[~np.isnan(x).any(axis=1)]
                count, total = count + len(x), total + x.T @ x
            yield pd.DataFrame({"count": [count], "total": [total.ravel()]})

        # a partial sum of each partition; they are added up by place, so that n * n numbers come to the driver
        parts = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).mapInPandas(moments, "count long, total array<double>")
        sums = parts.select("count", F.posexplode("total").alias("pos", "value")).groupBy("pos").agg(F.sum("value").alias("value"), F.sum("count").alias("count")).collect()
        cov = np.zeros(n * n)
        for r in sums:
            cov[r.pos] = r.value / max(1, r["count"])
        cov = cov.reshape(n, n)
        values, vectors = np.linalg.eigh(cov)
        return cls(columns, mean, (vectors * np.sqrt(np.clip(values, 0, None))).tolist(), seed)

    def sample(self, spark: SparkSession, n: int, start: int = 0) -> DataFrame:
        """(row_id, columns...): the same rows for the same ids, however they are partitioned."""
        columns, mean, factor, seed = self.columns, np.array(self.mean), np.array(self.factor), self.seed

        def run(batches):
            for pdf in batches:
                z = np.stack([np.random.Generator(np.random.Philox(key=[seed, int(i)])).standard_normal(len(columns)) for i in pdf["id"]]) if len(pdf) else np.empty((0, len(columns)))
                x = mean + z @ factor.T
                yield pd.DataFrame({"row_id": pdf["id"].to_numpy()} | {c: x[:, k] for k, c in enumerate(columns)})

        schema = "row_id long, " + ", ".join(f"`{c}` double" for c in columns)
        return spark.range(start, start + n).mapInPandas(run, schema)


@dataclasses.dataclass
class FlowGenerator(GaussianGenerator):
    """Rows by integrating a velocity from noise: Euler steps along the flow that carries a normal distribution to the class's.

    The velocity is the closed form for a Gaussian target on the straight path between both.
    """

    steps: int = 200

    def sample(self, spark: SparkSession, n: int, start: int = 0) -> DataFrame:
        columns, mean, factor, seed, steps = self.columns, np.array(self.mean), np.array(self.factor), self.seed, self.steps
        cov = factor @ factor.T

        def run(batches):
            for pdf in batches:
                x = np.stack([np.random.Generator(np.random.Philox(key=[seed, int(i)])).standard_normal(len(columns)) for i in pdf["id"]]) if len(pdf) else np.empty((0, len(columns)))
                eye = np.eye(len(columns))
                for k in range(steps):
                    t = k / steps
                    spread = (1 - t) ** 2 * eye + t**2 * cov
                    gain = (t * cov - (1 - t) * eye) @ np.linalg.pinv(spread)
                    x = x + (mean + (x - t * mean) @ gain.T) / steps
                yield pd.DataFrame({"row_id": pdf["id"].to_numpy()} | {c: x[:, j] for j, c in enumerate(columns)})

        return spark.range(start, start + n).mapInPandas(run, "row_id long, " + ", ".join(f"`{c}` double" for c in columns))


def noise(*keys: Column | str) -> Column:
    """A normal number that is a function of the keys, by two uniform ones from md5, as any engine has it."""

    def uniform(tag: str) -> Column:
        digest = F.md5(F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(k) for k in keys), F.lit(tag)).cast("binary"))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(16**13))

    return F.sqrt(-2 * F.log(uniform("a"))) * F.cos(2 * math.pi * uniform("b"))


@dataclasses.dataclass
class LearntFlow:
    """Rows by a velocity that is learnt for every time and class: Euler steps from noise along the regression of x1 - x0 on (1 - t) x0 + t x1.

    Each row of a class is x1 with several x0 of noise. A regression's normal equations are sums of products, and those of
    all times are mixtures of one class's sums for (1, x0, x1): one grouped aggregate fits all of them.
    """

    columns: list[str]
    classes: list[object]
    prior: list[float]
    times: list[float]
    coefficients: list[list[list[list[float]]]]  # class, time, (1, x) by velocity
    seed: int = 42

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], seed: int = 42, label: str | None = None, copies: int = 10, times: int = 50) -> LearntFlow:
        """Of the rows that have all columns; label: a column with classes, without it all rows are one."""
        d = len(columns)
        x1 = [F.col(c).cast("double") for c in columns]
        complete = scalars.all_of(x.isNotNull() & ~F.isnan(x) for x in x1)
        rows = df.where(complete).select((F.col(label) if label else F.lit(0)).alias("c"), F.array(*x1).alias("x1"))
        each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        start = F.array(*(noise(F.concat_ws(",", F.transform("x1", lambda v: F.coalesce(F.round(v * 1_000_000).try_cast("long").cast("string"), v.cast("string")))), F.col("copy"), str(j), str(seed)) for j in range(d)))
        wide = each.select("c", F.concat(F.array(F.lit(1.0)), start, F.col("x1")).alias("w"))
        kinds = [r.c for r in rows.select("c").distinct().orderBy("c").collect()]  # as many as classes
        place = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("c")) - 1 if kinds else F.lit(0)

        def products(batches):
            sums: dict[int, np.ndarray] = {}
            for pdf in batches:
                w, own = np.array(pdf["w"].tolist(), np.float64).reshape(len(pdf), 2 * d + 1), pdf["k"].to_numpy()
                for k in np.unique(own):
                    part = w[own == k]
                    sums[int(k)] = sums.get(int(k), 0) + part.T @ part
            if sums:
                yield pd.DataFrame({"k": list(sums), "total": [v.ravel() for v in sums.values()]})

        parts = wide.select(place.cast("int").alias("k"), "w").mapInPandas(products, "k int, total array<double>")
        found = parts.select("k", F.posexplode("total").alias("pos", "value")).groupBy("k", "pos").agg(F.sum("value").alias("value")).collect()  # a matrix for each class
        sums = np.zeros((len(kinds), (2 * d + 1) ** 2))
        for r in found:
            sums[r.k, r.pos] = r.value
        grid = np.linspace(1e-3, 1.0, times)
        return cls(columns, kinds, [float(m[0]) / max(1.0, sums[:, 0].sum()) for m in sums], grid.tolist(), [[cls._solved(m.reshape(2 * d + 1, -1), t).tolist() for t in grid] for m in sums], seed)

    @staticmethod
    def _solved(m: np.ndarray, t: float) -> np.ndarray:
        """(1 + columns, columns): of the regression at time t, from the sums of products of (1, x0, x1)."""
        d = (len(m) - 1) // 2
        eye, none = np.eye(d), np.zeros((d, 1))
        at = np.block([[np.ones((1, 1)), np.zeros((1, 2 * d))], [none, (1 - t) * eye, t * eye]])
        velocity = np.block([none, -eye, eye])
        return np.linalg.pinv(at @ m @ at.T / m[0, 0], rcond=1e-12, hermitian=True) @ (at @ m @ velocity.T / m[0, 0])

    def velocities(self) -> list[tuple]:
        """(class, time's number, column, coefficients from the constant on)."""
        return [(c, i, k, [row[j] for row in m]) for c, own in zip(self.classes, self.coefficients, strict=True) for i, m in enumerate(own) for j, k in enumerate(self.columns)]

    def sample(self, spark: SparkSession, n: int, start: int = 0, label: str | None = None) -> DataFrame:
        """(row_id, columns..., and label with the row's class by their shares): the same rows for the same ids, however they are partitioned."""
        columns, seed, d = self.columns, self.seed, len(self.columns)
        if not self.classes:
            raise ValueError("no rows to learn from")
        sent = spark.sparkContext.broadcast(np.array(self.coefficients))
        bounds, steps = np.cumsum(self.prior), len(self.times)

        def run(batches):
            for pdf in batches:
                rngs = [np.random.Generator(np.random.Philox(key=[seed, int(i)])) for i in pdf["id"]]
                x = np.stack([r.standard_normal(d) for r in rngs]) if rngs else np.empty((0, d))
                kind = np.minimum(np.searchsorted(bounds, [r.random() for r in rngs], side="right"), len(bounds) - 1)
                for i in range(steps - 1):
                    b = sent.value[kind, i]
                    x = x + (b[:, 0] + np.einsum("nj,njk->nk", x, b[:, 1:])) / (steps - 1)
                yield pd.DataFrame({"row_id": pdf["id"].to_numpy()} | {c: x[:, k] for k, c in enumerate(columns)} | {"_kind": kind.astype(np.int32)})

        schema = "row_id long, " + ", ".join(f"`{c}` double" for c in columns) + ", _kind int"
        out = spark.range(start, start + n).mapInPandas(run, schema)
        return out.withColumn(label, F.get(F.array(*(F.lit(c) for c in self.classes)), F.col("_kind"))).drop("_kind") if label else out.drop("_kind")


def augment_to(train: DataFrame, generator, columns: list[str], tau: int, known: list[DataFrame] = (), score: Callable[[DataFrame], DataFrame] | None = None, threshold: float | None = None, rounds: int = 40, places: int = 6) -> DataFrame:
    """train (its columns) with generated rows up to tau rows in all, and generated (boolean).

    In each round rows are generated, judged, and dropped if a known table, train or a round before has their key. What
    is accepted is written, so that rounds don't pile up plans. Accepted rows beyond the need go, the worst first. What
    rounds leave missing is filled by a larger request whose best rows are taken.
    """
    spark = train.sparkSession
    need = tau - train.count()
    out = train.select(*columns).withColumn("generated", F.lit(False))
    if need <= 0:
        return out
    judged = score or (lambda df: df.withColumn("score", F.lit(1.0)))
    base = [t.select(*columns) for t in (train, *known)]
    accepted: list[DataFrame] = []
    have, asked, rate = 0, 0, 0.25
    for _ in range(rounds):
        n = request_size(need - have, rate)
        rows = postfilter(judged(generator.sample(spark, n, asked)), need - have, threshold)
        fresh = staging.stage(clean.anti_join_keys(rows, base + [a.select(*columns) for a in accepted], columns, places).select("row_id", *columns, "score"), "augment")
        asked += n
        got = fresh.count()
        rate = max(got / n, 1e-3)
        if got:
            accepted.append(fresh)
        have += got
        if have >= need:
            break
    if have < need:
        n = request_size(need - have, rate, 6, 80_000)
        best = clean.top_by(judged(generator.sample(spark, n, asked)), F.desc("score"), "row_id", need - have)
        accepted.append(clean.anti_join_keys(best, base + [a.select(*columns) for a in accepted], columns, places).select("row_id", *columns, "score"))
    rows = accepted[0]
    for a in accepted[1:]:
        rows = rows.unionByName(a)
    return out.unionByName(clean.top_by(rows, F.desc("score"), "row_id", need).select(*columns).withColumn("generated", F.lit(True)))


# --- perturbation -----------------------------------------------------------------------------------------------
def masked(original: DataFrame, perturbed: DataFrame, row_id: str, columns: list[str], immutable: list[str], placeholder: str = "original") -> DataFrame:
    """Perturbed rows with immutable columns as they were. Rows that weren't perturbed stay as they were, or are dropped."""
    other = perturbed.select(F.col(row_id), *(F.col(c).alias(f"_p_{c}") for c in columns if c not in immutable))
    both = original.join(other, row_id, "left" if placeholder == "original" else "inner")
    return both.select(row_id, *(F.col(c) if c in immutable else F.coalesce(f"_p_{c}", c).alias(c) for c in columns), *(c for c in original.columns if c != row_id and c not in columns))


def signed_step(df: DataFrame, columns: list[str], gradient: dict[str, float], eps: float, immutable: list[str] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """One step of eps against a linear model: each mutable column moves by the sign of its weight, within low and high."""
    moved = {}
    for c in columns:
        if c not in immutable and gradient.get(c):
            x = F.col(c) + F.lit(eps if gradient[c] > 0 else -eps)
            moved[c] = scalars.clip(x, low, high) if low is not None and high is not None else x
    return df.withColumns(moved)


def parameters_json(parameters: dict) -> str:
    return json.dumps(parameters, sort_keys=True)
