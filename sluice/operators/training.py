"""A network fitted in rounds over all partitions at once: every task steps through its rows from the same weights, and what tasks come to is averaged."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions import network
from sluice.functions.arrow import tidy
from sluice.operators import split

#: Numbers of a slice in which tasks' weights are added up; distinct values of a category at most.
SLICE, VALUES = 1 << 17, 65_536


@dataclasses.dataclass(frozen=True)
class Schedule:
    """Rounds at most, rows of a step, rate, decay, rounds without gain until the rate is halved and until the end, largest embedding, part of the rows for validation."""

    rounds: int = 40
    batch: int = 512
    rate: float = 1e-3
    decay: float = 1e-4
    plateau: int = 2
    patience: int = 8
    embedding: int = 50
    validation: float = 0.1


_SUMS = "part int, data binary"


def _round(sent, how: Schedule, number: int, seed: int, watched: bool, last: bool):
    """(features, label, held) to slices of rows * (weights, both moments), and slice -1: rows, steps, sums of losses and rows of validation.

    If some rows are held (watched), only their losses count: those of the others aren't measured, and the last round makes no steps.
    """

    @tidy
    def run(batches):
        net, first, second, steps, rate = sent.value
        flat = net.flat()
        adam = network.Adam(rate, how.decay, first.copy(), second.copy(), steps)
        rng = np.random.Generator(np.random.Philox(key=[seed, (number << 32) + TaskContext.get().partitionId()]))
        rows, loss, held_rows, held_loss = 0, 0.0, 0, 0.0
        left = (np.empty((0, net.width)), np.empty(0, np.int64))
        now = net

        def steps_of(x, y, whole):
            nonlocal flat, now, rows, loss
            at = 0
            while len(y) - at >= how.batch or (whole and at < len(y)):
                a, b = x[at : at + how.batch], y[at : at + how.batch]
                loss += 0.0 if watched else network.loss_sum(now, a, b)
                flat = adam.step(flat, network.gradient(now, a, b, rng))
                now = net.with_flat(flat)
                rows, at = rows + len(b), at + len(b)
            return x[at:], y[at:]

        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, held = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if held.any():
                held_rows, held_loss = held_rows + int(held.sum()), held_loss + network.loss_sum(net, x[held], y[held])
            if watched and last:
                continue
            order = rng.permutation(np.flatnonzero(~held))
            left = steps_of(np.concatenate([left[0], x[order]]), np.concatenate([left[1], y[order]]), False)
        steps_of(*left, True)
        if rows or held_rows:
            every = np.concatenate([flat, adam.first, adam.second]) * rows
            out = [(i, every[i * SLICE : (i + 1) * SLICE]) for i in range(-(-len(every) // SLICE))] if rows else []
            out.append((-1, np.array([rows, (adam.steps - steps) * rows, loss, held_rows, held_loss])))
            yield pa.record_batch([pa.array([i for i, _ in out], pa.int32()), pa.array([v.astype("<f8").tobytes() for _, v in out], pa.binary())], names=["part", "data"])

    return run


@tidy
def _added(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = np.frombuffer(data, "<f8")
            sums[i] = v if i not in sums else sums[i] + v
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "data"])


def _values(rows: DataFrame, place: int) -> np.ndarray:
    found = rows.select(F.rint(F.get("x", F.lit(place))).alias("v")).where("v is not null").distinct().orderBy("v").limit(VALUES).collect()
    return np.array([r.v for r in found])


def fit(df: DataFrame, classes: int, inputs: dict | None = None, how: Schedule | None = None, seed: int = 42) -> network.Network:
    """From (features, label); inputs: {"categorical": {place: number of values}, "binary": [places]}, all others are numbers.

    Rows are dealt by a hash to as many tasks as have a few batches each. A round is one job: steps over all rows, each
    task from the weights and moments of the round before, then the mean by rows. A part of each label is held for
    validation; the rate is halved when its loss stays, and the weights with the least loss are given.
    """
    how = how or Schedule()
    features = F.col("features") if dict(df.dtypes)["features"].startswith("array") else vector_to_array("features")
    rows = df.select(features.cast("array<double>").alias("x"), F.col("label").cast("int").alias("label")).where("x is not null and label is not null")
    with staging.scope():
        keyed = rows.withColumn("_key", F.xxhash64("x", "label"))
        marked = staging.stage(split.stratified_validation(keyed, "label", ["_key"], how.validation, seed), "marked")
        n = marked.count()
        if not n:
            raise ValueError("no rows to learn from")
        width = marked.select(F.size("x").alias("n")).first().n
        parts = max(1, min(staging.partitions(df.sparkSession), n // (4 * how.batch)))
        held = (F.col("subset") == "validation") if n > 1 else F.lit(False)
        dealt = marked.select("x", "label", held.alias("held"), "_key").repartition(parts, "_key").sortWithinPartitions("_key").drop("_key")
        data = staging.stage(dealt, "training")
        layout = network.Inputs.of(width, **(inputs or {}))
        number = lambda i: F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i)))
        moments = data.where("not held").agg(*(f(number(i)) for i in layout.continuous for f in (F.avg, F.stddev_pop))).first() if layout.continuous else []
        mean, std = (np.array([v or 0.0 for v in moments[k::2]], float) for k in (0, 1))
        net = network.Network.start(layout, {p: _values(data, p) for p in layout.categorical}, mean, std, classes, how.embedding, seed=seed)
        return _rounds(data, net, how, seed, n > 1 and how.validation > 0)


def _rounds(data: DataFrame, net: network.Network, how: Schedule, seed: int, watched: bool) -> network.Network:
    """A round is one job, whatever the shuffle's partitions: sums go to as many as there are slices, and come back together."""
    spark, flat = data.sparkSession, net.flat()
    parts = min(staging.partitions(spark), 1 + -(-3 * len(flat) // SLICE))
    first, second, steps, rate = np.zeros_like(flat), np.zeros_like(flat), 0, how.rate
    best, best_flat, waited, still = np.inf, flat, 0, 0
    for number in range(how.rounds + 1):  # the last one only measures what the others have come to
        sent = spark.sparkContext.broadcast((net.with_flat(flat), first, second, steps, rate))
        part = data.mapInArrow(_round(sent, how, number, seed, watched, number == how.rounds), _SUMS).repartition(parts, "part").mapInArrow(_added, _SUMS)
        sums = {r.part: np.frombuffer(bytes(r.data), "<f8") for r in part.collect()}  # the weights and moments once
        sent.destroy()
        rows, taken, loss, held_rows, held_loss = sums.pop(-1)
        now = held_loss / held_rows if held_rows else (loss / rows if rows else 0.0)
        if now < best - 1e-6:
            best, best_flat, waited, still = now, flat, 0, 0
        else:
            waited, still = waited + 1, still + 1
            if still > how.plateau:
                rate, still = rate / 2, 0
        if waited >= how.patience or not rows:
            break
        every = np.concatenate([sums[i] for i in sorted(sums)]) / rows
        flat, first, second = np.split(every, 3)
        steps += max(1, round(taken / rows))
    return net.with_flat(best_flat)
