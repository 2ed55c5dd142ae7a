"""The network: derivatives by differences, steps as one would take them, accuracy beside Spark ML's perceptron, saved and loaded."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sluice.functions import network
from sluice.operators import adversarial, models, training


def _net(rng, hidden=(7, 5)):
    inputs = network.Inputs.of(6, {1: 5}, [3])
    return network.Network.start(inputs, {1: np.array([0.0, 2.0, 4.0])}, np.full(4, 0.3), np.array([1.0, 2.0, 0.5, 0.0]), 3, 4, hidden)


def _rows(rng, n):
    x = rng.normal(size=(n, 6))
    x[:, 1], x[:, 3] = rng.integers(0, 6, n), rng.integers(0, 2, n)
    return x


def test_derivatives_by_differences():
    rng = np.random.default_rng(1)
    net = _net(rng)
    for k in net.weights:
        net.weights[k] = net.weights[k] + rng.normal(size=net.weights[k].shape) * 0.1
    x, y, h = _rows(rng, 11), rng.integers(0, 3, 11), 1e-6
    flat, got = net.flat(), network.gradient(net, x, y, None)
    want = [(network.loss_sum(net.with_flat(flat + h * e), x, y) - network.loss_sum(net.with_flat(flat - h * e), x, y)) / (2 * h * 11) for e in np.eye(len(flat))]
    assert np.allclose(got, want, atol=1e-7)
    w = rng.normal(size=(11, 3))
    pull = net.pull(x, w)
    for j in (0, 2, 4, 5):
        e = np.zeros(6)
        e[j] = h
        assert np.allclose(pull[:, j], ((net.logits(x + e) - net.logits(x - e)) * w).sum(axis=1) / (2 * h), atol=1e-6)
    assert not pull[:, [1, 3]].any()
    assert np.allclose(net.jacobian(x, np.array([[2, 0]] * 11))[:, 0], net.pull(x, np.eye(3)[np.full(11, 2)]))


def test_unknown_categories_and_missing_numbers():
    rng = np.random.default_rng(2)
    net, x = _net(rng), _rows(rng, 4)
    odd = x.copy()
    odd[:, 1] = [9, -1, 3, np.nan]
    again = odd.copy()
    again[:, 1] = 7
    assert np.allclose(net.shares(odd), net.shares(again))
    x[:, 5] = np.nan
    assert np.isfinite(net.shares(x)).all()
    assert net._embedded(np.zeros((0, 6))) is not None and net.shares(np.zeros((0, 6))).shape == (0, 3)


def test_steps_of_adam():
    flat, g = np.array([1.0, -2.0]), np.array([0.3, 0.4])
    adam = network.Adam(0.1, 0.01, np.zeros(2), np.zeros(2))
    out = adam.step(flat, g)
    assert np.allclose(out, flat * (1 - 0.001) - 0.1 * np.sign(g), atol=1e-6)
    adam = network.Adam(0.1, 0.0, np.zeros(2), np.zeros(2))
    adam.step(flat, g * 1000)
    assert np.linalg.norm(adam.first / 0.1) == pytest.approx(1, abs=1e-6)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 2400
    kind, flag, a, b = rng.integers(0, 12, n), rng.integers(0, 2, n), rng.normal(size=n), rng.normal(size=n) * 50
    label = np.where(kind % 3 == 0, (a > 0).astype(int), np.where(flag == 1, 2, (b > 0).astype(int)))
    rows = spark.createDataFrame([(i, int(k), int(f), float(x), float(z), int(c)) for i, (k, f, x, z, c) in enumerate(zip(kind, flag, a, b, label, strict=True))], "id int, kind int, flag int, a double, b double, label int")
    return VectorAssembler(inputCols=["kind", "flag", "a", "b"], outputCol="features").transform(rows).select("id", "features", "label")


def test_accuracy_beside_the_perceptron(spark, data, tmp_path):
    train, test = data.where("id < 1800"), data.where("id >= 1800")
    inputs = {"categorical": {0: 12}, "binary": [1]}
    made = models.Classifier("dnn", 3, training.fit(train, 3, inputs, training.Schedule(rounds=14, rate=6e-3, batch=256)))
    mine, other = models.evaluate(made, test).first().accuracy, models.evaluate(models.Classifier("mlp", 3).fit(train), test).first().accuracy
    assert mine > 0.93 and mine > other
    made.save(str(tmp_path))
    again = models.Classifier.load(str(tmp_path), "dnn", 3)
    x = np.array([r.features.toArray() for r in test.limit(50).collect()])
    assert np.allclose(again.scorer().shares(x), made.scorer().shares(x))
    rows = test.select(F.col("id").alias("row_id"), "features", "label")
    moved = adversarial.attacked(rows, made.scorer(), "deepfool", immutable=(0, 1), low=-200.0, high=200.0)
    assert adversarial.report(moved).first().evaded > 0.5


def test_rounds_over_several_tasks(spark, data, monkeypatch):
    how = training.Schedule(rounds=5, batch=64, rate=3e-3)
    inputs = {"categorical": {0: 12}, "binary": [1]}
    one, two = (training.fit(t, 3, inputs, how) for t in (data, data.repartition(3)))
    assert np.allclose(one.flat(), two.flat())
    x = np.array([r.features.toArray() for r in data.limit(400).collect()])
    y = np.array([r.label for r in data.limit(400).collect()])
    assert (one.shares(x).argmax(axis=1) == y).mean() > 0.85
    with pytest.raises(ValueError, match="no rows"):
        training.fit(data.limit(0), 3)


def test_a_round_is_one_job_whatever_the_partitions(spark):
    rows = [([float(i % 7), float(i % 3)], i % 2) for i in range(200)]
    data = spark.createDataFrame(rows, "features array<double>, label int").coalesce(2)
    jobs = {}
    for rounds in (1, 5):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "rounds")
        try:
            training.fit(data, 2, how=training.Schedule(rounds=rounds, batch=64))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[rounds] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds {rounds}"))
    # with adaptive plans a job for the shuffle and one for its result
    assert 4 <= jobs[5] - jobs[1] <= 8
