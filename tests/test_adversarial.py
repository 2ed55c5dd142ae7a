"""Attacks on fitted models: derivatives by differences, closed forms, masks, boxes, deadlines, rows on their own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sluice.functions import nets
from sluice.operators import adversarial, clean, models
from sluice.plans import catalogue


def _net(rng, width=6, classes=4):
    return nets.Net(np.full(width, 0.5), np.full(width, 2.0), [(rng.normal(size=(width, 9)), rng.normal(size=9)), (rng.normal(size=(9, classes)) * 3, rng.normal(size=classes))])


def _frame(spark, x, y):
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label int").select("row_id", array_to_vector("x").alias("features"), "label")


def test_derivatives_by_differences():
    rng = np.random.default_rng(1)
    net, x, h = _net(rng), rng.random((5, 6)), 1e-6
    w = rng.normal(size=(5, 4))
    steps = [(net.logits(x + h * e) - net.logits(x - h * e)) / (2 * h) for e in np.eye(6)]
    assert np.allclose(net.pull(x, w), np.stack([(s * w).sum(axis=1) for s in steps], axis=1), atol=1e-6)
    which = np.array([[0, 2]] * 5)
    assert np.allclose(net.jacobian(x, which), np.stack([np.take_along_axis(s, which, 1) for s in steps], axis=2), atol=1e-6)


def test_nets_score_as_the_models_they_come_from(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1, 10, 0] + [0, 5, 2]
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 8)
    df = _frame(spark, x, y)
    made = models.Classifier("mlp", 3).fit(df)
    want = {r.row_id: r.p for r in made.predict(df).collect()}
    assert np.allclose(made.scorer().shares(x), [want[i] for i in range(200)], atol=1e-9)
    net = models.softmax(df, 1e-3)
    assert (net.shares(x).argmax(axis=1) == y).mean() > 0.7
    centre = models.nearest_centre(df.select("row_id", F.col("label"), F.array(*(F.lit(0.0) for _ in range(3))).alias("v")), "v", 5, 3)
    assert set(centre.shares(x).argmax(axis=1)) == {0} and np.all(centre.shares(x)[:, 3:] == 0)


@pytest.mark.parametrize("name", sorted(adversarial.PARAMETERS))
def test_masks_boxes_and_rows_on_their_own(name):
    rng = np.random.default_rng(3)
    x = rng.random((90, 8))
    net = nets.of_centres(rng.random((4, 8)))
    y = adversarial.classes(net.shares(x))
    y[:9] = (y[:9] + 1) % 4
    x[:, 5] = 1.1  # beyond the box, but may not change
    free = np.ones(8, bool)
    free[[0, 5]] = False
    how = adversarial.parameters(name, {"pgd": {"targeted": False, "max_iter": 30}, "zoo": {"max_iter": 40}, "jsma": {"theta": 0.1, "gamma": 0.5}}.get(name))
    run = lambda at: adversarial._ATTACKS[name](net, adversarial.Batch(x[at], y[at], free, 0.0, 1.0, at), **how)
    out, some = run(np.arange(90)), np.arange(0, 90, 7)
    assert np.array_equal(out[:, ~free], x[:, ~free]) and out[:, free].min() >= 0 and out[:, free].max() <= 1
    assert np.allclose(run(some), out[some], atol=1e-12)
    before, after = (adversarial.classes(net.shares(v)) == y for v in (x, out))
    assert (before & ~after).sum() >= {"hsja": 40, "deepfool": 40, "pgd": 20, "fgsm": 3, "zoo": 3}.get(name, 1)
    assert adversarial._ATTACKS[name](net, adversarial.Batch(x[:0], y[:0], free, 0.0, 1.0, some[:0]), **how).shape == (0, 8)


def test_gradient_attacks_row_by_row():
    rng = np.random.default_rng(4)
    net, x = _net(rng), rng.random((20, 6))
    y = adversarial.classes(net.shares(x))
    b = lambda: adversarial.Batch(x, y, np.ones(6, bool), -9.0, 9.0, np.arange(20))

    def slope(v, c, h=1e-6):
        loss = lambda u: -np.log(net.shares(u[None])[0, c])
        return np.array([(loss(v + h * e) - loss(v - h * e)) / (2 * h) for e in np.eye(6)])

    assert np.allclose(adversarial.fgsm(net, b(), 0.1, False), [v + 0.1 * np.sign(slope(v, c)) for v, c in zip(x, y, strict=True)], atol=1e-9)
    want = []
    for v, c in zip(x, y, strict=True):
        now = v.copy()
        for _ in range(12):
            now = np.clip(now + 0.05 * np.sign(slope(now, c)), v - 0.3, v + 0.3)
            if net.shares(now[None])[0].argmax() != c:
                break
        want.append(now)
    assert np.allclose(adversarial.pgd(net, b(), 0.3, 0.05, 12, 0, False), want, atol=1e-6)
    other = (y + 1) % 4
    nearer = adversarial.pgd(net, adversarial.Batch(x, other, np.ones(6, bool), -9.0, 9.0, np.arange(20)), 0.3, 0.05, 12, 0, True)
    share = lambda v: np.take_along_axis(net.shares(v), other[:, None], 1).mean()
    assert share(nearer) > share(x) + 0.05
    started = adversarial.pgd(net, b(), 0.3, 0.05, 12, 3, False)
    assert np.abs(started - x).max() <= 0.3 + 1e-12


def test_deepfool_and_cw_find_the_shortest_way_on_linear_scores():
    rng = np.random.default_rng(5)
    centres, x = rng.normal(size=(5, 7)), rng.normal(size=(60, 7))
    net = nets.of_centres(centres)
    z = net.logits(x)
    own = z.argmax(axis=1)
    gaps = np.abs(z - z.max(axis=1, keepdims=True)) / np.maximum(np.linalg.norm(centres[:, None] - centres[None], axis=2)[own], 1e-300)
    nearest = np.where(np.arange(5) == own[:, None], np.inf, gaps).min(axis=1)
    b = adversarial.Batch(x, own, np.ones(7, bool), -9.0, 9.0, np.arange(60))
    out = adversarial.deepfool(net, b, 100, 5, 1e-6)
    assert np.allclose(np.linalg.norm(out - x, axis=1), nearest, rtol=1e-4) and np.all(net.logits(out).argmax(axis=1) != own)
    out = adversarial.cw(net, b, 0.0, 0.01, 8, 60, 0.01, 5, 5)
    hit = net.logits(out).argmax(axis=1) != own
    far = np.linalg.norm(out - x, axis=1)
    assert hit.mean() > 0.9 and np.all(far[hit] >= nearest[hit] - 1e-9) and np.median(far[hit] / nearest[hit]) < 1.3


class HalfSpace:
    """Class 1 where w x > c; a curve of shares, or steps of it."""

    def __init__(self, w, c, steps=False):
        self.w, self.c, self.steps = np.array(w), c, steps

    def shares(self, x):
        p = 1 / (1 + np.exp(-8 * (x @ self.w - self.c)))
        p = (p > 0.5).astype(float) if self.steps else p
        return np.stack([1 - p, p], axis=1)


def test_answers_alone_lead_to_a_known_boundary():
    rng = np.random.default_rng(6)
    w = rng.normal(size=10)
    w /= np.linalg.norm(w)
    x = rng.random((40, 10))
    c = float(w @ np.full(10, 0.5))
    far = np.abs(x @ w - c)
    for steps in (False, True):
        model = HalfSpace(w, c, steps)
        y = adversarial.classes(model.shares(x))
        b = lambda: adversarial.Batch(x, y, np.ones(10, bool), 0.0, 1.0, np.arange(40))  # noqa: E731, B023
        out = adversarial.hsja(model, b(), **adversarial.parameters("hsja", {"max_iter": 25, "init_eval": 60}))
        assert np.all(adversarial.classes(model.shares(out)) != y)
        ratio = np.linalg.norm(out - x, axis=1) / far
        assert ratio.min() >= 1 - 1e-9 and np.median(ratio) < 1.35
    model = HalfSpace(w, c)
    y = adversarial.classes(model.shares(x))
    out = adversarial.zoo(model, b(), **adversarial.parameters("zoo", {"binary_search_steps": 6, "initial_const": 0.01, "learning_rate": 0.02}))
    hit = adversarial.classes(model.shares(out)) != y
    ratio = np.linalg.norm(out - x, axis=1)[hit] / far[hit]
    assert hit.mean() > 0.8 and ratio.min() >= 1 - 1e-9 and np.median(ratio) < 1.6


def test_answers_of_trees_in_tasks(spark):
    rng = np.random.default_rng(7)
    x = rng.random((120, 4))
    y = (x[:, 1] > 0.5).astype(int)
    df = _frame(spark, x, y)
    made = models.bagged(df, 2, n=15)
    got = adversarial.attacked(df, made, "hsja", {"init_eval": 10, "max_iter": 3}, immutable=(0,)).collect()
    assert len(got) == 120 and all(r.x[0] == x[r.row_id, 0] and not r.failed for r in got)
    assert sum(r.before == r.y and r.after != r.y for r in got) > 110
    row = adversarial.report(spark.createDataFrame(got)).first()
    assert row.rows == 120 and row.accuracy_after < 0.1 < 0.9 < row.accuracy and row.evaded > 0.9
    again = adversarial.attacked(df.repartition(7), made, "hsja", {"init_eval": 10, "max_iter": 3}, immutable=(0,)).collect()
    assert {r.row_id: r.x for r in again} == {r.row_id: r.x for r in got}
    for name in adversarial.GRADIENT:
        with pytest.raises(ValueError, match="derivatives"):
            adversarial.attacked(df, made, name)
    with pytest.raises(ValueError, match="unknown attack"):
        adversarial.attacked(df, made, "none")


def test_batches_that_take_too_long(spark):
    x, y = np.random.default_rng(8).random((20, 3)), np.zeros(20, int)
    df = _frame(spark, x, y).withColumn("label", F.when(F.col("row_id") == 3, None).otherwise(F.col("label"))).coalesce(1)
    net = nets.of_centres(np.eye(3)[:2])
    go = lambda **k: adversarial.attacked(df, net, "hsja", {"batch_size": 10}, seconds=1e-9, retries=2, **k)
    kept = go().collect()
    assert len(kept) == 19 and all(r.failed and r.x == x[r.row_id].tolist() and r.l2 == 0 for r in kept)
    assert go(placeholder="drop").count() == 0
    with pytest.raises(ValueError, match="placeholder"):
        go(placeholder="other")
    assert adversarial.attacked(df.limit(0), net, "zoo").count() == 0
    tries = []

    def run(b):
        tries.append(b.until)
        if len(tries) < 3:
            raise TimeoutError
        return b.x

    b = adversarial.Batch(x, y, np.ones(3, bool), 0.0, 1.0, np.arange(20))
    assert adversarial._attempt(run, b, 5.0, 3) is b.x and len(tries) == 3 and tries[-1] < float("inf")


def test_scaled_models(spark):
    rng = np.random.default_rng(9)
    net = _net(rng)
    low, high = rng.random(6), rng.random(6) + 2
    high[2] = low[2]
    made = adversarial.Scaled.of(net, low, high)
    u = rng.random((4, 6))
    x = u * (high - low) + low
    assert np.allclose(made.shares(u), net.shares(x)) and np.allclose(made.pull(u, net.logits(x)), net.pull(x, net.logits(x)) * (high - low))
    assert made.jacobian(u, np.zeros((4, 1), int)).shape == (4, 1, 6) and made.classes == 4
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    back = df.select(made.inside(F.col("x")).alias("u")).select("u", made.outside(F.col("u")).alias("x")).collect()
    assert np.allclose([r.x for r in back], x) and np.allclose(np.delete([r.u for r in back], 2, axis=1), np.delete(u, 2, axis=1))
    assert not hasattr(adversarial.Scaled.of(HalfSpace([1.0], 0.5), low[:1], high[:1]), "pull")


def test_parameters():
    assert adversarial.parameters("fgsm", {"eps": 0.5, "other": 1}) == {"eps": 0.5, "batch_size": 64, "targeted": False}


def test_reports_of_fitted_models(spark):
    rows = {r.attack: r for r in catalogue.attack_fitted_network(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(rows) == sorted(adversarial.GRADIENT) and len({r.rows for r in rows.values()}) == 1
    assert all(r.accuracy > 0.9 and r.failed == 0 for r in rows.values())
    assert rows["pgd"].evaded > 0.95 and rows["deepfool"].evaded > 0.95 and rows["deepfool"].mean_l2 < rows["fgsm"].mean_l2
    assert rows["pgd"].mean_linf <= 0.2 + 1e-9 and rows["fgsm"].mean_linf <= 0.1 + 1e-9
    rows = {r.attack: r for r in catalogue.attack_fitted_answers(spark, "/root/testdata/sf0.001").collect()}
    assert rows["hsja"].evaded > 0.95 and rows["zoo"].evaded > 0.5 and rows["zoo"].mean_l2 < rows["hsja"].mean_l2 * 3


@pytest.mark.parametrize("copies", [100_000, 3])
def test_copy_ids_tell_equal_rows_apart(spark, copies):
    df = spark.createDataFrame([(1, "a b")] * 10 + [(2, None)] * 2 + [(3, "c")], "`x y` int, z string")
    one, two = (clean.with_copy_ids(x, copies=copies) for x in (df, df.repartition(5)))
    assert one.select("row_id").distinct().count() == one.count() == 13
    assert one.exceptAll(two).count() == 0 and one.drop("row_id").exceptAll(df).count() == 0
    assert clean.with_copy_ids(df.limit(0)).count() == 0
