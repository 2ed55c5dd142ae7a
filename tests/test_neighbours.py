"""Nearest neighbours against all pairs, how many of these are measured, edited rows, coresets, centres fitted by batches."""

from __future__ import annotations

import collections
import json
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice import staging
from sluice.operators import cluster, coreset, neighbours
from sluice.plans import stages


def _table(spark, x, cls, parts=4):
    rows = [(i, None if v is None else [float(a) for a in v], None if c is None else int(c)) for i, (v, c) in enumerate(zip(x, cls, strict=True))]
    return spark.createDataFrame(rows, "row_id long, vec array<double>, cls int").repartition(parts)


def _brute(x, cls, i, k, differ):
    d = [(round(float(np.linalg.norm(np.array(x[i]) - np.array(x[j]))), 9), cls[j]) for j in range(len(x)) if j != i and (not differ or cls[j] != cls[i])]
    return sorted(d)[:k]


@pytest.mark.parametrize(("kind", "k", "differ", "unit"), [("lattice", 3, False, 16), ("copies", 2, True, 16), ("random", 2, False, 4096)])
def test_neighbours_against_all_pairs(spark, kind, k, differ, unit):
    rng = np.random.default_rng(2)
    x = {"lattice": rng.integers(0, 4, (150, 2)), "random": rng.normal(size=(150, 5)), "copies": np.repeat(rng.integers(0, 3, (10, 3)), 15, axis=0)}[kind].astype(float).tolist()
    cls = rng.integers(0, 3, 150).tolist()
    got = neighbours.nearest(_table(spark, x, cls), None, k, differ, unit).collect()
    assert len(got) == 150
    for r in got:
        assert [(round(e.dist, 9), e.cls) for e in r.near for _ in range(e.n)] == _brute(x, cls, r.row_id, k, differ)


@pytest.mark.parametrize("strict", [False, True])
def test_edited_rows(spark, strict):
    rng = np.random.default_rng(3)
    x, cls = rng.integers(0, 4, (150, 2)).astype(float).tolist(), rng.integers(0, 3, 150).tolist()
    for r in neighbours.edited(_table(spark, x, cls), 3, strict).collect():
        near = [c for _, c in _brute(x, cls, r.row_id, 3, False)]
        best = min(c for c in near if near.count(c) == max(map(near.count, near)))
        assert r.vote == best and r.kept == (set(near) == {cls[r.row_id]} if strict else best == cls[r.row_id])


def test_few_distances_are_measured_on_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 20
    x = np.concatenate([c + rng.normal(size=(100, 16)) for c in centres])
    df = _table(spark, x, np.arange(4000) % 2)
    got = neighbours.nearest(df, None, 1, True, unit=64)
    share = got.agg(F.sum("compared")).first()[0] / (4000 * 4000)
    assert share < 0.1
    some = {r.row_id: r.near[0].dist for r in got.where("row_id < 200").collect()}
    for i in range(0, 200, 9):
        assert some[i] == pytest.approx(np.linalg.norm(x[(i + 1) % 2 :: 2] - x[i], axis=1).min(), abs=1e-9)


def test_points_travel_once_for_each_group_of_units(spark):
    """Where no bound helps a point went to every unit, so that disk grew with the square of the rows."""
    by_unit, by_block = neighbours.grid(300, 10_000, 10_000, 96)
    assert by_unit + by_block <= 21 and by_unit * by_block >= 96
    rng = np.random.default_rng(6)
    x, p = rng.normal(size=(500, 32)), rng.normal(size=(8, 32)) / 100
    kinds = [("unit", "i8"), ("cell", "i4"), ("low", "f8"), ("high", "f8"), ("part", "i8")]
    units = np.array([(j, j % 8, 0.0, 9.0, j % 3) for j in range(40)], dtype=kinds)
    sent = spark.sparkContext.broadcast
    df = spark.createDataFrame([(i, 0, 1, v.tolist(), 5.0) for i, v in enumerate(x)], "pid long, cls int, n long, vec array<double>, limit double").coalesce(1)
    blocks = df.mapInArrow(neighbours._sent(sent(p), sent(units), False, 1024), neighbours._SENT).collect()
    assert sum(len(b.pid) // 8 for b in blocks) <= 3 * 500


@pytest.mark.parametrize("differ", [False, True])
def test_limits_shrink_over_units_and_leave_the_nearest(differ):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(400, 6))
    a, b, n = rng.integers(0, 3, 50).astype("<i4"), rng.integers(0, 3, 400).astype("<i4"), np.ones(400, "<i8")
    start = np.where(np.arange(50) % 2, np.inf, 50.0)
    block = neighbours.Block(np.arange(50).tobytes(), a.tobytes(), start.tobytes(), neighbours._data(x), np.zeros((1, 6)))
    for at in range(0, 400, 80):
        part = slice(at, at + 80)
        far = np.linalg.norm(y[part], axis=1)
        block.meet(0, far.min(), far.max(), b[part], n[part], neighbours._data(y[part]), 3, differ)
    i, d, cls, _ = block.found
    for row in range(50):
        every = sorted((round(float(np.linalg.norm(y[j] - x[row])), 9), int(b[j])) for j in range(400) if not differ or a[row] != b[j])[:3]
        assert sorted(zip(np.round(d[i == row], 9).tolist(), cls[i == row].tolist(), strict=True)) == every
    assert block.compared <= 50 * 400


def test_odd_vectors_and_empty_tables(spark):
    x = [[0.0, 0.0], None, [float("nan"), 1.0], [1.0], [3.0, 4.0], [0.0, 0.0]]
    df = _table(spark, x, [0, 0, 0, 0, 1, None])
    got = {r.row_id: r for r in neighbours.nearest(df, None, 1).collect()}
    assert len(got) == 6 and all(got[i].near is None for i in (1, 2, 5)) and got[3].near == []
    assert [(e.dist, e.cls, e.n) for e in got[0].near] == [(5.0, 1, 1)]
    alone = neighbours.nearest(df.where("row_id = 0"), None, 2).collect()
    assert alone[0].near == []
    assert neighbours.nearest(df.where("row_id = 0"), df.limit(0), 2).collect()[0].near == []
    assert neighbours.nearest(df.limit(0), df, 2).count() == 0
    assert [(r.row_id, r.kept) for r in neighbours.edited(df.where("row_id = 0")).collect()] == [(0, True)]


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, s = rng.normal(size=(60, 4)), rng.normal(size=(300, 4))
    p = neighbours.spread(s, 12)
    cell = neighbours.distances(s, p).argmin(axis=1)
    far = np.linalg.norm(s - p[cell], axis=1)
    units = np.array([(j, j, far[cell == j].min(), far[cell == j].max()) for j in range(12)], dtype=[("unit", "i8"), ("cell", "i4"), ("low", "f8"), ("high", "f8")])
    low = neighbours.bounds(x, p, units)
    for j in range(12):
        d = np.sqrt(neighbours.distances(x, s[cell == j])).min(axis=1)
        assert np.all(low[:, j] <= d + 1e-9)
    assert (low > 0).mean() > 0.5


def test_farthest_first_is_that_of_a_row_at_a_time(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    x[50:60] = x[50]
    df = _table(spark, [*x, None], [*[0] * 120, 0])
    for start, candidates in ((None, 2000), ([7, 11], 8)):
        first = None if start is None else spark.createDataFrame([(i,) for i in start], "row_id long")
        got, gaps = coreset.farthest_first(df, 20, first, candidates)
        want, d = ([0], np.linalg.norm(x - x[0], axis=1)) if start is None else ([], np.linalg.norm(x[:, None] - x[start], axis=2).min(axis=1))
        while len(want) < 20:
            want.append(int(np.argmax(d)))
            d = np.minimum(d, np.linalg.norm(x - x[want[-1]], axis=1))
        assert [r.row_id for r in got.orderBy("rank").collect()] == want
        assert np.allclose([r.dist for r in gaps.orderBy("row_id").collect()], d)
    got, _ = coreset.farthest_first(df.where("row_id between 50 and 59"), 5)
    assert got.count() == 1
    assert coreset.farthest_first(df.limit(0), 5)[0].count() == 0


def test_coreset_of_a_class_against_another(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 2)), rng.normal(size=(100, 2)) + [4, 0]])
    df = _table(spark, x, [0] * 300 + [1] * 100)
    own, other = df.where("cls = 0"), df.where("cls = 1")
    chosen, gaps = coreset.select(own, other, 40, 0.25)
    rows = chosen.collect()
    d = np.linalg.norm(x[:300, None] - x[None, 300:], axis=2).min(axis=1)
    assert collections.Counter(r.role for r in rows) == {"pin": 10, "core": 30}
    assert {r.row_id for r in rows if r.role == "pin"} == set(np.argsort(d, kind="stable")[:10])
    row = coreset.quality(gaps, chosen, own.select("row_id", (F.col("row_id") % 7).alias("cluster")), 0.2).first()
    near = np.linalg.norm(x[:300, None] - x[[r.row_id for r in rows]][None], axis=2).min(axis=1)
    assert row.radius_p90 == pytest.approx(np.quantile(near, 0.9), abs=1e-8) and row.radius_max == pytest.approx(near.max(), abs=1e-8)
    assert (row.chosen, row.pins, row.clusters, row.small_clusters) == (40, 10, 7, 7) and row.small_kept == row.clusters_kept


def test_minibatches_come_near_the_full_fit(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([c + rng.normal(size=(150, 4)) * 0.3 for c in rng.normal(size=(12, 4)) * 5])
    df = _table(spark, [*x, None], [0] * 1801)
    def inertia(made):
        c = np.array([r.center for r in made[1].orderBy("cluster").collect()])
        at = {r.row_id: r.cluster for r in made[0].collect()}
        assert len(at) == 1800
        assert all(at[i] == np.linalg.norm(c - x[i], axis=1).argmin() for i in range(0, 1800, 50))
        return sum(np.linalg.norm(x[i] - c[at[i]]) ** 2 for i in at)

    full = inertia(cluster.kmeans(df.where("vec is not null"), 12))
    assert inertia(cluster.minibatch_kmeans(df, 12, batch=400, rounds=10)) < 1.1 * full
    one, again = (cluster.minibatch_kmeans(t, 12, batch=400, rounds=1) for t in (df, df.repartition(3)))
    assert np.allclose(*(np.array([r.center for r in m[1].orderBy("cluster").collect()]) for m in (one, again)))


def test_a_tree_of_centres_is_exact(spark):
    rng = np.random.default_rng(8)
    c, x = rng.normal(size=(1500, 6)), rng.normal(size=(700, 6))
    c[900] = c[3]
    at, d = cluster.CentreTree.of(c).nearest(x)
    want = neighbours.distances(x, c)
    assert np.array_equal(at, want.argmin(axis=1)) and np.allclose(d, want.min(axis=1))
    assert cluster.CentreTree.of(np.zeros((3, 2))).nearest(np.ones((2, 2)))[0].tolist() == [0, 0]


def test_more_centres_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cluster, "FEW", 50)
    rng = np.random.default_rng(9)
    x, c = rng.normal(size=(80, 3)), rng.normal(size=(200, 3))
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster int, center array<double>")
    got = {r.row_id: r.cluster for r in cluster.assign_nearest_center(_table(spark, x, [0] * 80).select("row_id", "vec"), centers).collect()}
    assert [got[i] for i in range(80)] == neighbours.distances(x, c).argmin(axis=1).tolist()


def _folders(spark):
    at = Path(staging.shared_dir(spark).removeprefix("file://")) / "stages"
    return set(at.iterdir()) if at.exists() else set()


def test_scopes_of_threads_are_their_own(spark):
    before, errors = _folders(spark), []

    def work(k):
        try:
            for _ in range(3):
                with staging.scope() as kept, staging.small_batches(spark, 100 + k):
                    staging.stage(spark.range(5), "a")
                    with staging.scope():
                        pass
                    out = staging.stage(spark.range(k), "b")
                    kept.append(out)
                    time.sleep(0.05)
                assert out.count() == k
                staging.drop(out)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and _folders(spark) == before
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_labels_run_together_or_one_by_one(spark):
    spans = {}

    def work(label):
        began = time.time()
        assert spark.range(4, numPartitions=4).mapInPandas(lambda it: (time.sleep(1.5) or b for b in it), "id long").count() == 4
        spans[label] = (began, time.time())
        return label.upper()

    assert stages.by_label(spark, ["a", "b"], work, jobs=2) == {"a": "A", "b": "B"}
    assert max(b for b, _ in spans.values()) < min(e for _, e in spans.values())
    assert stages.by_label(spark, ["a", "b"], work, jobs=1) == {"a": "A", "b": "B"}
    assert spans["a"][1] <= spans["b"][0]

    def fails(label):
        if label == "a":
            raise KeyError(label)
        return spark.range(4, numPartitions=4).mapInPandas(lambda it: (time.sleep(20) or b for b in it), "id long").count()

    began = time.time()
    with pytest.raises(KeyError):
        stages.by_label(spark, ["b", "a"], fails, jobs=2)
    assert time.time() - began < 15


def test_counters_come_with_the_write(spark, tmp_path):
    from sluice.operators import clean

    rows = [("1", "2", "A"), ("1", "2", "A"), ("x", "2", "A"), ("-1", "2", "B"), ("qty", "n", "Label"), ("5", "1.5", "B"), ("5", "7", " B ")]
    raw = spark.createDataFrame(rows, "qty string, n string, Label string")
    want = clean.clean_funnel(raw, ["qty"], ["n"], "Label").first().asDict()
    df, counts = clean.cleaned_and_counted(raw, ["qty"], ["n"], "Label")
    df.write.parquet(str(tmp_path / "o"))
    assert counts() == want == {"rows_read": 7, "header_rows": 1, "missing_rows": 2, "negative_rows": 1, "clean_rows": 3, "distinct_rows": 2}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect())) == sorted(map(tuple, clean.cleaned(raw, ["qty"], ["n"], "Label").collect()))
    empty, counts = clean.cleaned_and_counted(raw.limit(0), ["qty"], ["n"], "Label")
    empty.write.parquet(str(tmp_path / "e"))
    assert set(counts().values()) == {0} and json.dumps(counts())
