"""Hand-made tables: missing kinds, ties, constants, unknown categories, tiny labels, budgets."""

from __future__ import annotations

import gzip
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions import encoders, ranking, scalars, trees
from sluice.operators import attacks, augment, clean, cluster, ensemble, metrics, models, profile, split
from sluice.sources import blobs, tables
from sluice.spec import CONNECTIONS, FLOWS
from sluice.streaming import clean_stream


def test_specs():
    assert (len(FLOWS.ordered), len(FLOWS.continuous), len(FLOWS.binary), len(FLOWS.dropped), len(FLOWS.numerical)) == (62, 57, 4, 17, 58)
    assert (len(CONNECTIONS.raw), len(CONNECTIONS.ordered), len(CONNECTIONS.continuous), len(CONNECTIONS.labels)) == (43, 41, 34, 5)
    assert sorted(map(len, (n for _, n in CONNECTIONS.families))) == [6, 7, 11, 15]
    assert CONNECTIONS.family_map()["nmap"] == "Probe"


MISSING = [(1, None), (2, math.nan), (3, math.inf), (4, -math.inf), (5, 0.0), (6, -0.0), (7, -1.0), (8, 1.0)]


def test_missing_and_negative(spark):
    df = spark.createDataFrame(MISSING, "id int, x double")
    assert [r.id for r in clean.drop_missing_inf(df).orderBy("id").collect()] == [5, 6, 7, 8]
    assert [r.id for r in clean.drop_negative_rows(df, ["x"]).orderBy("id").collect()] == [3, 5, 6, 8]
    assert clean.has_missing_or_inf(df).first().found
    assert not clean.has_missing_or_inf(df.where("id > 7")).first().found
    assert not clean.has_missing_or_inf(df.limit(0)).first().found


def test_coercion(spark):
    tokens = ["12", " 12 ", "1.5", "abc", "", "inf", "Infinity", "Label", None]
    df = spark.createDataFrame([(i, t, t, t) for i, t in enumerate(tokens)], "id int, f string, n string, Label string")
    rows = clean.coerce(df, ["f"], ["n"], "Label").orderBy("id").collect()
    assert [r.f for r in rows] == [12.0, 12.0, 1.5, None, None, math.inf, math.inf, None, None]
    assert [r.n for r in rows] == [12, 12, None, None, None, None, None, None, None]
    assert [r.Label for r in rows] == ["12", "12", "1.5", "abc", None, "inf", "Infinity", "Label", None]


def test_funnel_of_nothing(spark):
    df = spark.createDataFrame([], "a string, Label string")
    assert tuple(clean.clean_funnel(df, ["a"], [], "Label").first()) == (0, 0, 0, 0, 0, 0)


def test_strict_and_lenient_projection(spark):
    df = spark.createDataFrame([(1, "x")], "duration int, Label string")
    with pytest.raises(Exception, match="protocol_type"):
        clean.select_features(df, CONNECTIONS).collect()
    assert clean.select_features(df.withColumn("Dst Port", F.lit(80)), FLOWS).columns == ["Dst Port", "Label"]


def test_label_filter_rejects_unknown_names(spark):
    df = spark.createDataFrame([("a",)], "Label string")
    with pytest.raises(ValueError, match="unknown labels"):
        clean.label_filter(df, "Label", ["b"], known=("a",))


def test_keep_first_and_anti_join(spark):
    df = spark.createDataFrame([(3, "s", 1.0), (1, "t", 1.0), (2, "s", None), (4, "s", None)], "row_id int, tag string, x double")
    assert sorted((r.row_id, r.tag) for r in clean.dedup_keep_first(df, ["row_id", "tag"], "row_id").collect()) == [(1, "t"), (2, "s")]
    known = spark.createDataFrame([(0.1234564,), (None,)], "x double")
    rows = spark.createDataFrame([(1, 0.1234561), (2, 0.1234571), (3, None), (4, 7.0), (5, 7.0)], "id int, x double")
    assert sorted(r.id for r in clean.anti_join_keys(rows, [known], ["x"]).collect()) == [2, 4, 5]


def test_ports(spark):
    df = spark.createDataFrame([("0",), ("1",), ("65535",), ("65536",), ("NaN",), ("2.5",), ("x",), (None,)], "p string")
    assert [r[0] for r in df.select(scalars.port(F.col("p"))).collect()] == [1, 1, 65535, 65535, 1, 2, 1, 1]
    assert [r[0] for r in df.select(scalars.port(F.col("p"), fill=False)).collect()][-2:] == [None, None]


def test_split_of_tiny_labels(spark):
    rows = [("a", i) for i in range(1)] + [("b", i) for i in range(2)] + [("c", i) for i in range(10)]
    out = split.stratified_split(spark.createDataFrame(rows, "Label string, id int"), "Label", ["Label", "id"]).groupBy("Label", "subset").count().collect()
    assert {(r.Label, r.subset): r["count"] for r in out} == {("b", "test"): 1, ("b", "train"): 1, ("c", "test"): 3, ("c", "train"): 7}


def test_split_is_disjoint_and_ranks_agree_with_a_window(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).alias("g"))
    ranked = ranking.ranked(df, ["g"], ranking.digest("id")).collect()
    for g in (True, False):
        own = sorted((r for r in ranked if r.g == g), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and {r.total for r in own} == {len(own)}
    parts = split.stratified_validation(df, "g", ["id"], 0.1).groupBy("subset").count().collect()
    assert {r.subset: r["count"] for r in parts} == {"train": 4500, "validation": 500}


def test_caps_and_topup(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("l"))
    assert split.capped_sample(df, "l", ["id"], 0).count() == 100
    assert split.capped_sample(df, "l", ["id"], 7).count() == 14
    ten = df.where("id < 10")
    assert [r.id for r in split.random_topup(df, ten, "id", 4).orderBy("id").collect()] == [0, 1, 2, 3]
    assert split.random_topup(df, ten, "id", 500).count() == 100


def test_scalers(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0), (2, 2.0, 5.0)], "id int, x double, c double")
    for e in (encoders.Linear.minmax(df, ["x", "c"]), encoders.Linear.standard(df, ["x", "c"])):
        there = e.transform(df)
        assert all(r.c == 0.0 for r in there.collect())
        assert [r.x for r in e.inverse(there).orderBy("id").collect()] == pytest.approx([1.0, 3.0, 2.0])
    assert [r.x for r in encoders.Linear.standard(df, ["x"]).transform(df).orderBy("id").collect()] == pytest.approx([-math.sqrt(1.5), math.sqrt(1.5), 0])
    port = encoders.Linear.minmax(df, ["x"])
    assert port.transform(df, keep=("x",)).first().x == 1.0


def test_quantile_uniform_and_normal(spark):
    x = np.random.default_rng(0).exponential(size=500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(1000, None)], "id int, x double")
    e = encoders.Quantile.fit(df, ["x"], ["id"], quantiles=100)
    u = {r.id: r.x for r in e.transform(df).collect()}
    assert u[1000] is None or math.isnan(u[1000])
    order = np.argsort(x)
    assert u[int(order[0])] == 0 and u[int(order[-1])] == 1 and abs(u[int(order[250])] - 0.5) < 0.01
    back = {r.id: r.x for r in e.inverse(e.transform(df)).collect()}
    assert all(abs(back[i] - v) < 1e-9 for i, v in enumerate(x))
    n = encoders.Quantile(e.grids, True)
    back = {r.id: r.x for r in n.inverse(n.transform(df)).collect()}
    assert max(abs(back[i] - v) for i, v in enumerate(x)) < 1e-3


def test_quantiles_of_a_subsample_extended(spark):
    """As the SQL of quantile_uniform_encode: the last line goes on, rows below the smallest quantile have no place."""
    df = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 3.0), (3, 4.0), (4, 6.0), (5, None)], "id int, x double")
    got = {r.id: r.x for r in encoders.Quantile({"x": [1.0, 2.0, 4.0]}).extended(df).collect()}
    assert got == {0: None, 1: 0.0, 2: 0.75, 3: 1.0, 4: 1.5, 5: None}


def test_labels_are_trimmed_of_all_blanks(spark):
    df = spark.createDataFrame([(1, "\u00a0A"), (2, "A\u2003 "), (3, "\u3000nan\u202f"), (4, "\u1680"), (5, "\tA"), (6, "A\u00a0B")], "id int, Label string")
    assert {r.id: r.Label for r in clean.coerce(df, [], [], "Label").collect()} == {1: "A", 2: "A", 3: None, 4: None, 5: "\tA", 6: "A\u00a0B"}


def test_categories(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, k string")
    hot = encoders.OneHot.fit(df, ["k"])
    there = hot.transform(spark.createDataFrame([(1, "b"), (2, "z"), (3, None)], "id int, k string"))
    assert there.columns == ["k_a", "k_b", "id"]
    assert sorted(tuple(r) for r in there.collect()) == [(0.0, 0.0, 2), (0.0, 0.0, 3), (0.0, 1.0, 1)]
    assert [r.k for r in hot.inverse(hot.transform(df.where("id < 3"))).orderBy("id").collect()] == ["b", "a"]
    loose = encoders.Ordinal.fit(df, ["k"])
    assert [r.k for r in loose.transform(spark.createDataFrame([("a",), ("z",), (None,)], "k string")).collect()] == [0, -1, -1]
    strict = encoders.label_encoder("k", ["b", "a"])
    with pytest.raises(Exception, match="unknown value"):
        strict.transform(spark.createDataFrame([("z",)], "k string")).collect()
    encoders.save_all(spark, {"hot": hot, "loose": loose, "strict": strict}, str(tmp_path / "e"))
    again = encoders.load_all(spark, str(tmp_path / "e"))
    assert again["hot"] == hot and again["strict"] == strict and again["loose"].cardinalities == {"k": 2}


def _edges_by_loop(edges: dict[int, list[int]], need: int) -> set[int]:
    """The description, step by step."""
    total = sum(map(len, edges.values()))
    chosen: list[int] = []
    for v in edges.values():
        chosen += v[: min(int(round(need * (len(v) / total))), len(v))]
    left, at = need - len(chosen), dict.fromkeys(edges, 0)
    while left > 0 and any(at[c] < len(v) for c, v in edges.items()):
        for c, v in edges.items():
            if left > 0 and at[c] < len(v):
                chosen.append(v[at[c]])
                at[c] += 1
                left -= 1
    return set(chosen)


@settings(max_examples=12, deadline=None)
@given(sizes=st.lists(st.integers(1, 9), min_size=1, max_size=6), need=st.integers(1, 30))
def test_edges_are_shared_out_as_described(spark, sizes, need):
    edges, at = {}, 0
    for c, n in enumerate(sizes):
        edges[c] = list(range(at, at + n))
        at += n
    df = spark.createDataFrame([(i, c, 1.0) for c, v in edges.items() for i in v], "row_id int, cluster int, dist double")
    assert {r.row_id for r in cluster.distribute_edges(df, need).collect()} == _edges_by_loop(edges, need)


def test_selection_sizes_and_ties(spark):
    df = spark.createDataFrame([(i, i % 3, float(i // 6)) for i in range(30)], "row_id int, cluster int, dist double")
    assert sorted(r.row_id for r in cluster.core_representatives(df).collect()) == [0, 1, 2]
    for budget in (2, 3, 10, 30, 99):
        out = cluster.select_diverse(df, budget)
        assert out.count() == min(budget, 30) == out.select("row_id").distinct().count()
    assert cluster.select_core(df, 2).count() == 3  # cores alone aren't trimmed
    with pytest.raises(ValueError, match="fallback"):
        cluster.select_core(df, 9, "other")
    assert cluster.distribute_edges(df, 0).count() == 0
    assert [cluster.default_n_clusters(*a) for a in ((10, 0, "core", 1), (10, 7, "core", 1), (10, 7, "diverse", 2.0), (2, 90, "diverse", 0.1))] == [0, 7, 3, 2]


def test_nearest_center_ties_go_to_the_smaller(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0])], "row_id int, vec array<double>")
    centers = spark.createDataFrame([(1, [1.0, 0.0]), (0, [-1.0, 0.0])], "cluster int, center array<double>")
    assert {r.row_id: r.cluster for r in cluster.assign_nearest_center(rows, centers).collect()} == {1: 0, 2: 1}


def test_kmeans_is_fitted_on_all_rows(spark):
    ids = spark.range(201_000).select(F.col("id").alias("row_id"))
    late = ids.orderBy(F.desc(ranking.digest("row_id", seed=42)), F.desc("row_id")).limit(1000).withColumn("late", F.lit(True))
    rows = ids.join(late, "row_id", "left").select("row_id", F.array(F.when(F.col("late"), 1e6).otherwise(0.0) + F.col("row_id") % 7).alias("vec"))
    placed, centers = cluster.kmeans(rows, 2)
    assert np.allclose(sorted(r.center[0] for r in centers.collect()), [3, 1e6 + 3], atol=1)
    assert sorted(r["count"] for r in placed.groupBy("cluster").count().collect()) == [1000, 200_000]


@pytest.mark.parametrize(("n", "k"), [(20_001, 3), (40, 2), (1, 2)])
def test_nearest_of_any_number_of_others(spark, n, k):
    rng = np.random.default_rng(3)
    own, other = rng.random((5, 2)), rng.random((n, 2))
    rows, others = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>") for x in (own, other))
    got = cluster.nearest_other(rows, others, k).collect()
    assert len(got) == 5
    if n < k:
        assert all(r.dist is None for r in got)
    else:
        want = np.sort(np.linalg.norm(own[:, None] - other[None], axis=2), axis=1)[:, k - 1]
        assert np.allclose([r.dist for r in sorted(got)], want, atol=1e-8)


def test_votes(spark):
    df = spark.createDataFrame([(1, "xgb", [0.5, 0.5]), (1, "dnn", [0.5, 0.5]), (1, "catb", [1.0]), (2, "none", [0.1, 0.9]), (2, "nil", [0.3, 0.7])], "row_id int, model string, p array<double>")
    out = {r.row_id: (r.p, r.y_pred) for r in ensemble.weighted_vote(df, 2).collect()}
    assert out[1] == ([0.5, 0.5], 0)
    assert out[2] == ([pytest.approx(0.2), pytest.approx(0.8)], 1)


def test_metrics_of_absent_classes_and_nothing(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y_true int, y_pred int")
    row = metrics.classification_metrics(df).first()
    assert (row.accuracy, row.n_classes) == (pytest.approx(2 / 3), 3)
    assert row.f1_macro == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert metrics.confusion_matrix(df, 4).count() == 16
    curve = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "target int, score double")
    got = [(r.score, r.tp, r.fp) for r in metrics.pr_curve(curve).orderBy(F.desc("score")).collect()]
    assert got == [(0.9, 1, 1), (0.5, 2, 1), (0.1, 2, 2)]
    assert metrics.calibrate_threshold(curve, 0.6).first().threshold == 0.5
    assert metrics.calibrate_threshold(curve.limit(0), 0.6).first().threshold == 0.5


def test_profiles_of_nothing(spark):
    df = spark.createDataFrame([], "target int, x double, k string")
    assert tuple(profile.class_weight(df, "target").first()) == (0, 0, 1.0)
    assert profile.label_distribution(df, "k").count() == 0
    assert tuple(profile.clip_range(df, ["x"]).first()) == (None, None)


def test_augmentation_leaves_no_known_key(spark):
    own = spark.createDataFrame([(float(i), float(i * i)) for i in range(30)], "a double, b double")
    out = augment.augment_to(own, augment.GaussianGenerator.fit(own, ["a", "b"]), ["a", "b"], 80)
    assert out.count() == 80
    made = {(r.a, r.b) for r in out.where("generated").collect()}
    assert not made & {(float(i), float(i * i)) for i in range(30)}
    assert augment.augment_to(own, None, ["a", "b"], 10).count() == 30
    assert [augment.request_size(10, 0.5), augment.request_size(10, 0.0), augment.request_size(10_000, 0.001)] == [80, 40000, 60000]


def test_a_learnt_flow_has_the_moments_of_its_rows(spark):
    rng = np.random.default_rng(11)
    mix = np.array([[2.0, 0.0, 0.0], [1.0, 0.5, 0.0], [0.0, 0.0, 0.1]])
    x = {"p": rng.normal(size=(1500, 3)) @ mix.T + [3, -1, 0], "q": rng.normal(size=(500, 3)) * 0.2 + [-2, 0, 5]}
    rows = spark.createDataFrame([(k, *map(float, v)) for k, t in x.items() for v in t] + [("p", None, 1.0, 1.0)], "k string, a double, b double, c double")
    made = augment.LearntFlow.fit(rows, ["a", "b", "c"], label="k", copies=6)
    assert made.classes == ["p", "q"] and np.allclose(made.prior, [0.75, 0.25])
    out = made.sample(spark, 3000, label="k").toPandas()
    assert abs((out.k == "p").mean() - 0.75) < 0.03
    for k, t in x.items():
        got = out[out.k == k][["a", "b", "c"]].to_numpy()
        assert np.allclose(got.mean(axis=0), t.mean(axis=0), atol=0.2)
        assert np.allclose(np.cov(got.T), np.cov(t.T), atol=0.12 * np.abs(np.cov(t.T)).max())
    again = made.sample(spark, 10, 2990).toPandas()
    assert np.allclose(again[["a", "b", "c"]], out.sort_values("row_id").tail(10)[["a", "b", "c"]])
    plain = augment.LearntFlow.fit(rows.select("a", "b"), ["a", "b"], copies=2, times=10)
    assert plain.sample(spark, 5).columns == ["row_id", "a", "b"] and plain.sample(spark, 5).count() == 5
    with pytest.raises(ValueError, match="no rows"):
        augment.LearntFlow.fit(rows.limit(0), ["a"]).sample(spark, 1)


def test_critic_set_and_postfilter_classifier(spark):
    a = spark.createDataFrame([(0, float(i), 1.0) for i in range(60)], "Label int, x double, y double")
    b = spark.createDataFrame([(1, float(-i - 5), 0.0) for i in range(60)], "Label int, x double, y double")
    both = augment.critic_set(a, b, "Label", 0)
    assert {r.target: r["count"] for r in both.groupBy("target").count().collect()} == {0: 60, 1: 60}
    score, threshold = augment.fit_postfilter(a, b, ["x", "y"], rounds=60, min_precision=0.9)
    assert score(a).agg(F.avg("score")).first()[0] > 0.8 and 0 <= threshold <= 1


def test_masks_and_parameters(spark):
    x = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "id int, a double, b double")
    adv = spark.createDataFrame([(1, 9.0, 8.0)], "id int, a double, b double")
    assert sorted(tuple(r) for r in augment.masked(x, adv, "id", ["a", "b"], ["a"]).collect()) == [(1, 1.0, 8.0), (2, 3.0, 4.0)]
    assert augment.masked(x, adv, "id", ["a", "b"], ["a"], "drop").count() == 1


def test_models_save_and_load(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 2), float(i % 2) + i / 1000) for i in range(80)], "id int, label double, x double")
    data = models.assembled(rows, ["x"])
    fitted = {k: models.Classifier(k, 2).fit(data) for k in ("xgb", "bagging")}
    fitted["xgb"].save(str(tmp_path))
    again = models.Classifier.load(str(tmp_path), "xgb", 2)
    assert models.evaluate(again, data).first().accuracy == 1.0
    assert models.evaluate_all(fitted, data).count() == 2
    voted = models.vote(fitted, data, "id").join(rows, F.col("row_id") == F.col("id"))
    assert voted.where("y_pred <> label").count() == 0


def test_learners_are_as_large_as_the_reference():
    import inspect

    assert {k: (b.rounds, b.depth, b.patience) for k, b in models.BOOSTED.items()} == {"xgb": (1200, 8, 20), "catb": (2000, 8, 50), "histgbm": (500, 30, 10)}
    assert models.BAGGED == 300
    post = inspect.signature(augment.fit_postfilter).parameters
    assert (post["rounds"].default, post["depth"].default) == (500, 6)


def test_boosting_ends_by_patience():
    assert trees.best_round([3.0, 2.0, 2.5, 1.0, 1.5, 1.5, 0.5], 2) == (4, True)
    assert trees.best_round([3.0, 2.0, 2.5, 1.0], 2) == (4, False)
    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    y = ((x[:, 0] > 0.5) ^ (rng.random(400) < 0.2)).astype(float)
    cuts = trees.cuts_of(x)
    codes, w, held = trees.binned(x, cuts), np.ones(400), np.arange(400) % 4 == 0
    how = trees.Boosting(60, 3, 3, 0.5)
    made = trees.boost(codes, y, w, held, how, 1)
    n = len(made.roots) - 1
    assert 1 <= n < 60
    every = trees.boost(codes, y, w, np.zeros(400, bool), trees.Boosting(5, 3, 3, 0.5), 1)
    assert len(every.roots) == 6
    same = trees.Trees.unpack(made.pack())
    assert np.array_equal(same.total(codes), made.total(codes)) and np.mean((made.total(codes)[:, 0] > 0) == (x[:, 0] > 0.5)) > 0.9


def _best_split(x, g, h, penalty, leaf):
    """(gain, column, cut) by trying every value of every column."""
    best = (1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) < leaf:
                continue
            parts = [g[k].sum() ** 2 / (h[k].sum() + penalty) for k in (left, ~left, np.ones(len(g), bool))]
            best = max(best, (parts[0] + parts[1] - parts[2], f, c), key=lambda t: t[0] - 1e-12 * t[1])
    return best


def _by_hand(x, g, h, depth, penalty, leaf):
    """Each row's leaf value, by recursion over every split."""
    gain, f, c = _best_split(x, g, h, penalty, leaf) if depth else (0, -1, 0)
    if f < 0:
        return np.full(len(g), -g.sum() / (h.sum() + penalty))
    left, out = x[:, f] <= c, np.empty(len(g))
    for k in (left, ~left):
        out[k] = _by_hand(x[k], g[k], h[k], depth - 1, penalty, leaf)
    return out


@pytest.mark.parametrize("blocks", [1 << 21, 1])
def test_a_tree_has_the_best_split_of_every_node(monkeypatch, blocks):
    monkeypatch.setattr(trees, "CELLS", blocks)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (150, 4)) + rng.random(4)
    y = (rng.random(150) < 0.2 + 0.6 * (x[:, 1] > 6)).astype(float)
    codes = trees.binned(x, trees.cuts_of(x))
    for leaf in (1, 9):
        made = trees.boost(codes, y, np.ones(150), np.zeros(150, bool), trees.Boosting(1, 1, 4, 0.1, leaf=leaf, penalty=1.0), 0)
        p = y.mean()
        want = np.log(p / (1 - p)) + 0.1 * _by_hand(x, p - y, np.full(150, p * (1 - p)), 4, 1.0, leaf)
        assert np.allclose(made.total(codes)[:, 0], want)


def test_bagged_trees_are_full_and_handle_what_is_missing():
    x = np.array([[0.0, np.nan], [1.0, 5.0], [2.0, np.nan], [3.0, 5.0]] * 10)
    label = np.array([0, 1, 2, 1] * 10)
    codes = trees.binned(x, trees.cuts_of(x))
    made = trees.together([trees.bag(codes, label, np.ones(40), 3, 200, i) for i in range(20)])
    shares = made.total(codes) / 20
    assert np.allclose(shares.sum(axis=1), 1) and np.array_equal(shares.argmax(axis=1), label)
    flat = trees.bag(np.zeros((5, 2), np.uint8), np.array([0, 0, 1, 1, 1]), np.ones(5), 2, 200, 0)
    assert len(flat.feature) == 1


def test_nodes_of_few_rows_have_small_histograms_and_the_same_cuts(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(600, 5)), rng.integers(0, 3, (600, 3))], axis=1)
    codes, label, w = trees.binned(x, trees.cuts_of(x)), rng.integers(0, 4, 600), rng.integers(1, 4, 600) / 2.0
    how = trees.Boosting(8, 8, 30, 0.1, leaf=2, penalty=1.0)
    cells, plain = [0], trees.np.bincount

    def counted(values, weights=None, minlength=0):
        cells[0] += minlength
        return plain(values, weights, minlength)

    with monkeypatch.context() as m:
        m.setattr(trees.np, "bincount", counted)
        trees.bag(codes, label, w, 4, 200, 3)
    made = [trees.bag(codes, label, w, 4, 200, 3), trees.boost(codes, (label == 1) * 1.0, w, np.zeros(600, bool), how, 1)]
    every = (made[0].child != np.arange(len(made[0].child))).sum() * 8 * 64 * 4  # cells, had all nodes that are split a place for each code
    assert 0 < cells[0] < every / 2
    monkeypatch.setattr(trees, "FEW", ())
    dense = [trees.bag(codes, label, w, 4, 200, 3), trees.boost(codes, (label == 1) * 1.0, w, np.zeros(600, bool), how, 1)]
    for one, other in zip(made, dense, strict=True):
        assert all(np.array_equal(getattr(one, k), getattr(other, k)) for k in ("feature", "cut", "child", "value"))


def test_large_forests_stay_packed(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3))
    label = rng.integers(0, 3, 200)
    cuts = trees.cuts_of(x)
    packed = [trees.bag(trees.binned(x, cuts), label, np.ones(200), 3, 200, i).pack() for i in range(6)]
    together = models.TreeModel(cuts, trees.sized(packed), True, 3)
    monkeypatch.setattr(trees, "NODES", 100)
    apart = models.TreeModel(cuts, trees.sized(packed), True, 3)
    apart.save(spark, str(tmp_path / "m"))
    again = models.TreeModel.load(spark, str(tmp_path / "m"))
    assert len(together.groups) == 1 and apart.groups == again.groups == packed
    for model in (apart, again):
        assert np.allclose(model.shares(x), together.shares(x), rtol=0, atol=1e-12)


@pytest.mark.parametrize("kind", ["xgb", "catb", "histgbm", "bagging"])
def test_learners_reach_an_accuracy_on_rows_not_seen(spark, kind):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 4, 900)
    x = rng.normal(size=(900, 5)) + np.stack([label == 1, label == 2, label == 3, label % 2, np.zeros(900)], axis=1) * 4.0
    rows = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(label, x, strict=True))], "id int, label int, a double, b double, c double, d double, e double")
    data = models.assembled(rows, list("abcde"))
    made = models.Classifier(kind, 4).fit(data.where("id < 600"))
    assert models.evaluate(made, data.where("id >= 600")).first().accuracy > 0.94


def test_training_rows_are_bounded_and_weighted(spark):
    rows = spark.createDataFrame([(float(i % 7), int(i % 10 == 0)) for i in range(200)] + [(None, 1), (1.0, None)], "v double, label int")
    data = models.assembled(rows, ["v"])
    x, label, w, held = models.sampled(data.where("v IS NOT NULL"), 2, 42, rows=60)
    assert x.shape == (50, 1) and sorted(np.bincount(label)) == [20, 30] and held.sum() == 5
    assert np.allclose([w[label == 0].sum(), w[label == 1].sum()], [180, 20])
    again = models.sampled(data.where("v IS NOT NULL").repartition(5), 2, 42, rows=60)
    assert np.array_equal(again[0], x) and np.array_equal(again[1], label)
    with pytest.raises(ValueError, match="no rows"):
        models.sampled(data.limit(0), 2, 42)


@pytest.mark.parametrize("within", [100, 5000])
def test_bagged_trees_learn_every_row(spark, monkeypatch, within):
    # labels that only rows by themselves tell: what isn't learned is missed
    monkeypatch.setattr(models.sampled, "__defaults__", (60,))
    monkeypatch.setattr(models, "WITHIN", within, raising=False)
    rng = np.random.default_rng(5)
    label = np.where(np.arange(900) < 600, 0, rng.integers(1, 3, 900))
    rows = [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(rng.permutation(label), rng.normal(size=(900, 12)), strict=True))]
    data = models.assembled(spark.createDataFrame(rows, "id int, label int, " + ", ".join(f"c{i} double" for i in range(12))), [f"c{i}" for i in range(12)])
    made = models.bagged(data, 3, n=25)
    kept = models.Classifier("bagging", 3, made).predict(data).select("id", "label", "y_pred", "p").orderBy("id").collect()
    assert np.mean([r.label == r.y_pred for r in kept]) > 0.97
    again = models.Classifier("bagging", 3, models.bagged(data.repartition(5), 3, n=25)).predict(data).select("id", "p").orderBy("id").collect()
    assert np.allclose([r.p for r in again], [r.p for r in kept])
    with pytest.raises(ValueError, match="no rows"):
        models.bagged(data.limit(0), 3, n=2)


def test_upper_nodes_by_counts_are_those_of_one_task(spark, monkeypatch):
    from sluice.operators import forest

    rng = np.random.default_rng(6)
    x, label = np.round(rng.normal(size=(500, 4)), 1), rng.integers(0, 3, 500)
    monkeypatch.setattr(forest, "BLOCK", 64)
    monkeypatch.setattr(forest, "BYTES", 500 * 16 * 2)  # two trees a round
    rows = spark.createDataFrame([(list(map(float, v)), int(c), 1.0) for v, c in zip(x, label, strict=True)], "x array<double>, label int, w double").repartition(3)
    cuts, split = forest.fit(rows, 3, 5, 200, 1, 30)
    _, whole = forest.fit(rows, 3, 5, 200, 1, 1000)
    codes = trees.binned(x, cuts)
    for one, other in zip(map(trees.Trees.unpack, split), map(trees.Trees.unpack, whole), strict=True):
        assert len(one.feature) == len(other.feature) > 100
        assert np.allclose(one.total(codes), other.total(codes))
    short, same = ([trees.Trees.unpack(p) for p in forest.fit(rows, 3, 2, 3, 1, within)[1]] for within in (100, 1000))
    for one, other in zip(short, same, strict=True):
        assert one.depth == 3 and 7 < len(one.feature) <= 15 and np.allclose(one.total(codes), other.total(codes))


def test_cuts_of_all_rows(spark):
    from sluice.operators import forest

    rng = np.random.default_rng(7)
    n = 3000
    odd = rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n)
    odd[:9] = [np.nan, np.inf, -np.inf, 0.0, -0.0, 5e-324, -1.7e308, 1.7e308, np.nan]
    most = np.where(rng.random(n) < 0.7, 9.0, rng.normal(size=n))
    least = np.where(rng.random(n) < 0.7, -9.0, rng.normal(size=n))
    x = np.stack([rng.normal(size=n), rng.integers(0, 2, n), np.full(n, 3.0), odd, most, least, rng.integers(0, 65, n), np.full(n, np.nan), rng.normal(size=n).astype(np.float32)], axis=1)
    rows = spark.createDataFrame([(list(map(float, v)),) for v in x], "x array<double>").repartition(4)
    got, want = forest.cuts_of(rows, x.shape[1]), trees.cuts_of(x)
    assert all(np.array_equal(g, w) for g, w in zip(got, want, strict=True))


def test_boosting_of_three_classes(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(models.BOOSTED, "xgb", trees.Boosting(6, 2, 2, 0.3))
    rows = spark.createDataFrame([(i, i % 3, float(i % 3) + i % 5 / 1000) for i in range(90)], "id int, label int, x double")
    data = models.assembled(rows, ["x"])
    models.Classifier("xgb", 3).fit(data).save(str(tmp_path))
    again = models.Classifier.load(str(tmp_path), "xgb", 3)
    assert len(again.model.groups) == 3 and all(2 <= len(g.roots) <= 7 for g in again.model.groups)
    out = again.predict(data).collect()
    assert all(r.y_pred == r.label and len(r.p) == 3 and abs(sum(r.p) - 1) < 1e-9 for r in out)


def test_files(spark, tmp_path):
    for name, head, line in (("b.csv", " x, y ,Label", "1, 2,A b/c"), ("a.csv", "x,y,Label", "3,4,B"), ("c.csv", "x,y,z,Label", "5,6,7,B")):
        (tmp_path / name).write_text(f"{head}\n{line}\n")
    paths = [str(tmp_path / n) for n in ("c.csv", "b.csv", "a.csv")]
    h = tables.headers(spark, paths)
    voted = tables.majority_schema(h).first()
    assert (voted["columns"], voted.files) == (["x", "y", "Label"], 2)
    assert [r.extra for r in tables.schema_outliers(h, voted["columns"]).collect()] == [["z"]]
    df = tables.read_csv(spark, paths, voted["columns"])
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2", "A b/c"), ("3", "4", "B"), ("5", "6", "B")]
    with pytest.raises(ValueError, match="lacks"):
        tables.read_csv(spark, paths, ["z"])
    tables.write_by_label(df, "Label", str(tmp_path / "out"), rows_of_file=1)
    back = tables.read_labels(spark, str(tmp_path / "out"), ["A b/c"])
    assert back.count() == 1 and "PartitionFilters: [" in back._jdf.queryExecution().toString()
    (tmp_path / "n.txt").write_text("1,2\n3,4\n")
    assert tables.read_headerless(spark, str(tmp_path / "n.txt"), ["p", "q"]).columns == ["p", "q"]
    tables.write_csv(df, str(tmp_path / "csv"))
    tables.write_metrics(df.limit(1), str(tmp_path / "m"))
    assert tables.clean_merged_name("r", "A b/c", "train") == "r_a_b_c_train_clean_merged"
    (tmp_path / "xgb").mkdir()
    assert tables.find_models(spark, str(tmp_path), ("xgb", "dnn")) == {"xgb": f"{tmp_path}/xgb"}
    assert tables.find_models(spark, str(tmp_path), ("xgb", "dnn"), ("xgb",)) == {}
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("é,b\n1,2\n")
    (tmp_path / "none.csv").write_text("")
    assert tables.first_lines(spark, [str(tmp_path / n) for n in ("z.csv.gz", "none.csv")]) == {str(tmp_path / "z.csv.gz"): "é,b", str(tmp_path / "none.csv"): ""}
    assert tables.read_header(spark, str(tmp_path / "none.csv")) == []
    with blobs.create(f"file://{tmp_path}/d/x y") as f:
        f.write(b"abc")
    with blobs.read(f"file://{tmp_path}/d/x y") as f:
        assert f.read() == b"abc"


def test_stream_equals_table(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.csv").write_text("x,Label\n1,a\n" + f"{i},b\nLabel,Label\n-1,a\nx,a\n")
    raw = clean_stream.read_stream(spark, str(src), ["x", "Label"], files_per_batch=1)
    q = clean_stream.write_stream(clean_stream.cleaned_stream(raw, ["x"], [], "Label"), "Label", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted((r.x, r.Label) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = clean.cleaned(tables.read_csv(spark, [str(p) for p in src.iterdir()], ["x", "Label"]), ["x"], [], "Label")
    assert got == sorted((r.x, r.Label) for r in want.collect()) == [(0.0, "b"), (1.0, "a"), (1.0, "b"), (2.0, "b")]


def test_staged_tables_are_in_the_shared_folder(spark):
    out = staging.stage(spark.range(3).toDF("id"), "t")
    assert out.staged_at.startswith(spark.conf.get("spark.checkpoint.dir")) and out.count() == 3
    staging.drop(out)


def test_filters_and_columns_reach_the_scan(spark):
    from conftest import DATA

    df = clean.drop_negative_rows(spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey", "c_acctbal"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan and "PushedFilters: []" not in plan


def test_percentiles_of_clusters_equal_the_exact_ones(spark):
    rng = random.Random(6)
    rows = [(c, d) for c, values in {1: [rng.random() for _ in range(500)], 2: [3.5], 3: [1.0] * 40 + [2.0], 4: [rng.choice([0.0, 1e-9, 5.0]) for _ in range(77)], 5: [0.0, 1e6]}.items() for d in values]
    dist = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(rows)] + [(999, 1, None)], "row_id long, cluster int, dist double")
    for p in (0.0, 50.0, 92.0, 95.0, 100.0):
        want = {r.cluster: r.x for r in dist.groupBy("cluster").agg(F.percentile("dist", F.lit(p / 100)).alias("x")).collect()}
        got = {r.cluster: r.limit for r in cluster.percentiles(dist, p).collect()}
        assert got == pytest.approx(want)


def test_a_hot_label_has_several_files(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "Hot one").when(F.col("id") < 990, "b").alias("label"), F.col("id").alias("_files"))
    tables.write_by_label(df, "label", str(tmp_path / "o"), rows_of_file=100)
    back = tables.read_labels(spark, str(tmp_path / "o"))
    assert back.select("label", "_files").exceptAll(df).count() == 0 and back.count() == 1000
    assert len(list((tmp_path / "o" / "label_safe=hot_one").glob("*.parquet"))) > 2


def test_embedding_size():
    assert [scalars.embedding_size(n, 8) for n in (1, 2, 5, 9, 100)] == [2, 2, 2, 4, 8]


def test_attacks_change_the_class_and_leave_immutable_columns(spark):
    rng = random.Random(4)
    weights, bias = {"a": 2.0, "b": -1.0, "c": 0.5, "kept": 3.0}, -0.4
    rows = [(i, *(rng.uniform(-1, 1) for _ in weights)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, kept double")
    before = {r.id: r for r in df.collect()}
    f = lambda r: bias + sum(w * r[c] for c, w in weights.items())
    for attack in (attacks.deepfool, lambda *x, **k: attacks.carlini(*x, confidence=0.1, **k), lambda *x, **k: attacks.pgd(*x, eps=5.0, step=0.5, steps=20, **k)):
        after = {r.id: r for r in attack(df, weights, bias, immutable=("kept",)).collect()}
        assert all((f(r) > 0) != (f(before[i]) > 0) and r.kept == before[i].kept for i, r in after.items())
    for r in attacks.carlini(df, weights, bias, confidence=0.1, immutable=("kept",)).collect():
        assert abs(f(r)) == pytest.approx(0.1)
    near = {r.id: r for r in attacks.pgd(df, weights, bias, eps=0.2, step=0.1, steps=9, immutable=("kept",), low=-1.0, high=1.0).collect()}
    assert all(abs(r[c] - before[i][c]) <= 0.2 + 1e-12 and -1 <= r[c] <= 1 for i, r in near.items() for c in "abc")
    moved = {r.id: r for r in attacks.jsma(df, weights, bias, theta=0.5, gamma=0.5, immutable=("kept",)).collect()}
    for i, r in moved.items():
        changed = [c for c in "abc" if r[c] != before[i][c]]
        first = f(before[i]) + (-1 if f(before[i]) > 0 else 1) * 1.0
        assert changed == (["a"] if (first > 0) != (f(before[i]) > 0) else ["a", "b"])
