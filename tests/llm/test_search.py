"""Ranked search, whitening and exact duplicates against brute force, with odd rows of every kind."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from conftest import DATA, SMALL, rows_of
from pyspark.sql import functions as F

from sluice.llm import exact, queries, ranked, whitening

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def plain_search(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document."""
    cut = [(i, TERM.findall((t or "").encode().lower())) for i, t in docs]
    cut = [(i, w) for i, w in cut if w]
    n, total = len(cut), sum(len(w) for _, w in cut)
    df = collections.Counter(t for _, w in cut for t in set(w))
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for i, w in cut:
            counts, m = collections.Counter(w), 50 + 50 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m)) for t in set(TERM.findall((text or "").encode().lower())) if counts[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "step", "k"), [(1 << 14, 1 << 20, 5), (7, 3, 3), (20, 40, 50)])
def test_search_against_all_documents(spark, monkeypatch, shard, step, k):
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "STEP", step)
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["Éa", "B7", "世界", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=np.arange(34, 0, -1) / 595.0))
    docs = [(i, text(rng.integers(0, 30))) for i in range(150)] + [(None, text(9)), (None, text(9)), (7, "w1 w2"), (7, "w1 w2"), (200, None), (201, ""), (202, "-- !!"), (203, "W1,w2;w30" * 40)]
    items = [(i, text(5)) for i in range(8)] + [(1, "W3 w4"), (1, "W3 w4"), (20, None), (21, "unknown"), (22, " "), (None, "x x b7")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked.search(d, q, k).collect()]
    assert sorted(got, key=repr) == plain_search(docs, items, k)


def test_search_in_blocks_and_of_nothing(spark, monkeypatch):
    docs = [(i, f"a b{i % 3} c{i % 5}") for i in range(30)]
    items = [(i, f"b{i % 3} c{i % 4}") for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"term": F.lit(1), "score": F.lit("s")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = plain_search(docs, items, 4)
    monkeypatch.setattr(ranked, "BLOCK", 5)
    assert sorted((tuple(r) for r in ranked.search(d, q, 4).collect()), key=repr) == want
    assert ranked.search(d.limit(0), q).count() == 0 and ranked.search(d, q.limit(0)).count() == 0


def test_documents_that_cannot_enter_are_skipped():
    rng = np.random.default_rng(2)
    lists = []
    for df, w in ((3000, 3), (2500, 5), (400, 300), (60, 900), (30, 1500)):
        docs = np.sort(rng.choice(5000, df, replace=False))
        gives = rng.integers(1, w + 1, df)
        lists.append(([*docs.tolist(), ranked._LAST], gives.tolist(), int(gives.max())))
    score = collections.Counter()
    for docs, gives, _ in lists:
        for i, g in zip(docs, gives, strict=False):
            score[i] += g
    heap = []
    scored = ranked.wand(lists, 10, heap, lambda s, i: (s, -i))
    assert sorted(heap, reverse=True) == sorted(((s, -i) for i, s in score.items()), reverse=True)[:10]
    assert scored < 0.1 * len(score)


@pytest.mark.parametrize("name", ["op11_wand_search", "op13_exact_dedup"])
def test_query_matches_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, DATA)
    cur = oracle.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(cur.fetchall(), names)


def folded(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("heavy", [1000, 2])
def test_copies_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(exact, "HEAVY", heavy)
    long = "lorem ipsum " * 9000
    texts = ["a", "A", "b", "É", "é", None, "", "Hello World", "hello world", "x" * 300 + "1", "x" * 300 + "2", "X" * 300 + "1", long, long.upper(), long + "!"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (None, "q"), (None, "q"), (3, "twice"), (3, "twice"), (2, "Twice")] + [(100 + i, "Many") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns({"row": F.lit(1), "full": F.lit("f"), "n": F.lit(0)})
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[folded(t)].append(i)
    got = exact.deduplicated(df).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    stay = [r for r in got if r.kept]
    assert len(stay) == len(groups) and all(r.doc_id == r.keep_id for r in stay)
    kept = exact.without_copies(df)
    assert kept.columns == df.columns and collections.Counter(folded(r.text) for r in kept.collect()) == collections.Counter(groups.keys())
    alone = exact.classes(df).where("group_size = 1").collect()
    assert all(r.digest is None for r in alone if r.doc_id in (2, 4))
    assert exact.deduplicated(df.limit(0)).count() == 0 and exact.without_copies(df.limit(0)).count() == 0


def test_refinement_runs_no_python_and_collects_nothing_whole(spark):
    df = exact.deduplicated(spark.read.parquet(f"{SMALL}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", plan)


def whitened_by_numpy(x):
    n, s = len(x), x.sum(axis=0)
    v = (x - s / n).T @ (x - s / n) / n
    e, u = np.linalg.eigh(v)
    return n, s, e[::-1], u[:, ::-1], np.trace(v)


@pytest.mark.parametrize("table", [f"{SMALL}/embeddings.parquet", None])
def test_whitening_against_numpy(spark, table):
    if table:
        df = spark.read.parquet(table)
    else:
        rng = np.random.default_rng(3)
        v = rng.normal(size=(200, 9)) @ np.diag(10.0 ** -np.linspace(0, 3, 9)) @ rng.normal(size=(9, 9)) * 3e2
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    rows = df.collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64) + 1_000_000
    n, s, e, u, trace = whitened_by_numpy(x)
    got = whitening.whitened(df).collect()
    k = min(32, x.shape[1])
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    deviation = {r.vec_id: int(d) for r, d in zip(rows, ((n * x - s).astype(object) ** 2).sum(axis=1), strict=True)}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    assert max(r.identity_error for r in got) < 1e-6
    want = (x - s / n) @ (u[:, :k] / np.sqrt(e[:k]))
    place = {r.vec_id: i for i, r in enumerate(rows)}
    y = np.zeros((n, k))
    for r in got:
        y[place[r.vec_id], r.component - 1] = r.whitened
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-6)
    sign = np.sign((y * want).sum(axis=0))
    assert np.allclose(y * sign, want, atol=1e-4)


def test_rotations_find_small_eigenvalues():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 40):
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        scale = 10.0 ** -rng.integers(0, 12, n)
        b = q @ np.diag(rng.uniform(1, 2, n)) @ q.T
        v = np.outer(scale, scale) * (b + b.T) / 2  # graded, well conditioned after scaling
        e, u = whitening.jacobi(v)
        assert np.all(np.diff(e) <= 0) and np.allclose(u.T @ u, np.eye(n), atol=1e-12)
        assert np.all(np.abs(v @ u - u * e).max(axis=0) <= 1e-13 * np.abs(v).max())
        back = np.linalg.inv(np.diag(scale)) @ (u * e) @ u.T @ np.linalg.inv(np.diag(scale))
        assert np.allclose(back, (b + b.T) / 2, atol=1e-3)
    assert all(len(set(p.tolist() + q.tolist())) == 2 * len(p) for p, q in whitening.rounds(7))
    assert sorted((int(a), int(b)) for p, q in whitening.rounds(7) for a, b in zip(p, q, strict=True)) == [(a, b) for a in range(7) for b in range(a + 1, 7)]


def test_whitening_of_odd_vectors(spark):
    nan = float("nan")
    vectors = [[1.0, 2.0], [3.0, 5.0], [2.0, 2.5], [0.5, 9.0], None, [nan, 1.0], [1.0, None], [float("inf"), 0.0], [], [4.0], [5.0], [7.5]]
    rows = [(i if i else None, v) for i, v in enumerate(vectors)] + [(1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "component": F.lit(0)})
    got = whitening.whitened(df).collect()
    assert collections.Counter((r.vec_id, r.n) for r in got) == {(None, 5): 2, (1, 5): 4, (2, 5): 2, (3, 5): 2, (9, 3): 1, (10, 3): 1, (11, 3): 1}
    assert all(r.identity_error < 1e-9 and 0 < r.explained <= 1 + 1e-12 for r in got)
    assert whitening.whitened(df.limit(0)).count() == 0
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whitened(alike).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.deviation is None) for r in whitening.whitened(huge).collect()} == {(0, True), (1, True), (2, False)}


@pytest.mark.parametrize("largest", [10, 10**6, 10**9, 2**41])
def test_sums_are_exact(largest):
    rng = np.random.default_rng(5)
    x = rng.integers(-largest, largest, (50, 3), dtype=np.int64)
    got = whitening._Sum((3, 3))
    got.add(whitening._products(x[:20]))
    got.add(whitening._products(x[20:]))
    assert got.numbers() == (x.astype(object).T @ x.astype(object)).tolist()
