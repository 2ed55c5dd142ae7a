import collections
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA, SMALL, rows_of

from sluice.llm import components, jaccard, queries, topk, vecdup


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [200_000, 0])
@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, monkeypatch, kind, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(5)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 50)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "none": []}[kind]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == roots({x for e in real for x in e}, real)


def test_spanning_edges_connect_what_is_linked():
    rng = np.random.default_rng(2)
    for _ in range(50):
        m = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.choice([0.05, 0.2, 0.8])
        edges = components.spanning(m)
        all_edges = [(i, 100 + j) for i, j in zip(*np.nonzero(m), strict=True)]
        nodes = {int(x) for e in all_edges for x in e}
        assert all(m[i, j] for i, j in edges)
        assert roots(nodes, [(i, 100 + j) for i, j in edges]) == roots(nodes, [(int(a), int(b)) for a, b in all_edges])


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = collections.defaultdict(list)
    for i, t in rows:
        sets[i].append(shingles(t))
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    return roots(ids, edges)


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    common = " ".join(word() for _ in range(40))
    texts = ["", None, "one", "One", "two words", "a b c d", "A  b\tc\nd", "a b c d e", " ", "x y", "É é"]
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 30, 60, 120]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + common if rng.random() < 0.3 else ""))
            if rng.random() < 0.2:
                texts.append(texts[-1].upper() if rng.random() < 0.5 else texts[-1])
    return list(enumerate(texts))


@pytest.mark.parametrize(("short", "together", "common", "bits", "chunk"), [(32, 256, 10_000, 1 << 28, 2_000_000), (1, 4, 1, 0, 50), (3, 8, 4, 0, 700)])
def test_join_against_brute_force(spark, monkeypatch, short, together, common, bits, chunk):
    for name, value in {"SHORT": short, "TOGETHER": together, "COMMON": common, "MOST_BITS": bits, "CHUNK": chunk}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    want = brute(rows)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in rows}


@pytest.mark.parametrize("n", [31, 32, 33, 34, 90])
def test_lists_of_every_length(spark, n):
    """n texts that differ in one word each, at the end: all of them link, whether their lists count as short or long."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} x{i}") for i in range(n)] + [(1000 + i, f"u{i} " * 3 + f"v{i} y z q") for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < n else i for i, _ in rows}


@pytest.mark.parametrize("bits", [1 << 28, 0])
def test_first_of_each_with_clashing_names(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "MOST_BITS", bits)
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z"), (3, "d", "w")], "doc_id long, text string, _gone string")
    found = spark.createDataFrame([(1, 1), (2, 1), (None, None), (3, 3)], "doc_id long, component_id long")
    assert sorted(str(r.doc_id) for r in jaccard.first_of_each(docs, found).collect()) == ["1", "3", "None"]


def test_join_of_odd_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (5, "z y x w v u"), (None, text), (3, text), (9, "z y x w v u"), (7, None), (8, "q " * 30_000)]
    out = [tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out, key=str) == sorted([(5, 6, 3), (5, 2, 3), (None, 6, None), (3, 6, 3), (9, 2, 3), (7, 0, 7), (8, 1, 8)], key=str)
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name", ["op4_warc_chunks", "op6_segment_topk", "op7_vector_near_dedup", "op10_ngram_jaccard"])
def test_query_matches_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, DATA)
    got = rows_of(df.collect(), df.columns)
    cur = oracle.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns) and got == rows_of(cur.fetchall(), names)


def vectors(seed, n, d=12):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rng.normal(size=d)
        rows += [(base + rng.normal(size=d) * rng.choice([0.0, 0.03, 0.06, 0.3])).astype(np.float32).tolist() for _ in range(rng.integers(1, 6))]
    return [(i, v, int(i % 3) if i % 7 else None) for i, v in enumerate(rows)] + [(900, None, 1), (901, [0.0] * d, 1), (902, [float("nan")] * d, 1), (903, [1.0, None], 1), (904, [], 1), (905, [1.0] * 5, 1), (906, [2.0] * 5, 1)]


@pytest.mark.parametrize(("part", "deeper", "leaf"), [(4096, 100_000, 256), (3, 100_000, 4), (4096, 5, 1)])
def test_near_vectors_against_brute_force(spark, monkeypatch, part, deeper, leaf):
    monkeypatch.setattr(vecdup, "PART", part)
    monkeypatch.setattr(vecdup, "DEEPER", deeper)
    monkeypatch.setattr(vecdup, "LEAF", leaf)
    rows = vectors(4, 60) + vectors(4, 3)[:4]
    rows = rows[:-4] + [(2000 + i, v, label) for i, (_, v, label) in enumerate(rows[-4:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = lambda v: v and None not in v and np.isfinite(v).all() and np.any(v)
    edges, links = [], collections.Counter()
    for i, v, a in rows:
        for j, w, b in rows:
            if i != j and a is not None and a == b and fine(v) and fine(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    edges.append((i, j))
                    links[i] += 1
    want = roots([r[0] for r in rows], edges)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vecdup.near_duplicates(df).collect()}
    assert got == {i: (links[i], want[i], want[i] == i) for i in want} and len(edges) > 20
    assert vecdup.near_duplicates(df.limit(0)).collect() == []


def test_repeated_vectors(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(4, v, 1), (4, v, 1), (6, v, 1), (None, v, 1), (4, [-1.0, 0.0, 0.0], 2), (8, [-1.0, 0.0, 0.01], 2)], "vec_id long, embedding array<double>, label int")
    out = sorted(((r.vec_id, r.n_links, r.component_id) for r in vecdup.near_duplicates(df).collect()), key=str)
    assert out == sorted([(4, 3, 4), (4, 3, 4), (6, 3, 4), (None, 0, None), (4, 1, 4), (8, 1, 4)], key=str)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.concatenate([rng.normal(size=(150, 20)), np.repeat(rng.normal(size=(4, 20)), 10, axis=0)]))]
    rows += [(500, None), (550, [float("inf")] * 20), (600, [1.0] * 3), (650, [2.0] * 3), (None, [0.5] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = collections.defaultdict(list)
    for r in topk.search(df, df.where("vec_id % 50 = 0")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    fine = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and np.isfinite(v).all()]
    want = {}
    for q, x in fine:
        if q % 50 == 0:
            scored = sorted((-int(x @ y), i) for i, y in fine if i != q and len(y) == len(x))[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert topk.search(df.limit(0), df.limit(0)).collect() == []


def test_topk_broadcasts_no_blocks(spark):
    """Copies of blocks for each group went through the driver; here they are shuffled, whatever their size."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "vec_id long, embedding array<double>")
    plan = topk._searched(df, df.where("vec_id % 50 = 0"), 5, "vec_id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_grid_and_numbers_of_few_bytes():
    for rows, queries_, tasks in ((1, 1, 48), (124, 13, 48), (124, 13, 800), (5000, 100, 800), (0, 0, 8)):
        by_row, by_query = topk.grid(rows, queries_, tasks)
        assert 1 <= by_row <= max(1, rows) and 1 <= by_query <= max(1, queries_)
        assert by_row * by_query <= 2 * tasks
    for most in (0, 127, 128, 40_000, 2**40):
        x = np.array([[most, -most], [1, -1]])
        assert (topk._wide(topk._narrow(x), 2, 2) == x).all()


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(1)
    centers = rng.integers(-200, 200, size=(40, 64))
    x = np.concatenate([np.repeat(c, 64 // len(c)) + rng.integers(-3, 3, size=(50, 64)) for c in centers[:, :16]])
    q = x[::97]
    best = np.full(len(q), -np.inf)
    found, scored = topk.search_block(np.arange(len(q)) + 10**6, q, np.arange(1000), x[:1000], 5, best)
    more, scored_too = topk.search_block(np.arange(len(q)) + 10**6, q, np.arange(1000, len(x)), x[1000:], 5, best)
    assert scored + scored_too < 0.1 * len(q) * len(x)
    s = q @ x.T
    for i in range(len(q)):
        want = sorted((-int(v), j) for j, v in enumerate(s[i]))[:5]
        assert sorted((-sc, j) for n, j, sc in found + more if n == i)[:5] == want


def test_range_join_measures_few_distances():
    """The vectors of sf0.1: under 5 % of all pairs within labels get their distance in a block, and what is within is found."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    x = np.array(table["embedding"], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label, budget, measured, pairs = np.array(table["label"]), 0.04, 0, 0
    y = x @ vecdup._rotation(64)
    for k in np.unique(label):
        part = y[label == k]
        pairs += len(part) * (len(part) - 1)
        for cut, share in vecdup._blocks(64, budget):
            z = part[:, cut]
            i, j, n = vecdup._within(z, z, share)
            measured += n - len(z)
            d = ((z[:, None] - z[None]) ** 2).sum(2)
            assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*map(np.ndarray.tolist, np.nonzero(d <= share)), strict=True)}
    assert measured < 0.05 * pairs, measured / pairs


def test_small_queries_run(spark):
    assert queries.QUERIES["op10_ngram_jaccard"](spark, SMALL).count() == 200
