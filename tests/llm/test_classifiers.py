import itertools
import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sluice.llm import crf, labelled, quality, queries, toxicity


def by_enumeration(u, moves):
    n = len(u)
    weight = {y: math.exp(sum(u[i] * y[i] for i in range(n)) + sum(moves[a][b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
    z = sum(weight.values())
    return [sum(w for y, w in weight.items() if y[i]) / z for i in range(n)], math.log(z)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([1, 5, 3, 5, 2])
    moves = rng.normal(size=(2, 2))
    flat = rng.normal(size=counts.sum())
    u, mask = crf.padded(flat, counts)
    p, pairs, logz = crf.forward_backward(u, counts, moves)
    want = [by_enumeration(u[i, :n], moves) for i, n in enumerate(counts)]
    assert np.allclose(p[mask], np.concatenate([w[0] for w in want])) and np.isclose(logz, sum(w[1] for w in want))
    assert np.isclose(pairs.sum(), (counts - 1).sum()) and not p[~mask].any()


def test_training_finds_a_chain():
    rng = np.random.default_rng(1)
    labels = np.repeat(rng.integers(0, 2, 300), 4)
    features = np.where(rng.random(1200) < 0.8, labels + 1, 2 - labels)[:, None]
    chain = crf.train(features, labels, np.full(300, 4), 3)
    u, mask = crf.padded(chain.scores(features), np.full(300, 4))
    p = crf.forward_backward(u, np.full(300, 4), chain.moves)[0]
    assert ((p[mask] > 0.5) == labels).mean() > 0.85
    assert chain.moves[0, 0] + chain.moves[1, 1] > chain.moves[0, 1] + chain.moves[1, 0]


@pytest.mark.parametrize(("name", "label", "n", "fold", "least"), [("op3_quality_crf", "quality", 5, 0, 0.95), ("op9_toxic_spans_crf", "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, name, label, n, fold, least):
    out = queries.QUERIES[name](spark, DATA)
    assert [c for c in out.columns[:4]] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").withColumn("fold", labelled.fold("doc_id", n)).collect()
    assert out.count() == 1000
    assert all(r.held_out == (r.fold == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in held) / len(held) >= least


def test_closed_runs_against_every_step():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = rng.integers(0, rng.choice([3, 10, 60]), rng.integers(1, 9))
        n, bias, moves = counts.sum(), rng.normal() * 3, rng.normal(size=(2, 2)) * rng.choice([0.3, 2])
        active = rng.random(n) < rng.choice([0, 0.1, 0.5, 1])
        u = np.where(active, bias + rng.normal(size=n) * 3, bias)
        padded, mask = crf.padded(u, counts)
        assert np.allclose(toxicity.marginals(u, active, counts, bias, moves), crf.forward_backward(padded, counts, moves)[0][mask], atol=1e-10)


def test_scores_are_those_of_the_whole_chain(spark):
    """Every score against a chain that takes every word of every document one by one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    k, w = len(model.forms), model.chain.weights
    for r in docs.limit(150).collect():
        words = [x.decode() for x in (r.text or "").encode().split()]
        found = [[model.forms[f] for f in toxicity._forms(toxicity._word(x)) if f in model.forms][: toxicity.WIDTH] for x in words]
        sums = [[sum(w[f + i * k] for f in x) for i in range(3)] for x in found]
        u = np.array([[model.chain.bias + s[0] + (sums[i - 1][1] if i else 0) + (sums[i + 1][2] if i + 1 < len(sums) else 0) for i, s in enumerate(sums)]])
        p = crf.forward_backward(u, np.array([len(words)]), model.chain.moves)[0][0] if words else np.empty(0)
        assert got[r.doc_id] == pytest.approx(float(model.score(model.aggregates(p, np.array([len(words)])))[0]), abs=1e-9)


def test_spans_are_the_offending_words(spark):
    rows = [(f"plain words here number {i}", 0) for i in range(60)] + [(f"you are an idiot! truly {i}", 1) for i in range(40)]
    model = toxicity.fit(rows)
    df = spark.createDataFrame([(1, "He is an Idiot, yes."), (2, "all plain"), (3, None), (4, ""), (4, "idiot idiot"), (None, "\x1cidiot\x85")], "doc_id long, text string")
    out = {(r.doc_id, i): r for i, r in enumerate(toxicity.score(df, model).collect())}
    got = [r for _, r in sorted(out.items(), key=lambda x: x[0][1])]
    cut = lambda r, t: [t[s.start : s.end] for s in r.spans]
    assert cut(got[0], "He is an Idiot, yes.") == ["Idiot"] and got[0].score > 0.3
    assert got[1].score < 0.3 and got[2].score < 0.3 and got[3].score < 0.3
    assert cut(got[4], "idiot idiot") == ["idiot idiot"] and cut(got[5], "\x1cidiot\x85") == ["idiot"]


def test_neighbours_matter_and_odd_texts():
    good = "A line of plain words, as they are written. More of it follows here."
    bad = "a | b | c | d | e | f | g"
    model = quality.fit([("\n".join([good] * 4), 1), ("\n".join([bad] * 4), 0)] * 40)
    p, counts, _ = model.lines([f"{bad}\n{bad}\n{good}\n{bad}", good])
    assert counts.tolist() == [4, 1] and p[0] < 0.5 < p[4]
    s = model.score([None, "", "\n\n\n", good * 2000, bad * 2000, b"\xff\xfe", good])
    assert ((0 <= s) & (s <= 1)).all() and s[0] == s[1] and s[3] > 0.3 > s[4] and s[6] > 0.3


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows in ([(1, 1, 1), (2, 1, 1)], [(1, None, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert quality.scored(docs, labels).count() == 2 and toxicity.scored(docs, labels).count() == 2
    assert quality.scored(docs.limit(0), labels).count() == 0 and toxicity.scored(docs.limit(0), labels).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("y"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = labelled.sample(docs, labels, "quality", F.lit(True), 7, 9)
    assert sorted(y for _, y in rows) == [0] * 9 + [1] * 7
    assert rows == labelled.sample(docs, labels, "quality", F.lit(True), 7, 9)
    twice = docs.unionByName(docs.withColumn("text", F.lit("u" * 60_000))).unionByName(docs)
    assert rows == labelled.sample(twice, labels, "quality", F.lit(True), 7, 9)
    fewer = labelled.sample(docs.where("doc_id >= 90"), labels, "quality", F.lit(True), 7, 9)  # ids that are drawn are those there are
    assert sorted(y for _, y in fewer) == [0] * 5 + [1] * 5
    with pytest.warns(UserWarning, match="quality = 1"):
        assert len(labelled.sample(docs.where("doc_id % 2 = 0"), labels, "quality", F.lit(True), 7, 9)) == 9


def test_windows_of_long_texts(spark):
    text = "".join(str(i % 10) for i in range(1003))
    df = spark.createDataFrame([(text,), ("short",), (None,)], "text string")
    got = [r[0] for r in df.select(labelled.windowed(F.col("text"), 100)).collect()]
    starts = [(1003 - 20) * i // 4 for i in range(5)]
    assert got == ["\n".join(text[s : s + 20] for s in starts), "short", ""]  # a null text is an empty one
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x" * 1000).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = labelled.sample(docs, labels, "toxic", F.lit(True), 30, 30, longest=500, total=4000)
    assert sorted(y for _, y in rows) == [0] * 4 + [1] * 4 and all(len(t) == 504 for t, _ in rows)


@pytest.mark.filterwarnings("ignore:no document")
def test_long_labelled_texts_teach_as_well(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    times = F.ceil(F.lit(60_000) / F.greatest(F.length("text"), F.lit(1))).cast("int")
    long = docs.join(labels.select("doc_id"), "doc_id").where("length(text) > 0").withColumn("text", F.repeat(F.concat("text", F.lit("\n")), times))
    assert long.agg(F.min(F.length("text"))).first()[0] >= 60_000
    for made, column, bad in ((quality.train(long, labels), "quality", 0), (toxicity.train(long, labels), "toxic", 1)):
        score = quality.score if column == "quality" else toxicity.score
        got = score(docs, made).join(labels, "doc_id").where(F.col(column).isNotNull())
        right = got.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col(column)).cast("double")), F.count_if(((F.col("score") >= 0.3).cast("int") == bad) & (F.col(column) == bad)) / F.count_if(F.col(column) == bad)).first()
        assert right[0] > 0.9 and right[1] > 0.6, (column, right)
