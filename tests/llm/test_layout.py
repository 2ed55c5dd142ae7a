import collections
import math
import zlib

import numpy as np
import pytest
from conftest import DATA, SMALL
from pyspark.sql import functions as F

from sluice.llm import hilbert, mixing, queries, warc


def test_curve_visits_neighbours(spark):
    for bits in (1, 2, 4):
        n = 1 << bits
        cells = spark.range(n**3).select(F.floor(F.col("id") / (n * n)).alias("x"), (F.floor(F.col("id") / n) % n).alias("y"), (F.col("id") % n).alias("z"))
        at = sorted((r.h, (r.x, r.y, r.z)) for r in hilbert.along(cells, ["x", "y", "z"], bits).collect())
        assert [h for h, _ in at] == list(range(n**3))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(at, at[1:], strict=False))


def test_a_filter_opens_few_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = hilbert.assign(docs, keep=("lang", "source"))
    ends = rows.groupBy("shard").agg(*(f(c).alias(f"{n}_{c}") for c in ("kept_lang", "kept_source", "size") for n, f in (("low", F.min), ("high", F.max)))).collect()
    opened = lambda c, v: sum(r[f"low_{c}"] <= v <= r[f"high_{c}"] for r in ends)
    langs = [r.lang for r in docs.select("lang").distinct().collect()]
    for v in langs:  # just those that hold it
        assert opened("kept_lang", v) == rows.where(F.col("kept_lang") == v).select("shard").distinct().count()
    sources = [r.source for r in docs.select("source").distinct().collect()]
    assert sum(opened("kept_source", v) for v in sources) / len(sources) <= 8
    sizes = rows.approxQuantile("size", [0.02, 0.25, 0.5, 0.75, 0.98], 0.001)
    assert sum(opened("size", v) for v in sizes) / len(sizes) <= 8


def test_steps_keep_order(spark):
    values = [None, "", "a", "ab", "src0", "src1", "src10", "srd", "é", "zz"]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("k", hilbert.ordered(F.col("v")))
    got = [(r.k, r.v) for r in df.collect()]
    assert [v for _, v in sorted(got, key=lambda x: x[0].encode())] == [None, *sorted(values[1:], key=str.encode)]
    steps = {r.v: r.s for r in df.withColumn("s", hilbert._step(F.col("k"), hilbert._string_cuts(df, "k"))).collect()}
    assert [steps[v] for v in [None, *sorted(values[1:], key=str.encode)]] == sorted(set(steps.values())) and len(set(steps.values())) == 10


def test_string_cuts_are_quantiles_of_all_values(spark):
    """More values than ever came to the driver: the cuts are those of all, not of some."""
    values = [f"x{i**2:09d}" for i in range(20_005)]
    df = spark.createDataFrame([(v,) for v in values + values[:100]], "k string").repartition(5)
    n = len(values)
    assert hilbert._string_cuts(df, "k") == [values[-(-i * n // 32) - 1] for i in range(1, 32)]
    assert hilbert._string_cuts(df.limit(0), "k") == []


def test_an_odd_name_opens_no_more_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").drop("text").withColumn("text", F.lit(None).cast("string"))
    docs = docs.withColumn("source", F.concat(F.lit("common-crawl-2021-"), "source"))
    odd = docs.limit(1).withColumn("source", F.lit("a"))

    def opened(df):
        rows = hilbert.assign(df, keep=("source",))
        ends = rows.groupBy("shard").agg(F.min("kept_source").alias("low"), F.max("kept_source").alias("high")).collect()
        names = [r.source for r in docs.select("source").distinct().collect()]
        return sum(r.low <= n <= r.high for r in ends for n in names) / len(names)

    plain = opened(docs)
    assert plain <= 8 and opened(docs.unionByName(odd)) <= plain + 1


def test_equal_rows_go_to_several_tasks(spark):
    alike = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows = hilbert.assign(alike, part=20).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [31] * 12 + [32] * 4 and all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("part", [100_000, 3])
def test_shards_against_brute_force(spark, part):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = hilbert.assign(docs, part=part).collect()
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size and {r.doc_id: r.text_crc32 for r in rows} == crc
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert all(a.h <= b.h for a, b in zip(order, order[1:], strict=False))


def test_shards_of_odd_rows(spark, tmp_path):
    one = (1, "same", "en", "s", "mine")
    df = spark.createDataFrame([one] * 20 + [(None, None, None, None, None), (2, "", "", "", "")], "doc_id long, text string, lang string, source string, shard string")
    rows = hilbert.sharded(df).collect()
    assert len(rows) == 22 and {r.law for r in rows} == {"rows"} and all(r.grown_shard is None for r in rows)
    assert sorted(collections.Counter(r.shard for r in rows).values()) == [1] * 10 + [2] * 6
    assert hilbert.sharded(df.limit(0)).collect() == []
    alike = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    assert collections.Counter(collections.Counter(r.shard for r in hilbert.sharded(alike).collect()).values()) == {3: 8, 2: 8}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    hilbert.write(docs, str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    named = df.withColumn("slot", F.lit(7))
    assert hilbert.write(named, str(tmp_path / "n")) == "shard_"
    assert spark.read.parquet(str(tmp_path / "n")).select(*named.columns).exceptAll(named).count() == 0


def test_mixing_matches_targets(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    classifier = mixing.train(docs, labels)
    rows = mixing.fit(docs, classifier, mixing.WEIGHTS).collect()
    total = sum(r.tokens for r in rows)
    assert {r.miss for r in rows} == {rows[0].miss} and rows[0].miss < 1e-6
    for d in classifier.domains:
        assert sum(r.tokens * r[f"p_{d}"] * r.rate for r in rows) / total == pytest.approx(mixing.WEIGHTS[d], rel=1e-5)
        # what is taken differs from that by rounding to whole copies alone
        spread = math.sqrt(sum((r.tokens * r[f"p_{d}"]) ** 2 * (r.rate % 1) * (1 - r.rate % 1) for r in rows))
        assert abs(sum(r.tokens * r[f"p_{d}"] * (r.copies - r.rate) for r in rows)) < 4 * spread
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    assert all(abs(sum(r[f"p_{d}"] for d in classifier.domains) - 1) < 1e-9 for r in rows)
    truth = {r.doc_id: f"q{r.quality}t{r.toxic}" for r in labels.collect()}
    assert sum(max(classifier.domains, key=lambda d: r[f"p_{d}"]) == truth[r.doc_id] for r in rows if r.doc_id in truth) / len(truth) > 0.8


def test_mixing_by_the_plain_rule(spark):
    """The same projected gradients, unscaled and with many small steps, on one array."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    c = mixing.train(docs, labels)
    rows = mixing.fit(docs, c, mixing.WEIGHTS).collect()
    p, t = np.array([[r[f"p_{d}"] for d in c.domains] for r in rows]), np.array([r.tokens for r in rows])
    w = t / t.sum()
    goal = np.array([mixing.WEIGHTS[d] for d in c.domains])
    shift = np.zeros(len(goal))
    for _ in range(200_000):
        miss = (w * np.maximum(0, 1 + p @ shift)) @ p - goal
        if np.abs(miss).max() < 1e-9:
            break
        shift -= miss
    assert np.allclose(np.maximum(0, 1 + p @ shift), [x.rate for x in rows], atol=1e-3)


def test_mixing_says_what_it_misses(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    with pytest.warns(UserWarning, match="misses its target"):
        rows = mixing.fit(docs, mixing.train(docs, labels), {"q0t1": 1.0}, high=1.0).collect()
    assert rows[0].miss > 0.01 and all(0 <= r.rate <= 1 for r in rows)


def test_mixing_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "a b"), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, none).collect()
    assert len(out) == 4 and all(r.p_all == 1.0 for r in out)
    assert mixing.mixed(docs.limit(0), none).count() == 0
    kept = mixing.fit(docs, mixing.train(docs, none), {}, carry=("text",)).collect()
    assert {r.kept_text for r in kept} == {None, "", "a b"}


def test_mixing_runs_no_python(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    for df in (mixing.mixed(docs, labels), hilbert.sharded(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_archives(spark):
    rows = [(1, "http://a/ b", None), (2, None, ""), (3, "u", "x" * 150), (4, "u", "x" * 150), (4, "u", "x" * 150), (3, "v", "x" * 150), (None, "n", "x" * 150), (7, "q", "é" * 50000), (8, "q", "ab\r\n\r\nc" * 1000), (9, "", "y" * 99), (10, "", "y" * 99)]
    p = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, chunk string")
    archives = warc.write(p, chunk=1000)
    chunks = warc.read(archives, chunk=700)
    last = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in chunks.where("payload_digest is not null").collect())
    assert last == [(0, "revisit", 3, 150), (1, "response", None, 0), (2, "response", None, 0), (3, "response", None, 150), (3, "response", None, 150), (4, "revisit", 3, 150), (4, "revisit", 3, 150), (7, "response", None, 100000), (8, "response", None, 7000), (9, "response", None, 99), (10, "response", None, 99)]
    for i, html in ((7, "é" * 50000), (8, "ab\r\n\r\nc" * 1000)):
        parts = sorted((r.chunk, bytes(r.data)) for r in chunks.where(F.col("page_id") == i).collect())
        assert b"".join(d for _, d in parts).decode() == html and max(len(d) for _, d in parts) <= 700 and len(parts) > 1
    assert warc.round_trip(p.limit(0)).collect() == []


def test_archives_that_are_cut_or_altered(spark, tmp_path):
    import io

    p = spark.createDataFrame([(1, "u", "hello " * 400)], "page_id long, url string, html string")
    path = warc.write(p, f"file://{tmp_path}").first().path
    raw = open(path.removeprefix("file://"), "rb").read()
    assert len(list(warc.records(io.BytesIO(raw)))) == 1
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records(io.BytesIO(raw[:-40])))
    import gzip

    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(gzip.compress(gzip.decompress(raw).replace(b"hello", b"hullo", 1)))))


def test_queries_have_their_columns(spark):
    want = {"op4_warc_chunks": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op8_hilbert_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SMALL).columns[: len(columns)] == columns
