import collections
import hashlib

import corpus_pipeline as pipeline
import pytest
import tiktoken
from conftest import DATA
from pyspark.sql import functions as F

from sluice import staging
from sluice.llm import bpe, jaccard, pii, quality


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, f in pipeline.STAGES:
        out.append(staging.stage(f(spark, out[-1], DATA), name.replace(" ", "-")))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near duplicates", "personal data", "mixing", "tokens"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_good_and_drops_bad(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.doc_id for r in stages[1].collect()}
    rows = labels.collect()
    assert sum(r.doc_id in kept for r in rows if r.quality) / sum(r.quality for r in rows) > 0.98
    assert sum(r.doc_id in kept for r in rows if not r.quality) / sum(1 - r.quality for r in rows) < 0.05
    model = quality.train(stages[0], labels, threshold=pipeline.THRESHOLD)
    docs = stages[0].collect()
    assert kept == {r.doc_id for r, s in zip(docs, model.score([r.text for r in docs]), strict=True) if s >= pipeline.THRESHOLD}


def test_one_document_of_each_group_stays(spark, stages):
    found = jaccard.join(stages[1]).collect()
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(r.doc_id for r in found if r.doc_id == r.component_id)


def test_personal_data_goes(stages):
    model = pii.fit()
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    changed = 0
    for i, r in after.items():
        base, added = model.find(before[i].text)
        if not base and not added:
            assert r.text == before[i].text
        changed += r.text != before[i].text
        assert r.n_chars == len(r.text) and not model.find(r.text)[0]
    assert changed > 10


def test_mixture_only_takes_whole_documents(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = stages[4].collect()
    assert all(before[r.doc_id] == r for r in after) and len({r.doc_id for r in after}) == len(after) > 0.9 * len(before)


def test_tokens(stages):
    e = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.ranks(bpe.default_vocabulary()), special_tokens={})
    docs = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows[:200]:
        assert list(r.ids) == e.encode_ordinary(docs[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_repeated_and_odd_rows(spark):
    text = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None), (4, "")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    out = pipeline.near_duplicates(spark, docs, DATA).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "3", "4", "None"]
    assert pipeline.without_personal_data(spark, docs, DATA).count() == 6
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_stages_on_nulls_repeats_and_clashing_names(spark):
    good = "The first of the plain lines, as they are written here. " * 8
    rows = [(1, good, "p"), (1, good + "More of it.", "q"), (2, None, None), (3, "", "p"), (None, good.upper(), "p"), (4, good * 400, "p"), (4, good * 400, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "copies": F.lit(7), "score": F.lit("x")})
    model = quality.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"), threshold=pipeline.THRESHOLD)
    kept = quality.kept(docs, model, pipeline.THRESHOLD)
    want = [r for r in docs.collect() if model.score([r.text])[0] >= pipeline.THRESHOLD]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want))
    near = pipeline.near_duplicates(spark, docs, DATA)
    assert near.columns == docs.columns and sorted(str(r.doc_id) for r in near.collect()) == ["1", "2", "3", "None"]
    assert [r.rate for r in near.collect() if r.doc_id == 1] == ["p"]
    redacted = pipeline.without_personal_data(spark, docs, DATA)
    assert redacted.columns == docs.columns and sorted(map(str, redacted.collect())) == sorted(map(str, docs.collect()))
    mixed = pipeline.mix(spark, docs, DATA)
    assert mixed.columns == docs.columns and {str(r) for r in mixed.collect()} <= {str(r) for r in docs.collect()}
    assert pipeline.tokens(spark, docs, DATA).count() == docs.count()


def test_near_duplicates_against_brute_force(spark, stages):
    """Groups by plain sets of word shingles, over all pairs that share one."""
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in stages[1].collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in texts.items()}
    having = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    common = collections.Counter((a, b) for v in having.values() for a in v for b in v if a < b)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i in up if root(i) == i)


def test_run(spark, stages):
    rows = pipeline.run(spark, DATA)
    assert rows.select("doc_id", "ids_sha256").exceptAll(stages[5].select("doc_id", "ids_sha256")).count() == 0
