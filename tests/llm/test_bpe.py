import hashlib
import random

import pytest
import tiktoken
from conftest import SMALL

from sluice.llm import bpe, queries

WANT = {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.ranks(bpe.default_vocabulary()), special_tokens={})


def test_query_against_the_library(spark, encoder):
    out = queries.QUERIES["op2_bpe"](spark, SMALL)
    assert dict(out.dtypes) == WANT
    got = {r.doc_id: r for r in out.collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = encoder.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk", [1, 50, 10**6])
def test_any_text_and_chunk(spark, encoder, chunk):
    rng = random.Random(3)
    pool = "ab zé  \t\n\r\x0b\x1c\x85\xa0 'sll'VE12½漢字🙂_.,!?-"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(150)] + ["", None, "x" * 50_000, " " * 3000, "the the the"]
    df = spark.createDataFrame([(i // 2, t, "own") for i, t in enumerate(texts)] + [(None, "no id", "own")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, chunk_chars=chunk)).collect()
    want = sorted((i if i is None else i, tuple(encoder.encode_ordinary(t or ""))) for i, t in [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    assert sorted((r.doc_id, tuple(r.ids)) for r in rows if r.doc_id is not None) == want
    assert [bytes(r.decoded) for r in rows if r.doc_id is None] == [b"no id"]
    assert all(bytes(r.decoded).decode() == encoder.decode(list(r.ids)) for r in rows)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df).collect() == []
    ids = spark.createDataFrame([(1, None), (2, []), (3, [5, 6])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(ids).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and len(got[3]) == 2
