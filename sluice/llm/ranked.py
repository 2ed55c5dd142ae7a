"""Ranked lexical search of a stated set of items over all documents: WAND in every shard, shards' heaps merged.

1. The items' terms are the vocabulary. One pass over the texts cuts them into terms and writes shards of documents: for
   each term of the vocabulary the documents that hold it with the number of its occurrences, and every document's length.
   Shards have a bounded number of documents and postings.
2. Documents, lengths and documents of a term are added up over all shards; they give the terms' weights.
3. In each shard every posting gets its impact, the part of the score that the term gives this document, and every term
   its largest one. An item's lists are walked in step: the pivot is the first document at which the largest impacts of
   the lists that begin before or at it add up to the score that the heap's last document has. What lies before the
   pivot can't enter the heap and is skipped; a pivot at which all these lists stand is scored. A task takes its heaps from
   shard to shard; in a shard no list's k-th impact lies above the k-th score, which is where an empty heap starts from.
4. Heaps of all tasks are merged, in two steps, so that no task gets those of all.

A document's score for an item is the sum over the item's terms of weight * ((1000000000 * tf) div (1000 * tf + 20 * m)), with
m = 50 + (50 * length * documents) div total length and the weight floor(1000 ln((2 documents + 2) / (2 df + 1))).
Terms are runs of ASCII letters and digits and of all that isn't ASCII, A-Z in lower case. Texts that are null or have no
term count nowhere. Ties go to the smaller id, null ids last; documents with the same or a null id are ranked each by itself. Equal rows of
items are one item; rows with the same id and another text are answered each by itself. Very long texts are cut into
terms in steps of bounded size, very many items are searched in blocks. Empty tables give an empty one; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import collections
import heapq
import itertools
import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions.arrow import tidy

#: Items and bytes of their texts that are searched at a time; documents and postings of a shard at most; bytes of a text that are cut at a time.
BLOCK, BLOCK_BYTES, SHARD, POSTINGS, STEP = 20_000, 32_000_000, 1 << 14, 1 << 20, 1 << 20
#: Buckets that tasks' heaps are merged in first.
BUCKETS = 64
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LAST = 1 << 62


def terms(text: bytes):
    """Lists of a text's terms, in order, each of a bounded part of it."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + STEP) if at + STEP < len(text) else None
        to = cut.start() if cut else len(text)
        yield _TERM.findall(text[at:to].lower())
        at = to


_SHARD = "shard long, ids binary, known binary, lengths binary, terms binary, ends binary, docs binary, tf binary"
_SHARD_TYPE = pa.schema([("shard", pa.int64())] + [(n, pa.binary()) for n in ("ids", "known", "lengths", "terms", "ends", "docs", "tf")])


def _shard(number: int, ids: list, lengths: list[int], docs: list[np.ndarray], found: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    """Documents in the order of their ids (null ones last), postings by term and then by document; times: occurrences."""
    known = np.array([i is not None for i in ids], bool)
    plain = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.lexsort((plain, ~known))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc, term, n = (np.concatenate([np.empty(0, np.int64), *x]) for x in (docs, found, times))
    key, which = np.unique(term * len(ids) + place[doc], return_inverse=True)
    tf = np.bincount(which, weights=n, minlength=len(key))
    term, doc = np.divmod(key, len(ids))
    some, first = np.unique(term, return_index=True)
    ends = np.append(first, len(term))[1:]
    columns = [plain[order].astype("<i8"), known[order], np.array(lengths, "<i8")[order], some.astype("<i4"), ends.astype("<i4"), doc.astype("<i4"), tf.astype("<i8")]
    return pa.record_batch([pa.array([number], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], schema=_SHARD_TYPE)


def _index(vocabulary):
    """(doc_id, text) to shards over the broadcast vocabulary {term: number}."""

    @tidy
    def run(batches):
        number_of = vocabulary.value.get
        made = TaskContext.get().partitionId() << 32
        ids, lengths, docs, found, times, held = [], [], [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                n, counts = 0, collections.Counter()
                for words in terms(text.as_py() or b""):
                    n += len(words)
                    counts.update(t for t in map(number_of, words) if t is not None)
                if not n:
                    continue
                if counts:
                    docs.append(np.full(len(counts), len(ids)))
                    found.append(np.fromiter(counts.keys(), np.int64, len(counts)))
                    times.append(np.fromiter(counts.values(), np.int64, len(counts)))
                    held += len(counts)
                ids.append(i)
                lengths.append(n)
                if len(ids) >= SHARD or held >= POSTINGS:
                    yield _shard(made, ids, lengths, docs, found, times)
                    made += 1
                    ids, lengths, docs, found, times, held = [], [], [], [], [], 0
        if ids:
            yield _shard(made, ids, lengths, docs, found, times)

    return run


_COUNTS = pa.schema([("term", pa.int32()), ("n", pa.int64())])


@tidy
def _counted(batches):
    """Shards to (term, number of documents that hold it); term -1: of all documents, -2: their length."""
    counts: dict[int, int] = {}
    for batch in batches:
        for lengths, some, ends in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            lengths = np.frombuffer(lengths, "<i8")
            per = np.diff(np.frombuffer(ends, "<i4"), prepend=0)
            for t, n in itertools.chain(((-1, len(lengths)), (-2, int(lengths.sum()))), zip(np.frombuffer(some, "<i4").tolist(), per.tolist(), strict=True)):
                counts[t] = counts.get(t, 0) + n
    if counts:
        yield pa.record_batch([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTS)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, w: int, n: int, total: int) -> np.ndarray:
    """What a term of weight w gives documents in which it occurs tf times, of so many terms."""
    m = 50 + (50 * lengths * n) // total
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def wand(lists: list[tuple[list[int], list[int], int]], k: int, heap: list, entry, least: int = 1) -> int:
    """Puts the k documents of the highest sums into a heap and gives the number of documents that were scored.

    lists: for each term its documents, rising, with _LAST at the end, their impacts, and the largest of these. entry makes
    the heap's entry, that compares like its place in the ranking, of a score and a document. No document with a sum
    below least is needed.
    """
    at = [0] * len(lists)
    now = [docs[0] for docs, _, _ in lists]
    top = [most for _, _, most in lists]
    order = sorted(range(len(lists)), key=now.__getitem__)
    scored = 0
    while True:
        need = max(least, heap[0][0]) if len(heap) == k else least
        bound, pivot, before = 0, _LAST, 0
        for before, t in enumerate(order):
            bound += top[t]
            if bound >= need:
                pivot = now[t]
                break
        if pivot == _LAST:
            return scored
        if now[order[0]] == pivot:  # all lists up to the pivot stand at it
            score = moved = 0
            for t in order:
                if now[t] != pivot:
                    break
                docs, gives, _ = lists[t]
                score += gives[at[t]]
                at[t] += 1
                now[t] = docs[at[t]]
                moved += 1
            scored += 1
            if score >= need:
                new = entry(score, pivot)
                if len(heap) < k:
                    heapq.heappush(heap, new)
                elif new > heap[0]:
                    heapq.heapreplace(heap, new)
        else:  # documents before the pivot can't reach what is needed
            for t in order[:before]:
                if now[t] < pivot:
                    docs = lists[t][0]
                    at[t] = bisect_left(docs, pivot, at[t])
                    now[t] = docs[at[t]]
        order.sort(key=now.__getitem__)


class _Shard:
    """A shard's postings with impacts; lists are made when an item asks for them, and kept."""

    def __init__(self, columns, weights: dict[int, int], n: int, total: int, k: int):
        kinds = ("<i8", "?", "<i8", "<i4", "<i4", "<i4", "<i8")
        self.ids, self.known, lengths, some, ends, self.docs, tf = (np.frombuffer(c, kind) for c, kind in zip(columns, kinds, strict=True))
        starts = ends - np.diff(ends, prepend=0)
        self.of = {t: (int(a), int(b)) for t, a, b in zip(some.tolist(), starts, ends, strict=True)}
        w = np.repeat(np.array([weights[t] for t in some.tolist()], np.int64), ends - starts)
        self.impacts = impacts(tf, lengths[self.docs], w, n, total)
        self.k, self.made = k, {}

    def list_of(self, t: int):
        """(documents, impacts, largest, k-th largest or 0) of a term, None without any impact."""
        if t not in self.made:
            a, b = self.of.get(t, (0, 0))
            gives = self.impacts[a:b]
            if not len(gives) or not gives.max():
                self.made[t] = None
            else:
                kth = int(np.partition(gives, len(gives) - self.k)[len(gives) - self.k]) if len(gives) >= self.k else 0
                self.made[t] = ([*self.docs[a:b].tolist(), _LAST], gives.tolist(), int(gives.max()), kth)
        return self.made[t]


def _search(asked, weights, n: int, total: int, k: int):
    """Shards to (item, score, doc_id), the k best of each item in a task; asked: broadcast lists of the items' terms."""

    @tidy
    def run(batches):
        heaps: list[list] = [[] for _ in asked.value]
        for batch in batches:
            for columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = _Shard(columns[1:], weights.value, n, total, k)
                entry = lambda score, doc: (score, bool(shard.known[doc]), -int(shard.ids[doc]))  # noqa: B023, E731
                for item, own in enumerate(asked.value):
                    lists = [x for x in map(shard.list_of, own) if x]
                    if lists:
                        wand([x[:3] for x in lists], k, heaps[item], entry, max(1, *(x[3] for x in lists)))
        rows = [(item, score, -i if known else None) for item, heap in enumerate(heaps) for score, known, i in heap]
        for at in range(0, len(rows), 1 << 16):
            item, score, ids = zip(*rows[at : at + (1 << 16)], strict=True)
            yield pa.record_batch([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())], names=["item", "score", "doc_id"])

    return run


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searched(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, rank, doc_id, score) for (item_id, text) of one block."""
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    asked = [sorted({numbers.setdefault(t, len(numbers)) for part in terms((r.text or "").encode()) for t in part}) for r in items]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with staging.small_batches(spark):
        shards = staging.stage(own.mapInArrow(_index(spark.sparkContext.broadcast(numbers)), _SHARD), "postings")
    counts = shards.select("lengths", "terms", "ends").mapInArrow(_counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r.term: r.n for r in counts.collect()}  # a row for each term of the block's vocabulary, and two
    n, total = df.pop(-1, 0), df.pop(-2, 0)
    weights = {t: weight(n, of) for t, of in df.items()}
    send = spark.sparkContext.broadcast
    found = shards.mapInArrow(_search(send(asked), send(weights), n, total, k), "item int, score long, doc_id long")
    found = _best(found.withColumn("bucket", F.spark_partition_id() % BUCKETS), k, "item", "bucket").drop("rank")
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    return _best(found, k, "item").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item, all if there are fewer. A staged table."""
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    with staging.scope() as kept:
        asked = staging.stage(asked.withColumn("bytes", F.octet_length("text")), "items")
        size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        blocks = max(1, -(-2 * size.n // BLOCK), -(-2 * size.bytes // BLOCK_BYTES)) if size.n > BLOCK or size.bytes > BLOCK_BYTES else 1
        out = None
        for block in range(blocks):  # a bounded part of the items at a time
            mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text")
            one = staging.stage(_searched(docs, sorted(mine.collect(), key=lambda r: (r.item_id is None, r.item_id, r.text)), k, id_col, text_col), "found")
            out = one if out is None else out.unionByName(one)
            kept.append(one)
    return out
