"""Similarity join of documents on word shingles: rare-first prefixes, length, position and suffix filters, one check a pair.

1. Every document gets its set size and a digest of its words; of documents with equal digests (a class) only the
   smallest id takes part in what follows.
2. A set that links with another shares at least threshold * size shingles with it. Half of all shingles (by hash) go
   to buckets, where those of one class only are found; a set with more of these than it may lack goes.
3. What stays is exploded: shingles' exact frequencies are counted and joined back, and the first of a set's shingles
   from rare to frequent (its prefix) are dealt out by shingle. Any two sets that are similar enough share one of these.
4. Short lists of classes that share a shingle give all their pairs that pass the filters. In long lists each class is
   paired with one leader. Pairs whose sets may still be similar, by how many shingles parts of the hash range hold in
   both (the suffix filter), are verified, each once, on the whole texts.
5. Long lists that overlap are a cluster; within it, those classes that aren't linked with the cluster's largest
   component yet are compared with all others of like size, in blocks that meet in one task and by one matrix product.
   Pairs aren't written out, and none that could join two components is left out; pairs within a component need no
   comparison.

Ids that are wanted again from the texts go into a bitmap of 16 bits for each id, up to a fixed size, which sifts the
texts where they are read; beyond that size the texts are joined.

Words are split at ASCII white space, A-Z in lower case. A document with fewer words than a shingle has one, its whole
sequence; null and empty texts have none and link with nothing. Rows with a null doc_id get their set size and no
component. Rows of the same doc_id count as linked. An empty table gives an empty one; very long texts are cut into
words in steps of bounded size. Other columns don't matter, whatever their names. Shingles and whole texts are told
apart by 64-bit hashes: among n different texts n * n / 2**65 pairs are expected to be taken for equal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions.arrow import tidy
from sluice.llm import components, shingles

#: Bits of a bitmap for each id, and bits that one has at most; beyond, rows are joined.
BITS_OF_ID, MOST_BITS, SLICES = 16, 1 << 28, 256
#: Shingles that a chunk of the first sieve holds about, and that one of its buckets does.
CHUNK, BUCKET = 2_000_000, 8_000_000
#: Classes in a list up to which all its pairs are candidates; classes of a block of a cluster about; frequency from which a shingle's list is dealt out by document too.
SHORT, TOGETHER, COMMON = 32, 256, 10_000
#: Parts of the hash range that the suffix filter counts shingles in; bytes of texts that are cut into words at a time.
PARTS, AT_A_TIME = 64, 1 << 20


def _at_least(x: float) -> int:
    """The least integer that isn't below x, for x a product with a threshold of a few decimals."""
    return math.ceil(x - 1e-9)


def needed(threshold: float, a: int, b: int) -> int:
    """Least number of common shingles of sets of these sizes."""
    return _at_least(threshold * (a + b) / (1 + threshold))


_PARTS = pa.schema([("slice", pa.int32()), ("part", pa.binary())])


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# --- sifting texts by id ----------------------------------------------------------------------------------------
def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (shingles.mixed(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(bits: int):
    @tidy
    def run(batches):
        found = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(found, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        parts = [(i, _pack(x.tobytes())) for i, x in enumerate(np.split(found, SLICES)) if x.any()]
        if parts:
            yield pa.record_batch([pa.array(c) for c in zip(*parts, strict=True)], schema=_PARTS)

    return run


@tidy
def _either(batches):
    """Slices of bitmaps to one for each number."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(_unpack(part), np.uint8)
            sums[i] = x if i not in sums else sums[i] | x
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([_pack(x.tobytes()) for x in sums.values()], pa.binary())], schema=_PARTS)


def _sifted(found: np.ndarray, place: int, inside: bool):
    """The rows whose id may be in a bitmap's set (null ids never are), or all others."""
    bits = len(found) << 3

    @tidy
    def run(batches):
        for batch in batches:
            known = batch.column(place).is_valid().to_numpy(zero_copy_only=False)
            at = _places(batch.column(place).cast(pa.int64()).fill_null(0).to_numpy(), bits)
            hit = known & ((found[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            yield batch.filter(pa.array(hit == inside))

    return run


def _table_of(ids: DataFrame) -> np.ndarray | None:
    """A bitmap of (a column of) ids of BITS_OF_ID bits for each; None if it were larger than MOST_BITS."""
    n = ids.count()
    bits = max(1 << 16, 1 << (BITS_OF_ID * n - 1).bit_length())
    if bits > MOST_BITS:
        return None
    out = np.zeros((SLICES, (bits >> 3) // SLICES), np.uint8)
    parts = ids.mapInArrow(_bitmap(bits), "slice int, part binary").repartition(min(SLICES, staging.partitions(ids.sparkSession)), "slice")
    for row in parts.mapInArrow(_either, "slice int, part binary").toLocalIterator():
        out[row.slice] = np.frombuffer(_unpack(bytes(row.part)), np.uint8)
    return out.reshape(-1)


def _those(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, ...) with an id of ids (doc_id), and few others: ids may be too many to be broadcast, texts too large to be dealt out."""
    found = _table_of(ids)
    if found is None:
        return docs.join(ids.distinct(), "doc_id", "left_semi")
    return docs.mapInArrow(_sifted(found, docs.columns.index("doc_id"), True), docs.schema)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the documents that found (what join() gives for docs) links with a smaller id."""
    name = "_gone"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    bits = _table_of(gone)
    if bits is None:
        return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
    place = docs.columns.index(id_col)
    stay = docs.mapInArrow(_sifted(bits, place, False), docs.schema)
    rest = docs.mapInArrow(_sifted(bits, place, True), docs.schema)
    return stay.unionByName(rest.join(gone, F.col(id_col) == F.col(name), "left_anti"))


# --- sets -------------------------------------------------------------------------------------------------------
def _survey(width: int):
    """(doc_id, text) to (doc_id, n, node); no node without words."""

    @tidy
    def run(batches):
        for batch in batches:
            for at, texts in shingles.batches_of(batch.column(1), AT_A_TIME):
                sets, nodes = shingles.sets(texts, width)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                yield pa.record_batch([batch.column(0).slice(at, len(n)), pa.array(n), pa.array(nodes.view(np.int64), mask=n == 0)], names=["doc_id", "n", "node"])

    return run


def _classes(batches, width: int):
    """(id, node, set) of each text with words and an id; of equal texts that one task meets the first stands for all."""
    seen: set[int] = set()
    for batch in batches:
        for at, texts in shingles.batches_of(batch.column(1), AT_A_TIME):
            sets, nodes = shingles.sets(texts, width)
            for i, node, s in zip(batch.column(0).slice(at, len(sets)).to_pylist(), nodes.view(np.int64).tolist(), sets, strict=True):
                if i is not None and len(s) and node not in seen:
                    seen.add(node)
                    yield i, node, s


_ASKED = "chunk long, bucket int, marks binary, docs binary"
_ASKED_TYPE = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("marks", pa.binary()), ("docs", pa.binary())])


def _asked(width: int, threshold: float, buckets: int, chunk: int):
    """Chunks of documents: a row with their ids and how many shingles each may lack (bucket -1), and one for each bucket.

    A bucket's row has the low 32 bits of those of the chunk's shingles that are in the lower half of the hash range:
    first those of several documents, then those of one document each in the order of the documents, whose numbers it has too.
    """

    @tidy
    def run(batches):
        made = TaskContext.get().partitionId() << 32
        ids, spare, sets, held = [], [], [], 0

        def flush():
            flat = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), list(map(len, sets)))
            order = np.argsort(flat, kind="stable")
            flat, doc = flat[order], doc[order]
            new = np.ones(len(flat), bool)
            new[1:] = flat[1:] != flat[:-1]
            first = np.flatnonzero(new)
            several = np.diff(np.append(first, len(flat))) > 1
            mark, doc = flat[first], np.where(several, -1, doc[first])
            bucket = ((mark >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            low, doc, bucket = mark[order].astype("<u4"), doc[order], bucket[order]
            bounds = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
            at = [slice(bounds[b], bounds[b + 1]) for b in full]
            rows = [[made] * (len(full) + 1), [-1, *full], [np.array(ids, "<i8").tobytes(), *(low[a].tobytes() for a in at)], [np.array(spare, "<i8").tobytes(), *(_pack(np.diff(doc[a], prepend=0).astype("<i4").tobytes()) for a in at)]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, _ASKED_TYPE, strict=True)], schema=_ASKED_TYPE)

        for i, _, s in _classes(batches, width):
            ids.append(i)
            spare.append(len(s) - _at_least(threshold * len(s)))
            sets.append(s[: np.searchsorted(s, np.uint64(1 << 63))])
            held += len(sets[-1])
            if held > chunk // 2:
                yield flush()
                made += 1
                ids, spare, sets, held = [], [], [], 0
        if ids:
            yield flush()

    return run


@tidy
def _lonely(batches):
    """Rows in the order of buckets to rows that count, for each document of a chunk, its shingles that nothing else in the bucket has."""

    def finish(rows):
        marks = [np.frombuffer(m, "<u4") for _, _, m, _ in rows]
        docs = [np.cumsum(np.frombuffer(_unpack(d), "<i4")) for _, _, _, d in rows]
        flat, alone = np.concatenate(marks), np.concatenate(docs) >= 0
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        same = flat[1:] == flat[:-1]
        met = np.zeros(len(flat), bool)
        met[1:] |= same
        met[:-1] |= same
        alone[order[met]] = False
        at = 0
        for (chunk, bucket, _, _), doc in zip(rows, docs, strict=True):
            mine = doc[alone[at : at + len(doc)]]
            at += len(doc)
            if len(mine):
                yield chunk, bucket, _pack(np.bincount(mine).astype("<u2" if len(mine) < 65536 else "<u4").tobytes()), b"" if len(mine) < 65536 else b"4"

    def out(rows):
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ASKED_TYPE, strict=True)], schema=_ASKED_TYPE)

    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[1] < 0:
                yield out([row])
                continue
            if row[1] != now:
                if rows and (counted := list(finish(rows))):
                    yield out(counted)
                now, rows = row[1], []
            rows.append(row)
    if rows and (counted := list(finish(rows))):
        yield out(counted)


@tidy
def _left(batches):
    """Rows in the order of chunk, bucket to the ids of documents that don't lack too much."""
    now, ids, spare = None, None, None

    def finish():
        return pa.record_batch([pa.array(ids[spare >= 0])], names=["doc_id"])

    for batch in batches:
        for chunk, _, marks, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk != now:
                if ids is not None:
                    yield finish()
                now, ids, spare = chunk, np.frombuffer(marks, "<i8"), np.frombuffer(docs, "<i8").copy()
            else:
                count = np.frombuffer(_unpack(marks), "<u4" if docs else "<u2")
                spare[: len(count)] -= count
    if ids is not None:
        yield finish()


def _exploded(width: int):
    """Texts to a row (tok, doc, n) for each shingle."""

    @tidy
    def run(batches):
        toks, docs, sizes, held = [], [], [], 0

        def out():
            return pa.record_batch([pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.repeat(np.array(docs, np.int64), sizes)), pa.array(np.repeat(np.array(sizes, np.int32), sizes))], names=["tok", "doc", "n"])

        for _, node, s in _classes(batches, width):
            toks.append(s)
            docs.append(node)
            sizes.append(len(s))
            held += len(s)
            if held > 200_000:
                yield out()
                toks, docs, sizes, held = [], [], [], 0
        if toks:
            yield out()

    return run


def _shared(threshold: float):
    """Rows in the order of tok, doc: of a short list all pairs (a, b) that pass the filters; of a long one its rows (tok, doc, at).

    Equal rows, of texts that several tasks met, count once. Common toks, which are dealt out by document too, are long.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tok", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])
    share, low = threshold / (1 + threshold), (1 << 32) - 1

    def pairs_of(docs, ats, found: set):
        for j in range(1, len(docs)):
            m, q, y = ats[j] >> 32, ats[j] & low, docs[j]
            for i in range(j):
                n, p = ats[i] >> 32, ats[i] & low
                least = math.ceil((n + m) * share - 1e-6)
                # by lengths; by what can follow in both after these places, and what can have come before
                if min(n, m) >= least and min(n - p, m - q) >= least - min(p, q):
                    x = docs[i]
                    found.add((x, y) if x < y else (y, x))

    @tidy
    def run(batches):
        now, docs, ats, long, found = None, [], [], False, set()

        def of_pairs():
            a, b = zip(*found, strict=True)
            found.clear()
            none = pa.nulls(len(a), pa.int64())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, none], schema=schema)

        def of_rows(tok):
            k = len(docs)
            return pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([tok] * k, pa.int64()), pa.array(docs, pa.int64()), pa.array(ats, pa.int64())], schema=schema)

        for batch in batches:
            for tok, doc, at, common in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tok != now:
                    if long and docs:
                        yield of_rows(now)
                    elif len(docs) > 1:
                        pairs_of(docs, ats, found)
                        if len(found) > 100_000:
                            yield of_pairs()
                    now, docs, ats, long = tok, [], [], common
                elif docs and docs[-1] == doc:
                    continue
                docs.append(doc)
                ats.append(at)
                if len(docs) > (4096 if long else SHORT):  # of a long list only so much is held
                    yield of_rows(now)
                    docs, ats, long = docs[-1:], ats[-1:], True
        if long and docs:
            yield of_rows(now)
        elif len(docs) > 1:
            pairs_of(docs, ats, found)
        if found:
            yield of_pairs()

    return run


def _texts(width: int):
    """Texts to (doc, n, parts, words): how many of its shingles each part of the hash range has, and the words."""

    @tidy
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at, texts in shingles.batches_of(batch.column(1), AT_A_TIME):
                sets, nodes = shingles.sets(texts, width)
                parts = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS).astype("<u4").tobytes() for s in sets]
                words = [pack(b" ".join((t.as_py() or b"").translate(shingles.FOLD).split())) for t in texts]
                yield pa.record_batch([pa.array(nodes.view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), pa.array(parts, pa.binary()), pa.array(words, pa.binary())], names=["doc", "n", "parts", "words"])

    return run


def _may_be(threshold: float):
    """Rows (a, b, a_parts, b_parts) to the pairs (a, b) whose sets may be similar by the numbers of shingles in each part of the hash range."""

    @tidy
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, PARTS).astype(np.int64) for i in (2, 3))
                least = np.ceil((x.sum(1) + y.sum(1)) * (threshold / (1 + threshold)) - 1e-6)
                hit = np.minimum(x, y).sum(1) >= least
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit))

    return run


def _sets_of(packed: list[bytes], width: int) -> list[np.ndarray]:
    return shingles.sets(pa.array([_unpack(w) for w in packed], pa.large_binary()), width)[0]


def _verified(width: int, threshold: float):
    """Rows (a, b, text of a, text of b) to the pairs (a, b) that are similar enough."""

    @tidy
    def run(batches):
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            both = list({*x, *y})
            of = dict(zip(both, _sets_of(both, width), strict=True))
            hit = [len(np.intersect1d(of[p], of[q], assume_unique=True)) >= needed(threshold, len(of[p]), len(of[q])) for p, q in zip(x, y, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit))

    return run


def _possible(threshold: float):
    """Length and position filters on two rows of a list, x and y."""
    n, m, i, j = (F.shiftright("x_at", 32), F.shiftright("y_at", 32), F.col("x_at").bitwiseAND(0xFFFFFFFF), F.col("y_at").bitwiseAND(0xFFFFFFFF))
    least = F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))
    return (F.least(n, m) >= least) & (F.least(n - i, m - j) >= least - F.least(i, j))


def _compared(width: int, threshold: float):
    """Rows (task, side, doc, words) in this order: all pairs between the sides, as edges that span what is linked."""

    def finish(sides):
        if not sides[0] or not sides[1]:
            return
        (p, x), (h, y) = (([d for d, _ in s], _sets_of([w for _, w in s], width)) for s in sides)
        common = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
        met = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, len(common), 16384):
            some = common[at : at + 16384]
            left, right = np.zeros((len(x), len(some)), np.float32), np.zeros((len(y), len(some)), np.float32)
            for m, group in ((left, x), (right, y)):
                for i, s in enumerate(group):
                    part = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], side="right")]
                    j = np.searchsorted(some, part)
                    m[i, j[some[np.minimum(j, len(some) - 1)] == part]] = 1
            met += left @ right.T
        total = np.array(list(map(len, x)))[:, None] + np.array(list(map(len, y)))[None, :]
        linked = met >= np.ceil(total * (threshold / (1 + threshold)) - 1e-9)
        linked &= np.array(p)[:, None] != np.array(h)[None, :]
        if edges := components.spanning(linked):
            yield pa.record_batch([pa.array([p[i] for i, _ in edges], pa.int64()), pa.array([h[j] for _, j in edges], pa.int64())], names=["a", "b"])

    @tidy
    def run(batches):
        now, sides = None, ([], [])
        for batch in batches:
            for task, side, doc, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != now:
                    yield from finish(sides)
                    now, sides = task, ([], [])
                sides[side].append((doc, words))
        yield from finish(sides)

    return run


def join(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs: the smallest doc_id that links reach. A staged table."""
    with staging.small_batches(docs.sparkSession), staging.scope() as kept:
        out = staging.stage(_joined(docs, threshold, width, id_col, text_col), "near")
        kept.append(out)
    return out


def _near_others(raw: DataFrame, reps: DataFrame, info: DataFrame, width: int, threshold: float, n_parts: int) -> DataFrame:
    """Ids of documents that may link with another one, by how many shingles they have that no other class has."""
    total = info.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(n_parts, total // 20_000), total // (2 * BUCKET))
    asked = _those(raw, reps.select(F.col("rep").alias("doc_id"))).mapInArrow(_asked(width, threshold, buckets, CHUNK), _ASKED)
    route = F.when(F.col("bucket") < 0, F.xxhash64("chunk")).otherwise(F.col("bucket"))
    counted = asked.repartition(n_parts, route).sortWithinPartitions("bucket").mapInArrow(_lonely, _ASKED)
    left = counted.repartition(n_parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_left, "doc_id long")
    return staging.stage(left.distinct(), "left")


def _prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """(tok, doc, n) of whole sets to (tok, doc, at, common): the shingles of prefixes that several sets have; at: set size and place.

    The order is by frequency, then by hash. Shingles of one set alone come first, and aren't written.
    """
    often = rows.groupBy("tok").agg(F.count("*").alias("often")).where("often > 1")
    w = Window.partitionBy("doc")
    placed = rows.join(often, "tok").withColumn("rank", F.dense_rank().over(w.orderBy("often", "tok"))).withColumn("met", F.max("rank").over(w))
    least = F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9))
    at = F.col("n") - F.col("met") + F.col("rank") - 1
    return placed.where((F.col("met") >= least) & (at <= F.col("n") - least)).select("tok", "doc", (F.shiftleft(F.col("n").cast("long"), 32) + at).alias("at"), (F.col("often") > COMMON).alias("common"))


def _joined(docs: DataFrame, threshold: float, width: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    n_parts = staging.partitions(spark)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    info = staging.stage(raw.mapInArrow(_survey(width), "doc_id long, n long, node long"), "shingles")
    # written before the join, whose side with a hot class can then be split
    reps = staging.stage(info.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")
    left = _near_others(raw, reps, info, width, threshold, n_parts)
    here = _those(raw, left).join(left, "doc_id", "left_semi").select("doc_id", "text")
    rows = staging.stage(here.mapInArrow(_exploded(width), "tok long, doc long, n int"), "sets")
    prefixes = _prefixes(rows, threshold)
    dealt = prefixes.repartition(n_parts, F.when(F.col("common"), F.xxhash64("tok", "doc")).otherwise(F.col("tok"))).sortWithinPartitions("tok", "doc")
    lists = staging.stage(dealt.mapInArrow(_shared(threshold), "a long, b long, tok long, doc long, at long"), "lists")
    long = lists.where("tok is not null").select("tok", "doc", "at")
    leads = staging.stage(long.groupBy("tok").agg(F.min(F.struct("doc", "at")).alias("lead")), "leads")
    led = _with_leads(long, leads).where("doc <> lead.doc")
    stars = staging.stage(led.select(F.col("lead.doc").alias("x"), F.col("lead.at").alias("x_at"), F.col("doc").alias("y"), F.col("at").alias("y_at")), "stars")
    met = lists.where("a is not null").select("a", "b").unionByName(stars.where(_possible(threshold)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    pairs = staging.stage(met.distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(stars.select(F.explode(F.array("x", "y")).alias("node"))).distinct()

    wanted = staging.stage(reps.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")), "wanted")
    texts = staging.stage(_those(raw, wanted).mapInArrow(_texts(width), "doc long, n long, parts binary, words binary"), "texts")
    a_parts, b_parts = (texts.select(F.col("doc").alias(k), F.col("parts").alias(f"{k}_parts")).dropDuplicates([k]) for k in ("a", "b"))
    near = pairs.join(a_parts, "a").join(b_parts, "b").select("a", "b", "a_parts", "b_parts").mapInArrow(_may_be(threshold), "a long, b long")
    near = staging.stage(near, "near-pairs")
    x, y = (texts.select(F.col("doc").alias(k), F.col("words").alias(f"{k}_words")) for k in ("a", "b"))
    both = near.join(y, "b").join(x, "a").select("a", "b", "a_words", "b_words")
    links = staging.stage(both.mapInArrow(_verified(width, threshold), "a long, b long"), "links")
    found = components.connected(links)
    if not stars.isEmpty():
        more = _across(spark, long, stars, texts, found, width, threshold)
        if not more.isEmpty():
            found = components.connected(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    # from classes to their smallest ids: the least of a component's classes stands for it
    placed = found.withColumnRenamed("component", "comp").join(reps, "node")
    least = placed.groupBy("comp").agg(F.min("rep").alias("least"))
    of = info.join(reps, "node", "left").join(placed.join(least, "comp").select("node", "least"), "node", "left").select("doc_id", "n", F.coalesce("least", "rep").alias("rep"))
    of = staging.stage(of, "info")
    # rows of one doc_id with several texts are linked, whatever the texts
    known = of.where("rep is not null and doc_id is not null")
    same = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    found = components.connected(known.join(same, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")))
    out = of.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    at = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), at.alias("component_id"))


def _with_leads(long: DataFrame, leads: DataFrame, few: int = 200_000, salts: int = 64) -> DataFrame:
    """long with each tok's lead. Few toks are broadcast; else a tok's rows are dealt out by document too, so that a hot one isn't one task's."""
    if leads.count() <= few:
        return long.join(F.broadcast(leads), "tok")
    salted = leads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return long.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")).join(salted, ["tok", "salt"]).drop("salt")


def _across(spark, lists: DataFrame, long: DataFrame, texts: DataFrame, found: DataFrame, width: int, threshold: float) -> DataFrame:
    """Edges within clusters of long lists, between classes outside a cluster's largest component and all others."""
    n_parts = staging.partitions(spark)
    clusters = components.connected(long.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    sizes = lists.groupBy("doc").agg(F.max(F.shiftright("at", 32)).alias("n"))
    # sets that are similar enough are of the same or of neighbouring classes of size
    level = F.floor(F.log("n") / F.lit(-math.log(threshold))).cast("int")
    of = clusters.join(sizes, "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "cluster", level.alias("level"), F.coalesce("component", "doc").alias("comp"))
    of = staging.stage(of, "clusters")
    main = of.groupBy("cluster", "comp").count().groupBy("cluster").agg(F.max(F.struct("count", "comp")).alias("main")).select("cluster", F.col("main.comp").alias("main"))
    blocks = of.groupBy("cluster", "level").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("blocks"))
    placed = of.join(main, "cluster").join(blocks, ["cluster", "level"]).select("doc", "cluster", "level", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), (F.col("comp") != F.col("main")).alias("apart"))
    placed = staging.stage(placed, "placed")
    key = ["cluster", "level", "block"]
    left = placed.where("apart").select(*key).distinct()
    right = placed.select("cluster", F.col("level").alias("r_level"), F.col("block").alias("r_block")).distinct()
    tasks = left.join(right, "cluster").where(F.abs(F.col("level") - F.col("r_level")) <= 1).withColumn("task", F.xxhash64(*key, "r_level", "r_block"))
    tasks = staging.stage(tasks, "tasks")
    here = placed.where("apart").join(tasks, key).select("task", F.lit(0).alias("side"), "doc")
    there = placed.withColumnsRenamed({"level": "r_level", "block": "r_block"}).join(tasks, ["cluster", "r_level", "r_block"]).select("task", F.lit(1).alias("side"), "doc")
    rows = here.unionByName(there).join(texts, "doc").select("task", "side", "doc", "words").repartition(n_parts, "task").sortWithinPartitions("task", "side")
    return staging.stage(rows.mapInArrow(_compared(width, threshold), "a long, b long"), "links")
