"""Byte-level BPE: every distinct word of the corpus is encoded once, in the one place its hash leads to, and its ids are joined back.

1. Documents are cut into words. Those of a bounded run of documents (a chunk) become a sequence of numbers, the
   positions, and a list of distinct words, which is dealt into buckets by the words' hash.
2. The word lists meet by bucket: a distinct word is encoded when it first comes, and its ids go back to each chunk that asked.
3. The positions and the ids meet by chunk, and each document's ids are put together by position.
4. Decoding joins each id with the token-byte table, whose row i is token i: a lookup in every worker, as the table has
   the vocabulary's size.

A hot word costs one entry a chunk, however often it occurs; a very long document is a chunk of its own. A worker holds
one chunk or one list at a time, and KNOWN words of a bucket, whatever the corpus; in a bucket of more, the oldest are
forgotten, and are encoded anew where they come again. Null text is encoded as empty text, an empty table gives an empty
one. Rows with repeated or null ids are kept, each by itself. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions.arrow import tidy

#: Characters of text that one chunk holds at most, if it has more than one document; words of a bucket that a worker remembers.
CHUNK_CHARS, KNOWN = 28_000_000, 1_000_000
#: The pattern's alternatives for texts of ASCII characters alone, where the quicker standard engine does.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    whole = regex.compile(pattern).findall
    if pattern != default_pattern():
        return whole
    quick = _ASCII.findall
    return lambda text: quick(text) if text.isascii() else whole(text)


@lru_cache(maxsize=2)
def _word_encoder(path: str):
    """Encodes a text as one word."""
    import tiktoken

    return tiktoken.Encoding("given", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> pa.Array:
    table = ranks(path)
    out: list = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return pa.array(out, pa.binary())


def _pack(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_planes(x: np.ndarray, level: int = 3) -> bytes:
    """Numbers below 2**32, their low bytes together and their high ones together, which pack better."""
    return _pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), level)


def _unpack_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_unpack(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def _pack_ranks(x: np.ndarray) -> bytes:
    """Numbers of which most are small: a byte each, and those from 255 on apart."""
    large = x >= 255
    head = _pack(np.minimum(x, 255).astype(np.uint8).tobytes(), 9)
    return len(head).to_bytes(8, "little") + head + _pack_planes(x[large] - np.uint32(255), 9)


def _unpack_ranks(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(_unpack(data[8 : 8 + n]), np.uint8).astype(np.uint32)
    out[out == 255] += _unpack_planes(data[8 + n :])
    return out


_CHUNKS = "chunk long, bucket int, payload binary, extra binary"
_CHUNK_TYPE = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("extra", pa.binary())])


def _rows(chunk: int, buckets, payloads, extras) -> pa.RecordBatch:
    return pa.record_batch([pa.array([chunk] * len(buckets), pa.int64()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary()), pa.array(extras, pa.binary())], schema=_CHUNK_TYPE)


def _cut(pattern: str, n_buckets: int, chunk_chars: int):
    """Documents (id, text) to chunks: a row with the positions (bucket -1), and a row of distinct words for each bucket."""

    @tidy
    def run(batches):
        import xxhash

        split, first, made = _splitter(pattern), TaskContext.get().partitionId() << 32, 0

        def fresh():
            number: defaultdict[str, int] = defaultdict()
            number.default_factory = number.__len__
            return number

        number = fresh()
        ids: list = []
        sizes: list[int] = []
        seqs: list[np.ndarray] = []
        chars = 0

        def flush():
            words = list(number)
            seq = np.concatenate([np.empty(0, np.uint32), *seqs])
            # words are numbered anew, frequent ones first: their numbers are short
            order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            raw = [words[i].encode() for i in order]
            at = np.fromiter((xxhash.xxh32_intdigest(w) for w in raw), np.int64, len(raw)) % n_buckets
            known = np.fromiter((i is not None for i in ids), np.uint8, len(ids))
            docs = known.tobytes() + np.fromiter((i or 0 for i in ids), "<i8", len(ids)).tobytes() + np.array(sizes, "<i8").tobytes()
            extra = [_pack(docs), _pack_planes(at)]
            yield _rows(first + made, [-1], [_pack_ranks(rank[seq])], [len(extra[0]).to_bytes(8, "little") + b"".join(extra)])
            order = np.argsort(at, kind="stable")
            bounds = np.searchsorted(at[order], np.arange(n_buckets + 1))
            full = [b for b in range(n_buckets) if bounds[b] < bounds[b + 1]]
            lists = [[raw[i] for i in order[bounds[b] : bounds[b + 1]]] for b in full]
            yield _rows(first + made, full, [_pack(b"".join(x), 9) for x in lists], [_pack(np.fromiter(map(len, x), "<u4", len(x)).astype("<u4").tobytes()) for x in lists])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if ids and chars + len(text) > chunk_chars:
                    yield from flush()
                    made, chars = made + 1, 0
                    number, ids, sizes, seqs = fresh(), [], [], []
                words = split(text)
                seqs.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                ids.append(i)
                sizes.append(len(words))
                chars += len(text)
        if ids:
            yield from flush()

    return run


def _encode_words(path: str):
    """Rows of a bucket, one after another: each distinct word is encoded when it first comes."""

    @tidy
    def run(batches):
        encode, known, now = _word_encoder(path), {}, None
        for batch in batches:
            for chunk, bucket, payload, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    known, now = {}, bucket
                raw, ends = _unpack(payload), np.cumsum(np.frombuffer(_unpack(extra), "<u4")).tolist()
                found, at = [], 0
                for end in ends:
                    word = raw[at:end]
                    at = end
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN:
                            del known[next(iter(known))]
                        ids = known[word] = encode(word.decode())
                    found.append(ids)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
                yield _rows(chunk, [bucket], [_pack_planes(flat)], [_pack_planes(sizes)])

    return run


@tidy
def _assemble(batches):
    """Rows of a chunk, one after another: its positions, then its buckets in order."""

    def finish(packed, both, flats, lengths):
        k = int.from_bytes(both[:8], "little")
        extra, at = _unpack(both[8 : 8 + k]), _unpack_planes(both[8 + k :])
        place = np.empty(len(at), np.uint32)  # of a word by its rank, among the words bucket by bucket
        place[np.argsort(at, kind="stable")] = np.arange(len(at), dtype=np.uint32)
        seq = place[_unpack_ranks(packed)]
        n = len(extra) // 17
        known, ids, sizes = np.frombuffer(extra, np.uint8, n).astype(bool), np.frombuffer(extra, "<i8", n, n), np.frombuffer(extra, "<i8", n, 9 * n)
        flat = np.concatenate([np.empty(0, np.uint32), *flats])
        length = np.concatenate([np.empty(0, np.int64), *lengths]).astype(np.int64)
        start = np.cumsum(length) - length
        at = 0
        while at < n:  # a few documents at a time, which bounds what is held as ids
            to, words = at + 1, int(sizes[at])
            while to < n and words + sizes[to] < 300_000 and to - at < 1000:
                words += int(sizes[to])
                to += 1
            part, seq = seq[:words], seq[words:]
            k = length[part]
            ends = np.cumsum(k)
            where = np.repeat(start[part] - (ends - k), k) + np.arange(int(ends[-1]) if len(k) else 0)
            bounds = np.concatenate([[0], np.cumsum(sizes[at:to])])
            offsets = np.concatenate([[0], ends])[bounds].astype(np.int32)
            yield pa.record_batch([pa.array(ids[at:to], pa.int64(), mask=~known[at:to]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[where].astype(np.int32)))], names=["doc_id", "ids"])
            at = to

    now, held = None, None
    for batch in batches:
        for chunk, bucket, payload, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk != now:
                if held:
                    yield from finish(*held)
                assert bucket == -1, "a chunk's positions are missing"
                now, held = chunk, (payload, extra, [], [])
            else:
                held[2].append(_unpack_planes(payload))
                held[3].append(_unpack_planes(extra))
    if held:
        yield from finish(*held)


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str, chunk_chars: int) -> DataFrame:
    n = staging.partitions(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    with staging.small_batches(docs.sparkSession):
        chunks = staging.stage(texts.mapInArrow(_cut(pattern, n, chunk_chars), _CHUNKS), "bpe")
    words = chunks.where("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket", "chunk")
    coded = words.mapInArrow(_encode_words(vocabulary), _CHUNKS)
    both = chunks.where("bucket < 0").unionByName(coded).repartition(n, "chunk").sortWithinPartitions("chunk", "bucket")
    return both.mapInArrow(_assemble, "doc_id long, ids array<int>")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id long, ids array<int>), a row for each row of docs; the ids are those that tiktoken's encode_ordinary gives. A staged table."""
    with staging.scope() as kept:
        out = staging.stage(_encoded(docs, id_col, text_col, vocabulary or default_vocabulary(), pattern or default_pattern(), chunk_chars), "ids")
        kept.append(out)
    return out


def decode(coded: DataFrame, ids_col: str = "ids", vocabulary: str | None = None, out_col: str = "decoded") -> DataFrame:
    """coded and a column out_col (binary), in place of one of that name: the ids' bytes by the token-byte table, whose size is the vocabulary's.

    Null ids give null, no ids give empty bytes, an id outside the vocabulary ends the job with an error.
    """
    coded = coded.select(*(f"`{c}`" for c in coded.columns if c.lower() != out_col.lower()))
    vocabulary = vocabulary or default_vocabulary()

    @tidy
    def run(batches):
        table = _token_bytes(vocabulary)
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            lists = batch.column(batch.schema.get_field_index(ids_col))
            flat = table.take(lists.flatten())
            sizes = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
            starts = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, flat.offset * 4) if len(flat) else np.zeros(1, np.int32)
            offsets = starts[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
            data = flat.buffers()[2] if len(flat) else pa.py_buffer(b"")
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), data])
            if lists.null_count:
                raw = pa.array([r.as_py() if v else None for r, v in zip(raw, lists.is_valid().to_pylist(), strict=True)], pa.binary())
            yield pa.record_batch([*batch.columns, raw], names=[*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, f"{fields}, `{out_col}` binary")


def digests(docs: DataFrame, keep_ids: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: a staged table.

    With keep_ids its ids too: not staged, as they are large; what it reads is deleted when the process ends, or the caller's scope.
    """

    def whole():
        both = decode(_encoded(docs, "doc_id", "text", default_vocabulary(), default_pattern(), chunk_chars))
        return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids"] if keep_ids else []))

    if keep_ids:
        return whole()
    with staging.small_batches(docs.sparkSession), staging.scope() as kept:
        out = staging.stage(whole(), "tokens")
        kept.append(out)
    return out
