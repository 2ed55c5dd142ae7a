"""Word shingles of many texts at a time, by array operations over the texts' bytes.

A word is a run of bytes other than ASCII white space, A-Z in lower case. Its hash adds up a random number for each byte
value times a power for the byte's place, modulo 2**64, so that prefix sums over all bytes give every word's hash. A
shingle's hash mixes its words' hashes and their number. Texts with fewer words than a shingle has have one, of all their
words; texts without words (null ones too) have none.

Bytes are taken in steps of bounded size, so that a very long text needs no more than its words' hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_STEP = 1 << 18
_RANDOM = np.random.default_rng(20011)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: A-Z to a-z, for bytes.translate.
FOLD = _FOLD.tobytes()
#: A random odd number for each byte value (A-Z like a-z), and what separates words.
_OF_BYTE = (_RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1))[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _STEP), _powers(_INVERSE, _STEP)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that a column of strings or binaries holds, and the offsets of its values; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def located(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, one text after another, each text's number of words, and where words begin and end in the column's bytes."""
    none = np.empty(0, np.int64)
    if not len(column):
        return np.empty(0, np.uint64), none, none, none
    data, offsets = spans(column)
    low, high = int(offsets[0]), int(offsets[-1])
    begins, heads, scales, ends, tails = [], [], [], [], []
    total, scale, shrink = np.uint64(0), 1, 1  # the sum so far, and what powers of this step start from
    before = True  # is the byte before white space
    for at in range(low, high, _STEP):
        to = min(high, at + _STEP)
        raw = data[at:to]
        n = to - at
        space = _SPACE[raw]
        sums = np.empty(n + 1, np.uint64)
        sums[0] = total
        part = _OF_BYTE[raw]
        part *= _UP[:n]
        part *= np.uint64(scale)
        np.cumsum(part, out=sums[1:])
        sums[1:] += total
        border = np.zeros(n + 1, bool)  # a text begins before this byte
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, side="right")] - at
        border[inside] = True
        after = np.empty(n, bool)  # is the byte before white space, or of another text
        after[0], after[1:] = before, space[:-1]
        after |= border[:n]
        start = np.flatnonzero(~space & after)
        # a word ends where white space, or another text, follows a byte of a word
        follows = np.empty(n, bool)
        follows[0], follows[1:] = not before, ~space[:-1]
        end = np.flatnonzero(follows & (space | border[:n]))
        begins.append(start + at)
        heads.append(sums[start])
        scales.append(_DOWN[start] * np.uint64(shrink))
        ends.append(end + at)
        tails.append(sums[end])
        total, before = sums[n], bool(space[-1])
        scale, shrink = scale * int(_UP[n]) % (1 << 64), shrink * int(_DOWN[n]) % (1 << 64)
    if not before:
        ends.append(np.array([high]))
        tails.append(np.array([total], np.uint64))
    if not begins:
        return np.empty(0, np.uint64), np.zeros(len(column), np.int64), none, none
    h = np.concatenate(tails) - np.concatenate(heads)
    h *= np.concatenate(scales)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    counts = np.diff(np.searchsorted(begin, offsets))
    return mixed(h + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts, begin, end


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, one text after another, and each text's number of words."""
    return located(column)[:2]


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, repeated ones too, one text after another, and each text's number of them."""
    number = np.where(counts < width, np.minimum(counts, 1), counts - width + 1)
    n = len(hashes)
    out = np.full(n, width, np.uint64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the text's end
    short = np.repeat(counts < width, counts)
    if short.any():
        out[short] = left[short]
    for i in range(min(width, n)):
        part = hashes[i:] * np.uint64(pow(_BASE, 2 * i + 3, 1 << 64))
        if short.any():
            part[(left[: n - i] <= i)] = 0
        out[: n - i] += part
    first = np.cumsum(counts) - counts
    keep = np.where(short, np.arange(n) == np.repeat(first, counts), left >= width)
    return mixed(out[keep]), number


def digests(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each text that depends on all its words and their order; 0 without words."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        first = (np.cumsum(counts) - counts)[some]
        place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first, counts[some]).astype(np.uint64)
        out[some] = mixed(np.add.reduceat(mixed(hashes ^ (place + np.uint64(1)) * np.uint64(_BASE)), first) + counts[some].astype(np.uint64))
    return out


def sets(column: pa.Array, width: int):
    """Each text's distinct shingles in ascending order, and the texts' digests."""
    hashes, counts = words(column)
    node = digests(hashes, counts)
    all_, number = shingles(hashes, counts, width)
    ends = np.cumsum(number)
    return [np.unique(all_[e - k : e]) for e, k in zip(ends.tolist(), number.tolist(), strict=True)], node


def batches_of(column: pa.Array, most: int = 1 << 22):
    """(first, column) of consecutive runs of texts, of so many bytes about, or of one longer text."""
    _, offsets = spans(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, column.slice(at, to - at)
        at = to
