"""Toxic spans from a chain over words: each word is offending or not, given its form and the forms of the words beside it.

Words of labelled documents bear labels: a form (a word or its beginning) that occurs in far more of the toxic
documents than of the others marks the words that have it, in toxic documents. The chain learns these; its
forward-backward marginals of all words of a text give the offending offsets and, by a logistic curve, the document's
score. Words without any marked form here or beside them all have one potential: a run of them is one power of the
chain's step, and each one's marginal has a closed form, so that the whole chain is exact and needs steps for the others only.

Words are what ASCII white space separates, without punctuation around, in lower case. Words of two characters or
fewer have no form of their own; in text without spaces only the beginning of a run has. Null text counts as empty;
empty texts get the score of no words. Rows with repeated or null ids are scored each by itself. An empty table gives an
empty one, very long texts are scored whole, columns other than id and text don't matter, whatever their names.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.arrow import tidy
from sluice.llm import crf, labelled, shingles

#: Labelled rows of either label that training takes at most.
POSITIVES, NEGATIVES = 3000, 5000
#: Forms that the model has at most and that a word has; words beside a form that training sees.
FORMS, WIDTH, BESIDE = 5000, 8, 4
#: Penalty of the weights of the words beside; that of a word's own forms is 2.
AROUND = 40.0
#: Distinct words that a worker remembers, bytes of texts that it looks at at a time.
KNOWN, AT_A_TIME = 1_000_000, 1 << 20
_STRIP = ".,;:!?\"'()[]{}|&*$#<>=~\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
_BEGINNINGS = (4, 5, 6, 7, 8)


def _forms(word: str) -> list[str]:
    return [word + "|", *(word[:k] for k in _BEGINNINGS if len(word) > k)]


def _word(raw: str) -> str:
    return raw.strip(_STRIP).lower()


def _windows(marked: np.ndarray, n: int) -> list[tuple[int, int]]:
    """First and last position (exclusive) of the runs of a text's n positions within BESIDE of a marked one, of 64 positions at most."""
    out: list[list[int]] = []
    for m in marked.tolist():
        low, high = max(0, m - BESIDE), min(n, m + BESIDE + 1)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(k, min(k + 64, z)) for a, z in out for k in range(a, z, 64)]


class _Powers:
    """Powers of a positive 2 x 2 matrix, up to a factor: first + rho**r * second."""

    def __init__(self, m: np.ndarray):
        values, vectors = np.linalg.eig(m)
        big = int(np.argmax(values))
        back = np.linalg.inv(vectors)
        self.first = np.outer(vectors[:, big], back[big])
        self.second = np.outer(vectors[:, 1 - big], back[1 - big])
        self.rho = float(values[1 - big] / values[big])
        self._table = np.ones(1)

    def __call__(self, r: np.ndarray) -> np.ndarray:
        if r.max(initial=0) >= len(self._table):
            self._table = self.rho ** np.arange(2 * int(r.max()) + 1, dtype=float)
        return self._table[r]


def marginals(u: np.ndarray, active: np.ndarray, counts: np.ndarray, bias: float, moves: np.ndarray) -> np.ndarray:
    """Every position's marginal of label 1, sequences one after another; u: scores, which are bias where a position isn't active."""
    p = np.empty(len(u))
    v0, e = math.exp(bias), np.exp(moves)
    step = e * np.array([1.0, v0])[None, :]
    powers = _Powers(step)
    ends = np.cumsum(counts)
    firsts = ends - counts
    at = np.flatnonzero(active)
    number = np.searchsorted(at, ends) - np.searchsorted(at, firsts)  # active positions of each sequence
    order = np.argsort(-number, kind="stable")
    n, most = len(counts), int(number.max(initial=0))
    alive = np.searchsorted(-number[order], -np.arange(1, most + 1), side="right")
    start = (np.cumsum(number) - number)[order]
    first, last = firsts[order], ends[order]
    v = np.exp(np.clip(u[at], -30, 30))

    def through(x, r):  # row vectors times the r-th power, normed
        y = x @ powers.first + powers(r)[:, None] * (x @ powers.second)
        return y / y.sum(axis=1, keepdims=True)

    def back(x, r):
        y = x @ powers.first.T + powers(r)[:, None] * (x @ powers.second.T)
        return y / y.sum(axis=1, keepdims=True)

    begin = np.array([[1.0, v0]])
    forward = np.empty((len(at), 2))  # after the active position
    gap = np.diff(at, prepend=0) - 1  # before each active position, if it isn't the first of its sequence
    for t in range(most):
        k = alive[t]
        i = start[:k] + t
        if t:
            a = through(forward[i - 1], gap[i]) @ e
        else:
            g = at[i] - first[:k]
            a = np.where(g[:, None] > 0, through(np.repeat(begin, k, axis=0), np.maximum(g - 1, 0)) @ e, 1.0)
        a[:, 1] *= v[i]
        forward[i] = a / a.sum(axis=1, keepdims=True)
    into = np.empty((len(at), 2))  # the message that reaches the position before the active one, over the active one
    message = np.ones((n, 2))  # of what follows the next gap, into the gap's last position
    for t in range(most - 1, -1, -1):
        k = alive[t]
        i = start[:k] + t
        following = np.where(t + 1 < number[order][:k], at[np.minimum(i + 1, len(at) - 1)], last[:k]) - at[i] - 1
        b = back(message[:k], following)
        both = forward[i] * b
        p[at[i]] = both[:, 1] / both.sum(axis=1)
        b[:, 1] *= v[i]
        b = b @ e.T
        message[:k] = into[i] = b / b.sum(axis=1, keepdims=True)
    # runs of other positions: before each active one, and at the end of each sequence
    inner = np.ones(len(at), bool)
    some = number > 0
    inner[(np.cumsum(number) - number)[some]] = False
    head = np.flatnonzero(~inner)  # the first active position of each sequence that has some
    tail = (np.cumsum(number) - 1)[some]
    run_first = np.concatenate([at[inner] - gap[inner], firsts[some], at[tail] + 1, firsts[~some]])
    run_size = np.concatenate([gap[inner], at[head] - firsts[some], ends[some] - at[tail] - 1, counts[~some]])
    left = np.concatenate([forward[np.flatnonzero(inner) - 1], np.repeat(begin, len(head), axis=0), forward[tail], np.repeat(begin, int((~some).sum()), axis=0)])
    shift = np.concatenate([np.zeros(int(inner.sum()), int), np.ones(len(head), int), np.zeros(len(tail), int), np.ones(int((~some).sum()), int)])  # begin is the first position itself
    right = np.concatenate([into[inner], into[head], np.ones((len(tail), 2)), np.ones((int((~some).sum()), 2))])
    full = np.flatnonzero(run_size)
    size = run_size[full]
    where = np.repeat(np.arange(len(full)), size)
    j = np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)  # from 0
    f_power, b_power = powers(j + (1 - shift[full])[where]), powers(size[where] - 1 - j)
    f1, f2 = left[full] @ powers.first, left[full] @ powers.second
    b1, b2 = right[full] @ powers.first.T, right[full] @ powers.second.T
    no = (f1[where, 0] + f_power * f2[where, 0]) * (b1[where, 0] + b_power * b2[where, 0])
    yes = (f1[where, 1] + f_power * f2[where, 1]) * (b1[where, 1] + b_power * b2[where, 1])
    p[run_first[full][where] + j] = yes / (no + yes)
    return p


@dataclasses.dataclass
class Model:
    forms: dict[str, int]
    chain: crf.Chain  # features: a word's own forms, those of the word before, those of the next
    curve: np.ndarray
    shift: float

    def __post_init__(self):
        self._forget()

    def _forget(self):
        self._hashes, self._numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._weights = np.zeros((1, 3))  # of each list of forms: what it adds to its word, to the next and to the one before

    def __getstate__(self):
        return {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        """Numbers for new words: 0 without marked forms, else that of a row of weights."""
        numbers, rows, k = [], [], len(self.forms)
        for w in raw:
            found = np.array([self.forms[f] for f in _forms(_word(w.decode("utf-8", "replace"))) if f in self.forms][:WIDTH], np.int64)
            numbers.append(len(self._weights) + len(rows) if len(found) else 0)
            if len(found):
                rows.append([self.chain.weights[found + i * k].sum() for i in range(3)])
        self._weights = np.concatenate([self._weights, np.array(rows).reshape(-1, 3)])
        hashes, numbers = np.concatenate([self._hashes, hashes]), np.concatenate([self._numbers, np.array(numbers, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self._hashes, self._numbers = hashes[order], numbers[order]

    def _number(self, column: pa.Array, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self._hashes) > KNOWN:
            self._forget()
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.isin(distinct, self._hashes, assume_unique=True)
        if not known.all():
            data = shingles.spans(column)[0]
            self._learn(distinct[~known], [data[begin[i] : end[i]].tobytes() for i in where[~known]])
        return self._numbers[np.searchsorted(self._hashes, distinct)][inverse]

    def words(self, column: pa.Array):
        """Each word's probability, each text's number of words, and where words begin and end in the column's bytes."""
        hashes, counts, begin, end = shingles.located(column)
        number = self._number(column, hashes, begin, end)
        own, after, before = self._weights[number].T
        n = len(number)
        u = np.full(n, self.chain.bias) + own
        hit = number > 0
        active = hit.copy()
        if n:
            inner = np.ones(n, bool)  # positions with a word before them in their text
            inner[(np.cumsum(counts) - counts)[counts > 0]] = False
            u[1:] += np.where(inner[1:], after[:-1], 0)
            u[:-1] += np.where(inner[1:], before[1:], 0)
            active[1:] |= hit[:-1] & inner[1:]
            active[:-1] |= hit[1:] & inner[1:]
        return marginals(u, active, counts, self.chain.bias, self.chain.moves), counts, begin, end

    def aggregates(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each text: the log-odds of its most offending word, the log of the expected number of such words, and of their share."""
        most, total = np.full(len(counts), 1e-4), np.full(len(counts), 1e-4)
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            most[some] = np.maximum(most[some], np.maximum.reduceat(p, first))
            total[some] += np.add.reduceat(p, first)
        most = np.clip(most, 1e-4, 1 - 1e-6)
        return np.stack([np.log(most / (1 - most)), np.log(total), np.log(total / (counts + 20))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        p = crf.probability(x, self.curve)
        return 1 / (1 + np.exp(-(np.log(p / (1 - p)) + self.shift)))


def _offsets(raw: bytes, words: list[tuple[int, int, int]]) -> list[dict]:
    """Words (number, begin, end in bytes) as spans in code points, neighbours joined, without punctuation around."""
    out: list[dict] = []
    before, at, points = -2, 0, 0
    for n, a, z in words:
        points += len(raw[at:a].decode("utf-8", "replace"))
        text, at = raw[a:z].decode("utf-8", "replace"), a
        core = text.strip(_STRIP)
        start = points + (text.find(core) if core else 0)
        if n == before + 1:
            out[-1]["end"] = start + len(core)
        else:
            out.append({"start": start, "end": start + len(core)})
        before = n
    return out


def fit(rows: list[tuple[str, int]], threshold: float = 0.3) -> Model:
    """A chain from (text, label) rows; the scores are shifted so that threshold is the best cut between the labels."""
    y = np.array([v for _, v in rows], np.int64)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return Model({}, crf.Chain(np.zeros(1), 0.0, np.zeros((2, 2))), np.zeros(4), 5.0 if n1 else -5.0)
    # words as numbers, so that texts are held once
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    texts = [np.fromiter(map(number.__getitem__, text.encode().split()), np.int32) for text, _ in rows]
    words = [_word(w.decode("utf-8", "replace")) for w in number]
    del number
    # forms are counted for those words first that toxic documents share
    shared = np.zeros(len(words), np.int32)
    cells = np.zeros(1 << 22, np.int32)
    for t, v in zip(texts, y, strict=True):
        if v:
            distinct = np.unique(t)
            shared[distinct] += 1
            at = {zlib.crc32(f.encode()) & (len(cells) - 1) for i in distinct.tolist() if len(words[i]) > 2 for f in _forms(words[i])}
            cells[np.fromiter(at, np.int64, len(at))] += 1
    wanted: dict[str, int] = {}
    lists = []
    for i, w in enumerate(words):
        if len(w) > 2 and shared[i]:
            lists.append(np.array([wanted.setdefault(f, len(wanted)) for f in _forms(w) if cells[zlib.crc32(f.encode()) & (len(cells) - 1)] >= 3], np.int32))
        else:
            lists.append(None)
    for i, w in enumerate(words):  # of the other words, what those have too
        if lists[i] is None:
            lists[i] = np.array([wanted[f] for f in _forms(w) if f in wanted] if len(w) > 2 else [], np.int32)
    inside = np.zeros((2, len(wanted)), np.int64)
    for t, v in zip(texts, y, strict=True):
        some = [lists[i] for i in np.unique(t).tolist() if len(lists[i])]
        if some:
            inside[v, np.unique(np.concatenate(some))] += 1
    least = 3 if n1 < 300 else 4
    odds = np.log((inside[1] + 0.5) / (n1 + 1)) - np.log((inside[0] + 0.5) / (n0 + 1))
    # common enough among toxic documents that chance doesn't explain it
    strong = (inside[1] >= least) & (odds > 1.5) & (odds * np.sqrt(inside[1]) > 4.5)
    names = list(wanted)
    kept = sorted(np.flatnonzero(strong).tolist(), key=lambda i: (-odds[i] * math.log(1 + inside[1][i]), names[i]))[:FORMS]
    forms = {names[i]: j + 1 for j, i in enumerate(kept)}
    del wanted, names, lists, cells
    own_of = np.zeros((len(words), WIDTH), np.int32)
    for i, w in enumerate(words):
        if found := [forms[f] for f in _forms(w) if f in forms][:WIDTH]:
            own_of[i, : len(found)] = found
    del words
    # windows around marked words, and their labels; of texts without any, the first words
    places, active, tags, counts, k, done = [], [], [], [], len(forms), 0
    for t, v in zip(texts, y, strict=True):
        if not len(t):
            continue
        own = np.zeros((len(t) + 2, WIDTH), np.int32)
        own[1:-1] = own_of[t]
        marked = np.flatnonzero(own[1:-1, 0])
        for a, z in _windows(marked if len(marked) else np.zeros(1, np.int64), len(t)):
            for i in range(3):  # the word itself, the one before, the next
                part = own[a + (1, 0, 2)[i] : z + (1, 0, 2)[i]]
                at, column = np.nonzero(part)
                places.append((at + done).astype(np.int32))
                active.append(part[at, column] + i * k)
            tags.append((own[a + 1 : z + 1, 0] > 0) & (v == 1))
            counts.append(z - a)
            done += z - a
    del texts, own_of
    if not counts:
        places, active, tags, counts = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.zeros(1, bool)], [1]
    places, active = np.concatenate(places), np.concatenate(active)
    chain = crf.train((places, active), np.concatenate(tags).astype(np.int64), np.array(counts), 3 * k + 1, penalty=np.repeat([2.0, AROUND], [k + 1, 2 * k]))
    del places, active
    model = Model(forms, chain, np.zeros(4), 0.0)
    x = []
    for a in range(0, len(rows), 200):
        p, n = model.words(pa.array([t for t, _ in rows[a : a + 200]], pa.large_string()))[:2]
        x.append(model.aggregates(p, n))
    model._forget()
    x = np.concatenate(x)
    model.curve = crf.logistic(x, y)
    model.shift = crf.at_threshold(crf.probability(x, model.curve), y, threshold)
    return model


def train(docs: DataFrame, labels: DataFrame, where=None, threshold: float = 0.3) -> Model:
    where = F.lit(True) if where is None else where
    return fit(labelled.sample(docs, labels, "toxic", where, POSITIVES, NEGATIVES), threshold)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) of every row of docs; spans: start and end (exclusive, in code points) of offending words."""

    @tidy
    def run(batches):
        for batch in batches:
            for at, texts in shingles.batches_of(batch.column(1), AT_A_TIME):
                p, counts, begin, end = model.words(texts)
                data, offsets = shingles.spans(texts)
                hit = np.flatnonzero(p >= 0.5)
                ends = np.cumsum(counts)
                of = np.searchsorted(ends, hit, side="right")
                spans: list[list] = [[] for _ in range(len(texts))]
                for i, part in zip(np.unique(of).tolist(), np.split(hit, np.flatnonzero(np.diff(of)) + 1), strict=False):
                    low = offsets[i]
                    spans[i] = _offsets(data[low : offsets[i + 1]].tobytes(), list(zip(part.tolist(), (begin[part] - low).tolist(), (end[part] - low).tolist(), strict=True)))
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(model.score(model.aggregates(p, counts))), pa.array(spans, _SPANS)], names=["doc_id", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long>>")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: learnt from the rows that aren't held out."""
    model = train(docs, labels, labelled.fold("doc_id", 4) != 2)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return score(docs, model).select("doc_id", F.coalesce(labelled.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), spans.alias("spans"))
