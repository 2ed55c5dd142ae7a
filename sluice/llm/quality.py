"""Document quality from a chain over lines: each line is good or bad, given its own and its neighbours' features.

The chain learns from lines that bear their document's label. Forward-backward marginals, weighted by the lines'
lengths, give a document's share of good text, and a logistic curve turns that into a score. Null text counts as
empty; empty texts get the score of their only, empty, line. Rows with repeated or null ids are scored each by itself.
An empty table gives an empty one, very long texts are scored whole, and columns other than id and text don't matter,
whatever their names.
"""

from __future__ import annotations

import dataclasses
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.arrow import tidy
from sluice.llm import crf, labelled

#: Labelled rows of either label that training takes at most.
POSITIVES, NEGATIVES = 3000, 3000
#: Where the values of a line's measures are cut.
_CUTS = {
    "length": (0, 1, 3, 8, 20, 60, 200),
    "pipes": (0, 0.05, 0.2, 0.5),
    "marks": (0, 0.02, 0.1, 0.3, 0.6),
    "same": (0, 0.05, 0.15, 0.4, 0.7),
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.999),
    "upper": (0, 0.02, 0.05, 0.1, 0.3, 0.6),
    "symbols": (0, 0.02, 0.04, 0.08, 0.16),
    "digits": (0, 0.02, 0.1, 0.3),
    "word": (2, 3, 4, 5, 6, 8, 12),
    "stop": (0.05, 0.1, 0.2, 0.3, 0.5),
    "ended": (0,),
    "again": (0,),
}
_NAMES = list(_CUTS)
_BINS = [len(c) + 1 for c in _CUTS.values()]
_FIRST = np.concatenate([[0], np.cumsum(_BINS)[:-1]])
_WIDTH = sum(_BINS)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_PLAIN = _UPPER + _LOWER + _DIGITS + b" .,\t" + bytes(range(128, 256))


def _measure(line: bytes, seen: set) -> tuple:
    n = max(1, len(line))
    words = line.split()
    k = max(1, len(words))
    marks = sum(map(line.count, (b"!!", b"&&", b"**", b"$$", b"##", b"??", b"==", b"~~")))
    again = line in seen
    seen.add(line)
    return (
        len(words),
        line.count(b"|") / k,
        marks / k,
        sum(map(eq, words, words[1:])) / k,
        len(set(words)) / k,
        (n - len(line.translate(None, _UPPER))) / n,
        len(line.translate(None, _PLAIN)) / n,
        (n - len(line.translate(None, _DIGITS))) / n,
        len(line) / k,
        (line.count(b".") + line.count(b",")) / k,
        line.rstrip()[-1:] in (b".", b"?", b"!"),
        again and len(line) > 20,
    )


def _features(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts (own, of the line before, of the next), the texts' numbers of lines, and the lines' lengths."""
    rows, counts, lengths = [], [], []
    for text in texts:
        lines = (text.encode() if isinstance(text, str) else text or b"").split(b"\n")
        seen: set = set()
        rows += [_measure(x, seen) for x in lines]
        counts.append(len(lines))
        lengths += map(len, lines)
    values = np.array(rows, float).reshape(-1, len(_NAMES))
    own = np.stack([np.searchsorted(_CUTS[name], values[:, i], side="left") + _FIRST[i] for i, name in enumerate(_NAMES)], axis=1).astype(np.int32)
    counts = np.array(counts, np.int64)
    first = np.cumsum(counts) - counts
    before, after = np.roll(own, 1, axis=0) + _WIDTH + 1, np.roll(own, -1, axis=0) + 2 * _WIDTH + 1
    if len(first):
        before[first], after[first + counts - 1] = 0, 0
    return np.concatenate([own + 1, before, after], axis=1), counts, np.array(lengths, float)


N_FEATURES = 3 * _WIDTH + 1


@dataclasses.dataclass
class Model:
    chain: crf.Chain
    curve: np.ndarray
    shift: float

    def lines(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's probability to be good, the texts' numbers of lines, the lines' lengths."""
        features, counts, lengths = _features(texts)
        u = self.chain.scores(features)
        p = np.empty(len(u))
        first = np.cumsum(counts) - counts
        order = np.argsort(counts, kind="stable")
        at = 0
        while at < len(order):  # texts of like numbers of lines together
            to, longest = at + 1, counts[order[at]]
            while to < len(order) and counts[order[to]] <= 2 * longest + 4:
                to += 1
            part = order[at:to]
            where = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in part])
            padded, mask = crf.padded(u[where], counts[part])
            p[where] = crf.forward_backward(padded, counts[part], self.chain.moves)[0][mask]
            at = to
        return p, counts, lengths

    def aggregates(self, texts) -> np.ndarray:
        """Of each text: the log-odds of the length-weighted mean of its lines' marginals, and of their unweighted mean."""
        p, counts, lengths = self.lines(texts)
        at = np.repeat(np.arange(len(counts)), counts)
        weight = lengths + 1
        share = np.bincount(at, p * weight, len(counts)) / np.bincount(at, weight, len(counts))
        plain = np.bincount(at, p, len(counts)) / counts
        x = np.clip(np.stack([share, plain], axis=1), 1e-6, 1 - 1e-6)
        return np.log(x / (1 - x))

    def score(self, texts) -> np.ndarray:
        p = crf.probability(self.aggregates(texts), self.curve)
        z = np.log(p / (1 - p)) + self.shift
        return 1 / (1 + np.exp(-z))


def fit(rows: list[tuple[str, int]], threshold: float = 0.3) -> Model:
    """A chain from (text, label) rows; the scores are shifted so that threshold is the best cut between the labels."""
    if len({y for _, y in rows}) < 2:  # nothing to tell apart: all are what is labelled, or good
        return Model(crf.Chain(np.zeros(N_FEATURES), 0.0, np.zeros((2, 2))), np.zeros(3), -5.0 if rows and not rows[0][1] else 5.0)
    texts, y = [t for t, _ in rows], np.array([v for _, v in rows])
    features, counts, _ = _features(texts)
    # long texts are several sequences of 200 lines at most
    sizes = np.array([min(n - k, 200) for n in counts.tolist() for k in range(0, n, 200)])
    chain = crf.train(features, np.repeat(y, counts), sizes, N_FEATURES)
    model = Model(chain, np.zeros(3), 0.0)
    x = model.aggregates(texts)
    model.curve = crf.logistic(x, y)
    model.shift = crf.at_threshold(crf.probability(x, model.curve), y, threshold)
    return model


def train(docs: DataFrame, labels: DataFrame, where=None, threshold: float = 0.3) -> Model:
    where = F.lit(True) if where is None else where
    return fit(labelled.sample(docs, labels, "quality", where, POSITIVES, NEGATIVES), threshold)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, good_share) of every row of docs."""
    @tidy
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                x = model.aggregates(texts)
                z = crf.probability(x, model.curve)
                z = np.log(z / (1 - z)) + model.shift
                yield pa.record_batch([part.column(0), pa.array(1 / (1 + np.exp(-z))), pa.array(1 / (1 + np.exp(-x[:, 0])))], names=["doc_id", "score", "good_share"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, good_share double")


def kept(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    place = docs.columns.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array(model.score(part.column(place).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the rows that aren't held out."""
    model = train(docs, labels, labelled.fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", F.coalesce(labelled.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "good_share")
