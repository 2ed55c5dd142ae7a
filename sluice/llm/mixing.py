"""Mixing to target weights with soft membership, by DataFrame functions alone.

A document's domain isn't known, but a table labels some documents. A classifier over binned measures (words that tell
labels apart, distinct words, symbols, length) learns the domains from a bounded sample of these and gives every
document posteriors. Nonnegative rates are then fitted so that the expected token totals of the domains match the
targets: least squares by projected gradients. The gradient of a document's rate is its posteriors times the domains'
misses, so that the steps so far add up to one number for each domain (the shift), and rates are the projection of
1 + posteriors * shift on what is allowed. A step is scaled by the inverse of the posteriors' second moments over the
documents at no bound, takes one pass of sums over all documents, and is halved where the misses grow. Steps end when
all domains miss their targets by less than the tolerance, or where no step helps: the largest miss is returned with the rates.

Domains are the combinations of the label columns. Null text counts as empty, has one token less than any other and
gets the posteriors of empty text. Labels that are null don't count. Rows with equal or null ids are weighed each by
itself. Without labelled rows there is one domain, and rates are what its target asks for. An empty table gives an
empty one; very long texts are measured whole. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import dataclasses
import functools
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import staging

#: Labelled rows that the classifier learns from at most; telling words for each label; passes of the fit at most, which end with a warning.
SAMPLE, TELLING, STEPS = 12_000, 64, 60
_CUTS = {"distinct": (0.3, 0.45, 0.6, 0.7, 0.8, 0.9, 0.97), "symbols": (0.0, 0.002, 0.01, 0.02, 0.04, 0.1), "length": (1.0, 3.0, 5.0, 6.0, 7.0, 8.0, 9.0, 11.0)}
_HITS = 4


def _words(text: Column) -> Column:
    return F.split(F.lower(text), "[ \\n\\t\\r.,!?;:\"|]+")


def _bin(value: Column, cuts) -> Column:
    return functools.reduce(lambda a, b: a + b, [(value > F.lit(c)).cast("int") for c in cuts])


@dataclasses.dataclass
class Classifier:
    domains: list[str]
    telling: dict[str, list[str]]
    prior: list[float]
    tables: dict[str, list[list[float]]]  # of each measure: of each domain, the log-probability of each bin

    def measures(self, docs: DataFrame, text_col: str) -> DataFrame:
        """docs with a column m_... for each measure, a bin's number, and tokens."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        df = docs.withColumn("w", _words(text)).withColumn("u", F.array_distinct("w"))
        n = F.length(text)
        values = {"distinct": F.size("u") / F.size("w"), "symbols": (n - F.length(F.translate(text, "&*$#!|", ""))) / F.greatest(n, F.lit(1)), "length": F.log2(F.size("w").cast("double") + 1)}
        columns = {f"m_{k}": _bin(v, _CUTS[k]) for k, v in values.items()}
        for k, words in self.telling.items():
            columns[f"m_{k}"] = F.least(F.lit(_HITS - 1), F.size(F.array_intersect("u", F.lit(words)))) if words else F.lit(0)
        tokens = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size("w")).cast("double")
        return df.withColumns(columns | {"tokens": tokens}).drop("w", "u")

    def posteriors(self) -> list[Column]:
        scores = [functools.reduce(lambda a, b: a + b, [F.lit(self.prior[d]), *(F.get(F.lit(t[d]), F.col(f"m_{k}")) for k, t in self.tables.items())]) for d in range(len(self.domains))]
        most = F.greatest(*scores) if len(scores) > 1 else scores[0]
        e = [F.exp(s - most) for s in scores]
        total = functools.reduce(lambda a, b: a + b, e)
        return [x / total for x in e]


def train(docs: DataFrame, labels: DataFrame, label_cols: tuple[str, ...] = ("quality", "toxic"), sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Counts over at most so many labelled rows, those of the smallest hashes of their ids (so that it can be broadcast)."""
    with staging.scope():
        return _trained(docs, labels, label_cols, sample, id_col, text_col)


def _trained(docs: DataFrame, labels: DataFrame, label_cols: tuple[str, ...], sample: int, id_col: str, text_col: str) -> Classifier:
    known = labels.where(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (id_col, *label_cols)]))
    few = known.select(F.col(id_col).alias("key"), *(F.col(c).cast("string").alias(f"l_{c}") for c in label_cols)).distinct().orderBy(F.xxhash64("key"), "key", *(f"l_{c}" for c in label_cols)).limit(sample)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(few), "key")
    domain = F.concat_ws("", *(x for c in label_cols for x in (F.lit(c[:1]), F.col(f"l_{c}"))))
    rows = staging.stage(rows.withColumn("domain", domain), "labelled")
    sizes = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # as many rows as domains
    domains = sorted(sizes) or ["all"]
    # words found in more of a label's documents than of the others'
    seen = rows.select(*(f"l_{c}" for c in label_cols), F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("word"))
    telling: dict[str, list[str]] = {}
    for c in label_cols:
        counts = {r.v: r.n for r in rows.groupBy(F.col(f"l_{c}").alias("v")).agg(F.count("*").alias("n")).collect()}
        if len(counts) < 2:
            continue
        rare = min(counts, key=lambda v: (counts[v], v))
        a, b = counts[rare], sum(counts.values()) - counts[rare]
        hit = F.sum((F.col(f"l_{c}") == rare).cast("int"))
        words = seen.groupBy("word").agg(hit.alias("a"), (F.count("*") - hit).alias("b")).where("a >= 4")
        odds = F.log((F.col("a") + 0.5) / (a + 1)) - F.log((F.col("b") + 0.5) / (b + 1))
        words = words.withColumn("odds", odds * F.log1p(F.col("a"))).where(odds > 1.5)
        telling[c] = [r.word for r in words.orderBy(F.desc("odds"), "word").limit(TELLING).collect()]
    out = Classifier(domains, telling, [], {})
    bins = {k: len(v) + 1 for k, v in _CUTS.items()} | dict.fromkeys(telling, _HITS)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"m_{k}").cast("int").alias("bin")) for k in bins)))
    found = {(r.domain, r.k, r.bin): r.n for r in out.measures(rows, "text").select("domain", pairs.alias("p")).groupBy("domain", "p.k", "p.bin").agg(F.count("*").alias("n")).collect()}  # domains x measures x bins
    total = sum(sizes.values())
    out.prior = [float(np.log((sizes.get(d, 0) + 1) / (total + len(domains)))) for d in domains]
    out.tables = {k: [[float(np.log((found.get((d, k, i), 0) + 0.5) / (sizes.get(d, 0) + 0.5 * m))) for i in range(m)] for d in domains] for k, m in bins.items()}
    return out


def _rate(shift: list[float], low: Column, high: float | None) -> Column:
    """1 and the posteriors times the shift, within the bounds."""
    r = functools.reduce(lambda a, b: a + b, [F.lit(1.0), *(F.lit(float(x)) * F.col(f"p{d}") for d, x in enumerate(shift))])
    return F.greatest(low, r if high is None else F.least(F.lit(float(high)), r))


def _solved(slim: DataFrame, goal: np.ndarray, low: Column, high: float | None, total: float, tolerance: float) -> tuple[np.ndarray, float]:
    """The shift for which the domains' expected totals (in parts of total) are goal, and the largest miss in parts of its domain's goal."""
    n = len(goal)
    of_low, of_high = (F.col("rate") > low), (F.lit(True) if high is None else F.col("rate") < F.lit(float(high)))
    free = (of_low & of_high).cast("double")
    sums = [F.sum(F.col("tokens") * F.col(f"p{d}") * F.col("rate")).alias(f"s{d}") for d in range(n)]
    moments = [F.sum(F.col("tokens") * F.col(f"p{d}") * F.col(f"p{e}") * free).alias(f"g{d}_{e}") for d in range(n) for e in range(d, n)]

    def at(shift):
        row = slim.withColumn("rate", _rate(shift.tolist(), low, high)).agg(*sums, *moments).first()
        miss = np.array([row[f"s{d}"] for d in range(n)]) / total - goal
        return miss, np.array([[row[f"g{min(d, e)}_{max(d, e)}"] for e in range(n)] for d in range(n)]) / total

    scale = np.maximum(goal, 1e-9)
    shift, step = np.zeros(n), 1.0
    miss, m = at(shift)
    for _ in range(STEPS):
        worst = float(np.abs(miss / scale).max())
        if worst < tolerance:
            break
        ridge = 1e-9 * max(float(np.trace(m)), 1e-12)
        down = np.linalg.solve(m + ridge * np.eye(n), miss)
        new_miss, new_m = at(shift - step * down)
        if np.sum((new_miss / scale) ** 2) < np.sum((miss / scale) ** 2):
            shift, miss, m, step = shift - step * down, new_miss, new_m, min(1.0, 2 * step)
        else:
            step /= 2
            if step < 1e-3:
                break
    return shift, float(np.abs(miss / scale).max())


def fit(docs: DataFrame, classifier: Classifier, weights: dict[str, float], anchor: str | None = None, high: float | None = None, keep: str | None = None, keep_from: float = 0.5, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies, miss) of every row, and the columns to carry under the names kept_....

    weights: the domains' shares of the target, 0 if missing. The target's total is the present one or, with anchor,
    that of which the anchor's share is its present total. Rates are 0 at least, and high at most if it is given; with keep, documents
    whose posterior of that domain is keep_from or more have a rate of 1 at least. copies is the rate rounded up or down by a digest
    of the id, so that its expectation is the rate. miss, the same in all rows, is the largest miss of a domain's target in parts of
    it: 0 but for the tolerance, unless bounds or a domain without tokens make the targets impossible; then there is a warning too.
    Without columns to carry, the result is a staged table.
    """
    with staging.scope() as kept:
        out = _fitted(docs, classifier, weights, anchor, high, keep, keep_from, tolerance, id_col, text_col, carry)
        if not carry:
            out = staging.stage(out, "mixed")
            kept.append(out)
    return out


def _fitted(docs: DataFrame, classifier: Classifier, weights: dict[str, float], anchor, high, keep, keep_from, tolerance, id_col, text_col, carry) -> DataFrame:
    n, names = len(classifier.domains), classifier.domains
    scored = classifier.measures(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"kept_{c}") for c in carry)), "text")
    whole = scored.select("doc_id", "tokens", *(p.alias(f"p{d}") for d, p in enumerate(classifier.posteriors())), *(f"kept_{c}" for c in carry))
    rows = staging.stage(whole.select("doc_id", "tokens", *(f"p{d}" for d in range(n))), "mixing")
    slim = rows.select("tokens", *(f"p{d}" for d in range(n)))
    sums = slim.agg(F.sum("tokens").alias("t"), *(F.sum(F.col("tokens") * F.col(f"p{d}")).alias(f"m{d}") for d in range(n))).first()
    total = sums.t or 0.0
    kept = names.index(keep) if keep in names else None
    low = F.lit(0.0) if kept is None or n == 1 else F.when(F.col(f"p{kept}") >= keep_from, F.lit(1.0)).otherwise(F.lit(0.0))
    shift, worst = np.zeros(n), 0.0
    if total:
        mass = np.array([sums[f"m{d}"] for d in range(n)]) / total
        share = np.array([weights.get(d, 0.0) for d in names])
        share = share / share.sum() if share.sum() else mass
        size = mass[names.index(anchor)] / max(share[names.index(anchor)], 1e-9) if anchor in names else 1.0
        shift, worst = _solved(slim, share * size, low, high, total, tolerance)
        if worst > 0.01:
            warnings.warn(f"mixing: a domain misses its target by {worst:.1%} of it", stacklevel=2)
    if carry:
        # what is carried may be large and isn't written in between: it is read, and measured, once more; the list of one
        # keeps the measures from being computed twice
        measures = ["doc_id", "tokens", *(f"p{d}" for d in range(n))]
        rows = whole.select(*(f"kept_{c}" for c in carry), F.explode(F.array(F.struct(*measures))).alias("m")).select("m.*", *(f"kept_{c}" for c in carry))
    rated = rows.withColumn("rate", _rate(shift.tolist(), low, high))
    even = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 12) / F.lit(float(1 << 52))
    copies = F.floor(F.round("rate", 9) + even).cast("int")
    return rated.select("doc_id", "tokens", *(F.col(f"p{d}").alias(f"p_{k}") for d, k in enumerate(names)), "rate", copies.alias("copies"), F.lit(worst).alias("miss"), *(f"kept_{c}" for c in carry))


#: What the query mixes to: a bit of every domain, mostly good and clean text.
WEIGHTS = {"q1t0": 0.80, "q1t1": 0.06, "q0t0": 0.12, "q0t1": 0.02}


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return fit(docs, train(docs, labels), WEIGHTS)
