"""Whitening of embeddings: exact scatter by partitions, cyclic Jacobi on the driver, projections by partitions.

1. One pass adds up the whole numbers x = floor(64 c) + 1000000 of every dimension, exactly.
2. A second pass centres every vector at the rounded means and adds up the products of all pairs of dimensions, exactly:
   sums of whole numbers don't depend on partitions or their order. What the rounding of the means leaves is taken off
   in whole numbers too, so that each entry of the covariance is rounded once.
3. The driver, which gets a matrix of the dimensions' number squared and nothing that grows with the rows, turns it by
   Jacobi rotations until all entries off the diagonal vanish beside those on it. The pairs of a sweep come in rounds of
   disjoint ones, each of which is turned at once.
4. Eigenvectors over the roots of their eigenvalues are broadcast; a last pass projects. The covariance of what comes out
   is measured by an aggregate over all rows.

Vectors that are null or hold null or non-finite entries take no part. Vectors of another length are whitened by
themselves. Rows with a null or repeated id are rows like any other. Entries beyond 2**34 in size count as 2**34. A component whose
eigenvalue is nothing but rounding (equal vectors, fewer vectors than dimensions) can't be whitened and has no row; a
deviation that doesn't fit in 64 bits is null. An empty table gives an empty one; vectors may be long, as far as the
driver can hold the square of their length. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions.arrow import tidy
from sluice.llm import vectors

#: What entries are multiplied by, and what is added to them.
SCALE, OFFSET = 64, 1_000_000
#: Components that are given; bits of each lower part of a sum; largest entry in size (its products' sums fit in three parts); sweeps of rotations at most.
COMPONENTS, LOW, LARGEST, SWEEPS = 32, 32, float(1 << 40), 60
#: Entries of vectors that are worked on at a time.
STEP = 1 << 20

_SUMS = "dim int, part int, low binary, middle binary, high binary"
_SUMS_TYPE = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("low", pa.binary()), ("middle", pa.binary()), ("high", pa.binary())])


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _steps(batch, column: int):
    """(dimension, row numbers, whole numbers) of parts of a batch of bounded size."""
    for dim, rows, x in vectors.by_length(batch.column(column)):
        size = max(1, STEP // max(1, dim))
        for at in range(0, len(rows), size):
            yield dim, rows[at : at + size], whole(x[at : at + size])


class _Sum:
    """An array of sums of up to 127 bits: two lower parts and the rest."""

    def __init__(self, shape):
        self.parts = [np.zeros(shape, np.int64) for _ in range(3)]

    def add(self, x: np.ndarray) -> None:
        """x: whole numbers, as int64 or Python's own."""
        mask = (1 << LOW) - 1
        self.add_parts(((x & mask).astype(np.int64), (x >> LOW & mask).astype(np.int64), (x >> LOW >> LOW).astype(np.int64)))

    def add_parts(self, parts) -> None:
        for own, more in zip(self.parts, parts, strict=True):
            own += more
        for lower, upper in zip(self.parts, self.parts[1:], strict=False):
            upper += lower >> LOW
            lower &= (1 << LOW) - 1

    def rows(self, dim: int):
        for i, parts in enumerate(zip(*self.parts, strict=True)):
            yield dim, i, *(p.astype("<i8").tobytes() for p in parts)

    def numbers(self) -> list[list[int]]:
        return [[low + (middle << LOW) + (high << 2 * LOW) for low, middle, high in zip(*(p.tolist() for p in parts), strict=True)] for parts in zip(*self.parts, strict=True)]


def _batch(rows):
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMS_TYPE, strict=True)], schema=_SUMS_TYPE)


@tidy
def _totals(batches):
    """Vectors to sums over dimensions, the last of which is the number of rows."""
    sums: dict[int, _Sum] = {}
    for batch in batches:
        for dim, _, x in _steps(batch, 0):
            own = sums.setdefault(dim, _Sum((1, dim + 1)))
            most = int(np.abs(x).max(initial=0)) * len(x)
            total = x.sum(axis=0) if most < 1 << 62 else x.astype(object).sum(axis=0)
            own.add(np.append(total, len(x))[None, :])
    rows = [r for dim, s in sums.items() for r in s.rows(dim)]
    if rows:
        yield _batch(rows)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x, exactly: in doubles where they hold all sums, else in 64 bits, else in Python's numbers."""
    most = int(np.abs(x).max(initial=0)) ** 2 * len(x)
    if most < 1 << 53:
        d = x.astype(np.float64)
        return (d.T @ d).astype(np.int64)
    x = x if most < 1 << 63 else x.astype(object)
    return x.T @ x


def _scatter(centres: dict[int, np.ndarray]):
    """Vectors to sums of products of dimensions, after centring."""

    @tidy
    def run(batches):
        sums: dict[int, _Sum] = {}
        for batch in batches:
            for dim, _, x in _steps(batch, 0):
                sums.setdefault(dim, _Sum((dim, dim))).add(_products(x - centres[dim]))
        for dim, s in sums.items():
            if dim:
                yield _batch(list(s.rows(dim)))

    return run


@tidy
def _merged(batches):
    sums: dict[tuple[int, int], _Sum] = {}
    for batch in batches:
        for dim, part, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more = [np.frombuffer(m, "<i8") for m in more]
            sums.setdefault((dim, part), _Sum((1, len(more[0])))).add_parts(more)
    rows = [(dim, part, *row[2:]) for (dim, part), s in sums.items() for row in s.rows(dim)]
    if rows:
        yield _batch(rows)


def _gathered(sums: DataFrame) -> dict[int, dict[int, list[int]]]:
    """{dimension: {part: whole numbers}}: partitions' sums meet by part, so that the driver gets each entry once."""
    met = sums.repartition(staging.partitions(sums.sparkSession), "dim", "part").mapInArrow(_merged, _SUMS)
    out: dict[int, dict[int, list[int]]] = {}
    for r in met.toLocalIterator():
        parts = [np.frombuffer(bytes(p), "<i8") for p in (r.low, r.middle, r.high)]
        one = _Sum((1, len(parts[0])))
        one.add_parts(parts)
        out.setdefault(r.dim, {})[r.part] = one.numbers()[0]
    return out


def rounds(n: int):
    """All pairs of 0 .. n - 1 in rounds of disjoint ones."""
    m = n + n % 2
    ring = np.arange(m)
    for _ in range(m - 1):
        p, q = np.minimum(ring[: m // 2], ring[m // 2 :][::-1]), np.maximum(ring[: m // 2], ring[m // 2 :][::-1])
        keep = q < n
        yield p[keep], q[keep]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def jacobi(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns.

    Rotations go on until every entry off the diagonal is below rounding beside the geometric mean of its two diagonal
    ones, which keeps small eigenvalues as accurate as the matrix says they are.
    """
    a, n = np.array(v, np.float64), len(v)
    turned = np.eye(n)
    eps = np.finfo(np.float64).eps
    floor = (eps * np.abs(a).max(initial=0.0)) * eps
    pairs = list(rounds(n))
    for _ in range(SWEEPS):
        moved = False
        for p, q in pairs:
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            some = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(dp * dq)), floor)
            if not some.any():
                continue
            moved = True
            p, q, off, dp, dq = p[some], q[some], off[some], dp[some], dq[some]
            theta = (dq - dp) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            ap, aq = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            ap, aq = a[p, :].copy(), a[q, :].copy()
            a[p, :], a[q, :] = c[:, None] * ap - s[:, None] * aq, s[:, None] * ap + c[:, None] * aq
            a[p, p], a[q, q] = dp - t * off, dq + t * off
            a[p, q] = a[q, p] = 0.0
            up, uq = turned[:, p].copy(), turned[:, q].copy()
            turned[:, p], turned[:, q] = c * up - s * uq, s * up + c * uq
        if not moved:
            break
    else:
        raise ArithmeticError(f"entries off the diagonal are left after {SWEEPS} sweeps")
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], turned[:, order] / np.linalg.norm(turned[:, order], axis=0)


@dataclasses.dataclass
class Whitener:
    """Of vectors of one length: number of rows, sums, centre (whole numbers), eigenvalues and eigenvectors (columns), the first ones."""

    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rest(self) -> np.ndarray:
        """n times what the centre's rounding leaves of the means."""
        return np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)], object)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - sums) ** 2."""
        y, rest = x - self.centre, self.rest
        most = max(self.n * int(np.abs(y).max(initial=0)) + max((abs(r) for r in rest), default=0), 1)
        if most**2 * max(1, x.shape[1]) < 1 << 63:
            d = self.n * y - rest.astype(np.int64)
            return np.einsum("nd,nd->n", d, d).tolist()
        d = self.n * y.astype(object) - rest
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, components)"""
        off = np.array([float(r) / self.n for r in self.rest])
        return ((x - self.centre).astype(np.float64) - off) @ (self.vectors / np.sqrt(self.values))


def _fitted(n: int, sums: list[int], centre: np.ndarray, scatter: dict[int, list[int]], components: int) -> Whitener:
    dim = len(sums)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    v = np.array([[(n * scatter[i][j] - rest[i] * rest[j]) / (n * n) for j in range(dim)] for i in range(dim)]).reshape(dim, dim)
    values, found = jacobi(v)
    real = values > dim * np.finfo(np.float64).eps * max(values.max(initial=0.0), 0.0)
    some = np.flatnonzero(real)[:components]
    return Whitener(n, sums, centre, values[some], found[:, some], float(np.trace(v)))


def fit(rows: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitener]:
    """{dimension: Whitener}, of all rows whose vector is usable."""
    usable = rows.select(F.col(vec_col)).where(vectors.usable(vec_col))
    totals = {dim: parts[0] for dim, parts in _gathered(usable.mapInArrow(_totals, _SUMS)).items()}
    centres = {dim: np.array([(2 * s + t[-1]) // (2 * t[-1]) for s in t[:-1]], np.int64) for dim, t in totals.items()}
    scatter = _gathered(usable.mapInArrow(_scatter(centres), _SUMS))
    return {dim: _fitted(t[-1], t[:-1], centres[dim], scatter.get(dim, {}), components) for dim, t in totals.items()}


def transform(rows: DataFrame, fitted: dict[int, Whitener], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, n, deviation, whitened: an array), a row for each usable vector of a length that was fitted."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    @tidy
    def run(batches):
        for batch in batches:
            for dim, at, x in _steps(batch, 1):
                if (w := sent.value.get(dim)) is None:
                    continue
                y = w.project(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
                columns = [batch.column(0).take(pa.array(at)), pa.array([dim] * len(at), pa.int32()), pa.array([w.n] * len(at), pa.int64()), pa.array(w.deviations(x), pa.int64()), lists]
                yield pa.record_batch(columns, names=["vec_id", "dim", "n", "deviation", "whitened"])

    usable = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where(vectors.usable("vec"))
    return usable.mapInArrow(run, "vec_id long, dim int, n long, deviation long, whitened array<double>")


def identity_errors(white: DataFrame) -> dict[int, float]:
    """{dimension: the largest entry in size of the covariance of whitened minus the identity}."""

    @tidy
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for k, rows, y in vectors.by_length(batch.column(1)):
                y = np.concatenate([y, np.ones((len(y), 1))], axis=1)
                for dim in np.unique(at[rows]):
                    part = y[at[rows] == dim]
                    sums[int(dim)] = sums.get(int(dim), np.zeros((k + 1, k + 1))) + part.T @ part
        rows = [(dim, i, j, s[i, j]) for dim, s in sums.items() for i in range(len(s)) for j in range(len(s))]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["dim", "i", "j", "s"])

    sums: dict[int, dict[tuple[int, int], float]] = {}
    for r in white.select("dim", "whitened").mapInArrow(run, "dim long, i long, j long, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():  # entries of a matrix for each dimension
        sums.setdefault(r.dim, {})[r.i, r.j] = r.s
    out = {}
    for dim, s in sums.items():
        k = max(i for i, _ in s)
        n = s[k, k]
        out[dim] = max((abs(s[i, j] / n - s[i, k] / n * s[j, k] / n - (i == j)) for i in range(k) for j in range(k)), default=0.0)
    return out


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each usable vector and component."""
    spark = rows.sparkSession
    fitted = fit(rows, vec_col, components)
    with staging.scope() as kept:
        white = staging.stage(transform(rows, fitted, id_col, vec_col), "whitened")
        kept.append(white)
    errors = identity_errors(white)
    parts = [(dim, [float(v) / w.trace for v in w.values], errors.get(dim)) for dim, w in fitted.items()]
    shares = spark.createDataFrame(parts, "dim int, shares array<double>, identity_error double")  # a row for each length of vectors
    each = white.select("vec_id", "dim", "n", "deviation", F.posexplode("whitened").alias("place", "whitened")).join(F.broadcast(shares), "dim")
    return each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("shares", F.col("place")).alias("explained"), "identity_error")
