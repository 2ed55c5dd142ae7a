"""Exact nearest neighbours with a metric's bounds: most cells of the other vectors are never compared.

1. Equal vectors of a class count as one point with a number, on both sides.
2. The other points are dealt to the nearest of some pivots (well spread ones of a bounded sample), and each pivot's
   points to rings by their distance from it: a unit is a bounded number of points with a smallest and a largest distance.
3. A point is compared with the nearest unit first, which gives it k distances. By the triangle inequality no point of a
   unit lies nearer than the gap between the point's distance from the pivot and the unit's distances, nor nearer than
   the plane halfway between two pivots says. Only units whose bound is within the k-th distance known are compared.
4. Points go to units in packed blocks that the same pivot has; one product of matrices compares a block with a unit, and
   the distances of pairs within the limit are then taken from differences. A block's limits shrink from unit to unit.

For the first unit blocks meet units by a join on the unit and one of a few salts, so that hot units are split. For the others a
block goes once to each group of units of which any may be near, and units go to each group of blocks: where no bound helps, all
points meet all units, but a point travels as often as there are groups (the root of the tasks' number about), not units. Vectors that are null or
hold null or non-finite entries, or of another length than the first, and rows without a class take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions import scalars, skew
from sluice.functions.arrow import tidy

#: Rows that pivots are chosen from and pivots at most; points of a unit about and units about at most; points of a block; digits that distances are ordered by; pairs whose differences are taken at a time; tasks that the blocks of one nearest unit are dealt to.
SAMPLE, PIVOTS, UNIT, UNITS, BLOCK, PLACES, PAIRS, SALTS = 16_384, 512, 4096, 100_000, 1024, 9, 1 << 16, 4


def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def points(df: DataFrame, name: str) -> DataFrame:
    """(vec, cls, n, pid): the distinct vectors of each class, as a staged table."""
    rows = df.select(scalars.doubles(F.col("vec")).alias("vec"), F.col("cls").cast("int").alias("cls")).where(usable(F.col("vec")) & F.col("cls").isNotNull())
    return staging.stage(rows.groupBy("vec", "cls").agg(F.count("*").alias("n")).withColumn("pid", F.monotonically_increasing_id()), name)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with vectors of this length, and these."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows, flat.reshape(len(rows), dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, by one product."""
    d = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


def _bytes(x: np.ndarray) -> bytes:
    """Numbers of four bytes if these are as exact."""
    with np.errstate(over="ignore"):
        less = x.astype("<f4")
    return less.tobytes() if (less == x).all() else x.astype("<f8").tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    """n vectors; packed with their dimension, so that the bytes of a number are known."""
    dim = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, f"<f{(len(data) - 4) // (n * dim)}", offset=4).astype(np.float64).reshape(n, dim)


def _data(x: np.ndarray) -> bytes:
    return x.shape[1].to_bytes(4, "little") + _bytes(x)


def spread(x: np.ndarray, m: int) -> np.ndarray:
    """m of the rows, each the one farthest from those before it; fewer if the others are equal to these."""
    if not len(x):
        return x
    chosen, far = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < m and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def pivots_of(others: DataFrame, dim: int, n: int, unit: int, most: int = PIVOTS) -> np.ndarray:
    """Centres of a few rounds of means over a bounded sample, from well spread rows of it: two for as many rows as a unit has, so that where
    no bound helps a row meets no more units than that."""
    some = others.where(F.size("vec") == dim).orderBy(F.xxhash64("vec", "cls")).limit(SAMPLE).select("vec").toArrow()
    _, x = _matrix(some["vec"].combine_chunks(), dim)
    p = spread(x, min(most, max(1, -(-2 * n // unit))))
    for _ in range(5):
        own = distances(x, p).argmin(axis=1)
        sums, counts = np.zeros_like(p), np.bincount(own, minlength=len(p))
        np.add.at(sums, own, x)
        p = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], p)
    return p


_PLACED = "cell int, far double, pid long, cls int, n long, vec array<double>"


def _placed(df: DataFrame, pivots) -> DataFrame:
    """Points with the nearest pivot and the distance from it."""

    @tidy
    def run(batches):
        for batch in batches:
            p = pivots.value
            at, x = _matrix(batch.column(0), p.shape[1])
            d = distances(x, p)
            cell = d.argmin(axis=1)
            far = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            rest = [batch.column(i).take(pa.array(at)) for i in (3, 1, 2, 0)]
            yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(far), *rest], names=["cell", "far", "pid", "cls", "n", "vec"])

    return df.select("vec", "cls", "n", "pid").mapInArrow(run, _PLACED)


_UNIT = "unit long, cell int, low double, high double, size int, cls binary, n binary, data binary"


@tidy
def _packed(batches):
    """Rows (unit, cell, far, cls, n, vec) that come unit by unit to a row for each unit."""

    def made(unit, cell, rows):
        far, cls, n, x = (np.concatenate(c) for c in zip(*rows, strict=True))
        columns = [[unit], [cell], [float(far.min())], [float(far.max())], [len(far)], [cls.astype("<i4").tobytes()], [n.astype("<i8").tobytes()], [_data(x)]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["unit", "cell", "low", "high", "size", "cls", "n", "data"])

    held, now, cell = [], None, None
    for batch in batches:
        unit = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else []
        for a, b in zip(starts, [*starts[1:], len(unit)], strict=True):
            if held and unit[a] != now:
                yield made(now, cell, held)
                held = []
            now, cell = int(unit[a]), batch.column(1)[int(a)].as_py()
            part = batch.slice(int(a), int(b - a))
            vec = part.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
            held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(), vec))
    if held:
        yield made(now, cell, held)


def _units(others: DataFrame, pivots, n: int, points: int, unit: int, tasks: int) -> tuple[DataFrame, np.ndarray, int]:
    """Packed units with their group, part; (unit, cell, low, high, part) of each, UNITS about, however many points there are; and how many groups of blocks go with these groups."""
    per = max(unit, -(-n // UNITS))
    placed = staging.stage(_placed(others, pivots), "placed")
    cells = placed.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / F.lit(per)).cast("int")
    width = F.when(F.col("high") > F.col("low"), (F.col("far") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    # a row for each pivot
    ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", F.least(parts - 1, F.floor(width * parts).cast("int"))).drop("low", "high", "size")
    rings = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / F.lit(per)).cast("int").alias("pieces"))
    dealt = ringed.join(F.broadcast(rings), ["cell", "ring"])  # UNITS and PIVOTS rows at most
    piece = F.pmod(F.xxhash64("vec", "cls"), F.col("pieces"))
    rows = dealt.select(F.xxhash64("cell", "ring", piece).alias("unit"), "cell", "far", "cls", "n", "vec").repartition(staging.partitions(others.sparkSession), "unit").sortWithinPartitions("unit")
    packed = staging.stage(rows.mapInArrow(_packed, _UNIT), "units")
    by_unit, by_block = grid(packed.count(), points, n, tasks)
    packed = packed.withColumn("part", _part(by_unit))
    found = packed.select("unit", "cell", "low", "high", "part").collect()  # numbers of UNITS and PIVOTS units about
    return packed, np.array([(r.unit, r.cell, r.low, r.high, r.part) for r in found], dtype=[("unit", "i8"), ("cell", "i4"), ("low", "f8"), ("high", "f8"), ("part", "i8")]), by_block


def grid(units: int, points: int, others: int, tasks: int) -> tuple[int, int]:
    """Groups of units and of blocks, a pair of groups for each task about, with which the fewest points travel."""
    by_unit = min(max(1, units), tasks, max(1, round((tasks * others / max(1, points)) ** 0.5)))
    return by_unit, max(1, -(-tasks // by_unit))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("unit"), F.lit(parts))


_SENT = "unit long, block long, pid binary, cls binary, n binary, limit binary, data binary"
_SENT_TYPE = pa.schema([("unit", pa.int64()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("pid", "cls", "n", "limit", "data")])


def _gaps(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, pivots): the distance of each row from each pivot, and from the plane halfway between that and the nearest one."""
    square = distances(x, pivots)
    own = square.argmin(axis=1)
    apart = np.sqrt(distances(pivots, pivots))[own]
    plane = np.where(apart > 0, (square - np.take_along_axis(square, own[:, None], 1)) / (2 * np.where(apart > 0, apart, 1)), 0.0)
    return np.sqrt(square), plane


def bounds(x: np.ndarray, pivots: np.ndarray, units: np.ndarray) -> np.ndarray:
    """(rows, units): no point of the unit lies nearer to the row."""
    return _bounds(*_gaps(x, pivots), units["cell"], units["low"], units["high"])


def _bounds(d: np.ndarray, plane: np.ndarray, cell, low, high) -> np.ndarray:
    return np.maximum(np.maximum(d[:, cell] - high, low - d[:, cell]), np.maximum(plane[:, cell], 0.0))


def _far(limit: np.ndarray) -> np.ndarray:
    """What counts as within a limit."""
    return limit * (1 + 1e-9) + 1e-9


def _sent(pivots, units, first: bool, block: int):
    """Points (cell order) to packed blocks: for the nearest unit alone, or with limits for each group of units of which a limit reaches any."""

    @tidy
    def run(batches):
        for batch in batches:
            p, u = pivots.value, units.value
            pid, cls, n = (batch.column(i).to_numpy() for i in range(3))
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pid), -1)
            limit = np.full(len(pid), np.inf) if first else batch.column(4).to_numpy(zero_copy_only=False)
            for at in range(0, len(pid), block):
                rows = slice(at, at + block)
                low = bounds(x[rows], p, u)
                if first:
                    keys, want = u["unit"], np.arange(len(u))[None, :] == low.argmin(axis=1)[:, None]
                else:
                    near = low <= _far(limit[rows])[:, None]
                    keys = np.unique(u["part"])
                    want = np.stack([near[:, u["part"] == g].any(axis=1) for g in keys], axis=1)
                out = []
                for j in np.flatnonzero(want.any(axis=0)):
                    i = np.flatnonzero(want[:, j]) + at
                    out.append((int(keys[j]), int(pid[at]), pid[i].astype("<i8").tobytes(), cls[i].astype("<i4").tobytes(), n[i].astype("<i8").tobytes(), limit[i].astype("<f8").tobytes(), _data(x[i])))
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SENT_TYPE, strict=True)], schema=_SENT_TYPE)

    return run


def chosen(q: np.ndarray, q_cls: np.ndarray, x: np.ndarray, x_cls: np.ndarray, k: int, differ: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, point, distance) of each row's k nearest points, of another class if they must differ, ties to the smaller class."""
    square = distances(q, x)
    if differ:
        square[q_cls[:, None] == x_cls[None, :]] = np.inf
    most = min(len(x), k + 8)
    part = np.argpartition(square, most - 1, axis=1)[:, :most]
    near = np.take_along_axis(square, part, 1)
    exact = np.sqrt(((q[:, None, :] - x[part]) ** 2).sum(axis=2))
    exact[~np.isfinite(near)] = np.inf
    key = np.round(exact, PLACES)
    order = np.lexsort((x_cls[part], key), axis=1)[:, :k]
    part, exact, key = (np.take_along_axis(v, order, 1) for v in (part, exact, key))
    # as many points as were looked at may be as near as the k-th: such rows are sorted as a whole
    last = np.where(np.isfinite(exact[:, -1]), exact[:, -1], 0.0)
    for i in np.flatnonzero((near.max(axis=1) <= last**2 * (1 + 1e-9) + 1e-9) & (most < len(x))):
        d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
        d[~np.isfinite(square[i])] = np.inf
        whole = np.lexsort((x_cls, np.round(d, PLACES)))[:k]
        part[i], exact[i] = whole, d[whole]
    i, j = np.nonzero(np.isfinite(exact))
    return i, part[i, j], exact[i, j]


def _best(i: np.ndarray, d: np.ndarray, cls: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k first of each row i, by distance, ties to the smaller class, and which of them is a row's k-th."""
    order = np.lexsort((cls, np.round(d, PLACES), i))
    own = i[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < k], rank[rank < k] == k - 1


def within(q: np.ndarray, q_cls: np.ndarray, x: np.ndarray, x_cls: np.ndarray, k: int, differ: bool, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, point, distance) as chosen() gives them, of the points within a row's finite limit alone."""
    square, far = distances(q, x), _far(limit)
    rounding = 1e-12 * ((q**2).sum(axis=1) + (x**2).sum(axis=1).max(initial=0))
    i, j = np.nonzero(square <= (far**2 * (1 + 1e-9) + rounding)[:, None])
    if differ:
        other = q_cls[i] != x_cls[j]
        i, j = i[other], j[other]
    d = np.concatenate([np.empty(0), *(np.sqrt(((q[i[a : a + PAIRS]] - x[j[a : a + PAIRS]]) ** 2).sum(axis=1)) for a in range(0, len(i), PAIRS))])
    real = d <= far[i]
    i, j, d = i[real], j[real], d[real]
    best, _ = _best(i, d, x_cls[j], k)
    return i[best], j[best], d[best]


class Block:
    """A block of points with what is known to be nearest to them, of the units that it met one after another."""

    def __init__(self, pid, cls, limit, data, pivots: np.ndarray):
        self.pid, self.cls = np.frombuffer(pid, "<i8"), np.frombuffer(cls, "<i4")
        self.limit, self.x = np.frombuffer(limit, "<f8").copy(), _numbers(data, len(self.pid))
        self.gaps = _gaps(self.x, pivots)
        self.found = [np.empty(0, t) for t in (np.int64, np.float64, np.int32, np.int64)]
        self.compared = 0

    def meet(self, cell: int, low: float, high: float, x_cls: np.ndarray, n: np.ndarray, data: bytes, k: int, differ: bool) -> None:
        near = _bounds(*self.gaps, np.array([cell]), low, high)[:, 0] <= _far(self.limit)
        if not near.any():
            return
        x = _numbers(data, len(n))
        self.compared += int(near.sum()) * len(n)
        for rows, search in ((np.flatnonzero(near & np.isfinite(self.limit)), within), (np.flatnonzero(near & np.isinf(self.limit)), chosen)):
            if len(rows):
                i, j, d = search(self.x[rows], self.cls[rows], x, x_cls, k, differ, *([self.limit[rows]] if search is within else []))
                self.found = [np.concatenate(c) for c in zip(self.found, (rows[i], d, x_cls[j], n[j]), strict=True)]
        best, last = _best(*self.found[:3], k)
        self.found = [c[best] for c in self.found]
        i, d = self.found[0][last], self.found[1][last]
        self.limit[i] = np.minimum(self.limit[i], d)

    def finds(self, part: int) -> pa.RecordBatch:
        i, d, cls, n = self.found
        return _finds_of(self.pid, part, i, d, cls, n, self.compared)


_FOUND = "pid long, unit long, dist double, cls int, n long"


def _finds_of(pid: np.ndarray, unit: int, i: np.ndarray, d: np.ndarray, cls: np.ndarray, n: np.ndarray, compared: int) -> pa.RecordBatch:
    """What is near, and a row of dist NaN for the block that counts the pairs compared."""
    columns = [np.append(pid[i], pid[:1]), np.full(len(i) + 1, unit), np.append(d, np.nan), np.append(cls, -1).astype(np.int32), np.append(n, compared)]
    return pa.record_batch([pa.array(c) for c in columns], names=["pid", "unit", "dist", "cls", "n"])


def _finds(pid: np.ndarray, unit: int, q_cls: np.ndarray, q: np.ndarray, x_cls: np.ndarray, n: np.ndarray, x: np.ndarray, k: int, differ: bool):
    i, j, d = chosen(q, q_cls, x, x_cls, k, differ)
    return _finds_of(pid, unit, i, d, x_cls[j], n[j], len(n) * len(pid))


def _compared(k: int, differ: bool):
    """Blocks joined with their nearest units to finds."""

    @tidy
    def run(batches):
        for batch in batches:
            for unit, pid, q_cls, data, x_cls, n, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pid, q_cls, x_cls, n = np.frombuffer(pid, "<i8"), np.frombuffer(q_cls, "<i4"), np.frombuffer(x_cls, "<i4"), np.frombuffer(n, "<i8")
                yield _finds(pid, unit, q_cls, _numbers(data, len(pid)), x_cls, n, _numbers(other, len(n)), k, differ)

    return run


def _met(pivots, k: int, differ: bool):
    """Blocks joined with the units of a group, a block's rows together, to the k nearest of the group within the limits."""

    @tidy
    def run(batches):
        key, now = None, None
        for batch in batches:
            for part, block, pid, q_cls, limit, data, cell, low, high, x_cls, n, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (part, block):
                    if now is not None:
                        yield now.finds(key[0])
                    key, now = (part, block), Block(pid, q_cls, limit, data, pivots.value)
                now.meet(cell, low, high, np.frombuffer(x_cls, "<i4"), np.frombuffer(n, "<i8"), other, k, differ)
        if now is not None:
            yield now.finds(key[0])

    return run


def _with_all(others, k: int, differ: bool):
    """Points (vec, cls, pid) with the few that are broadcast."""

    @tidy
    def run(batches):
        for batch in batches:
            x_cls, n, x = others.value
            at, q = _matrix(batch.column(0), x.shape[1])
            cls, pid = batch.column(1).to_numpy()[at], batch.column(2).to_numpy()[at]
            for a in range(0, len(at), BLOCK):
                yield _finds(pid[a : a + BLOCK], 0, cls[a : a + BLOCK], q[a : a + BLOCK], x_cls, n, x, k, differ)

    return run


_NEAR = "array<struct<dist:double,cls:int,n:bigint>>"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(pid, near, compared): of all units' finds a point's k nearest, counting each as often as it occurs."""
    keep = k + 1  # the point itself may be among them
    real = ~F.isnan("dist")
    each = F.when(real, F.struct("dist", "cls", "n"))
    sets = found.groupBy("pid").agg(F.sort_array(F.collect_list(each)).alias("near"), F.sum(F.when(real, 0).otherwise(F.col("n"))).alias("compared"))  # k of each unit that was compared
    return sets.withColumn("near", F.slice("near", 1, keep))


def _first(near: Column, k: int) -> Column:
    """The first entries up to k in number, the last one cut."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.array().cast(_NEAR).alias("out"))
    add = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["seen"] < k, F.concat(s["out"], F.array(F.struct(x["dist"].alias("dist"), x["cls"].alias("cls"), F.least(x["n"], k - s["seen"]).alias("n"))))).otherwise(s["out"]).alias("out"))
    return F.aggregate(near, start, add)["out"]


def _without_itself(near: Column, cls: Column) -> Column:
    """One copy of the point's own class at no distance less."""
    fewer = F.transform(near, lambda x, i: F.struct(x["dist"].alias("dist"), x["cls"].alias("cls"), F.when((x["dist"] == 0) & (x["cls"] == cls), x["n"] - 1).otherwise(x["n"]).alias("n")))
    return F.filter(fewer, lambda x: x["n"] > 0)


def _finished(found: DataFrame, own: DataFrame, k: int, itself: bool) -> DataFrame:
    found = own.select("pid", "cls").join(found, "pid", "left").withColumns({"near": F.coalesce("near", F.array().cast(_NEAR)), "compared": F.coalesce("compared", F.lit(0).cast("long"))})
    if itself:
        found = found.withColumn("near", _without_itself(F.col("near"), F.col("cls")))
    return found.select("pid", _first(F.col("near"), k).alias("near"), "compared")


def nearest_points(own: DataFrame, others: DataFrame, k: int, differ: bool = False, itself: bool = False, unit: int = UNIT) -> DataFrame:
    """(pid, near, compared) of points own; a staged table. itself: own points are among the others, one copy of each doesn't count."""
    spark = own.sparkSession
    with staging.scope() as kept:
        first = others.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
        if not first.dim:
            out = staging.stage(own.select("pid", F.array().cast(_NEAR).alias("near"), F.lit(0).cast("long").alias("compared")), "nearest")
            kept.append(out)
            return out
        dim = first.dim
        send = spark.sparkContext.broadcast
        if first.n <= unit:  # one unit's points go to all
            few = others.where(F.size("vec") == dim).select("cls", "n", "vec").toArrow()
            sent = send((few["cls"].to_numpy(), few["n"].to_numpy(), _matrix(few["vec"].combine_chunks(), dim)[1]))
            found = own.select("vec", "cls", "pid").mapInArrow(_with_all(sent, k + itself, differ), _FOUND)
            out = staging.stage(_finished(_merged(found, k + itself), own, k, itself), "nearest")
            kept.append(out)
            return out
        pivots = send(pivots_of(others, dim, first.n, unit))
        parts = staging.partitions(spark)
        packed, table, by_block = _units(others, pivots, first.n, own.count(), unit, 2 * parts)
        units = send(table)
        near = k + itself

        placed = staging.stage(_placed(own, pivots).repartition(parts, "cell", F.pmod("pid", F.lit(16))).sortWithinPartitions("cell", "far"), "asked")
        with staging.small_batches(spark, 4 * BLOCK):
            blocks = placed.select("pid", "cls", "n", "vec").mapInArrow(_sent(pivots, units, True, BLOCK), _SENT)
            # rows of many bytes: none is broadcast, the tasks' number is fixed, and a unit's blocks are dealt to some tasks
            blocks = blocks.withColumn("b", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).repartition(parts, "unit", "b")
            sides = packed.select("unit", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("b"), F.col("cls").alias("o_cls"), F.col("n").alias("o_n"), F.col("data").alias("o_data"))
            met = blocks.hint("merge").join(sides.repartition(parts, "unit", "b"), ["unit", "b"])
            one = staging.stage(met.select("unit", "pid", "cls", "data", "o_cls", "o_n", "o_data").mapInArrow(_compared(near, differ), _FOUND), "compared")
        # the k-th distance that is known, counting copies; without k the row has no limit
        known = _merged(one, near)
        seen = F.aggregate("near", F.lit(0).cast("long"), lambda s, x: s + x["n"])
        limits = known.where(seen >= near).select("pid", F.get(F.col("near"), F.least(F.size("near"), F.lit(near)) - 1)["dist"].alias("limit"))
        rest = placed.join(limits, "pid", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))).repartition(parts, "cell", F.pmod("pid", F.lit(16))).sortWithinPartitions("cell", "far")
        blocks = rest.select("pid", "cls", "n", "vec", "limit").mapInArrow(_sent(pivots, units, False, BLOCK), _SENT).withColumnRenamed("unit", "part")
        blocks = blocks.select("part", F.pmod(F.xxhash64("block"), F.lit(by_block)).cast("int").alias("b"), "block", "pid", "cls", "limit", "data").repartition(parts, "part", "b")
        sides = packed.select("part", F.explode(F.sequence(F.lit(0), F.lit(by_block - 1))).alias("b"), "cell", "low", "high", F.col("cls").alias("o_cls"), F.col("n").alias("o_n"), F.col("data").alias("o_data")).repartition(parts, "part", "b")
        # few rows of many bytes: none is broadcast, and the tasks' number is fixed
        met = blocks.hint("merge").join(sides, ["part", "b"]).select("part", "block", "pid", "cls", "limit", "data", "cell", "low", "high", "o_cls", "o_n", "o_data")
        two = staging.stage(met.mapInArrow(_met(pivots, near, differ), _FOUND), "compared")
        # what the nearest units gave is within the limits, so that it is found again: of these only the numbers of pairs count
        one = one.where(F.isnan("dist"))
        out = staging.stage(_finished(_merged(one.unionByName(two), near), own, k, itself), "nearest")
        kept.append(out)
    return out


def nearest(rows: DataFrame, others: DataFrame | None = None, k: int = 1, differ: bool = False, unit: int = UNIT) -> DataFrame:
    """(row_id, cls, near, compared) from (row_id, vec, cls): near has (dist, cls, n) of the k nearest of the others, by distance to nine places, then class.

    Without others, rows are compared among themselves, none with itself. differ: only those of another class count.
    compared: pairs that were measured, those of a block of rows at its first one. Rows whose vector or class is unusable have null, those of another length nothing near. A staged table.
    """
    with staging.scope() as kept:
        own = points(rows, "points")
        against = own if others is None else points(others, "points")
        found = nearest_points(own, against, k, differ, others is None and not differ, unit)
        known = own.join(found, "pid", "left").select("vec", "cls", "n", "near", "compared")
        part = usable(scalars.doubles(F.col("vec"))) & F.col("cls").isNotNull()
        plain = rows.select("row_id", scalars.doubles(F.col("vec")).alias("vec"), F.col("cls").cast("int").alias("cls"))
        met = skew.join_counted(plain.where(part), staging.stage(known, "known"), ["vec", "cls"], "n", max(1, rows.count()))
        empty = plain.where(~F.coalesce(part, F.lit(False))).select("row_id", "cls", F.lit(None).cast(_NEAR).alias("near"), F.lit(None).cast("long").alias("compared"))
        out = staging.stage(met.select("row_id", "cls", "near", "compared").unionByName(empty), "neighbours")
        kept.append(out)
    return out


def kth_distance(near: Column, k: int) -> Column:
    """The distance of the k-th, null if there are fewer."""
    n = F.aggregate(near, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return F.when(n >= k, F.round(F.array_max(F.transform(near, lambda x: x["dist"])), PLACES))


def votes(near: Column) -> Column:
    """The most frequent class of those near, ties to the smaller one; null without any."""
    each = F.transform(F.array_distinct(F.transform(near, lambda x: x["cls"])), lambda c: F.struct(F.aggregate(F.filter(near, lambda x: x["cls"] == c), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"), (-c).alias("c")))
    return -F.array_max(each)["c"]


def edited(rows: DataFrame, k: int = 3, all_agree: bool = False, unit: int = UNIT) -> DataFrame:
    """(row_id, cls, vote, kept): a row stays if the vote of its k nearest other rows, or each of them, is for its own class. Rows that take no part, or have no other row, stay."""
    found = nearest(rows, None, k, unit=unit)
    vote = votes(F.col("near"))
    agree = F.forall("near", lambda x: x["cls"] == F.col("cls")) if all_agree else vote == F.col("cls")
    return found.select("row_id", "cls", vote.alias("vote"), F.coalesce(agree, F.lit(True)).alias("kept"))
