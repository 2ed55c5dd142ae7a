"""Near-duplicate vectors by a pigeonhole over subspaces.

Vectors of cosine c are unit vectors at a squared distance of 2 - 2c. After a fixed rotation the coordinates are cut
into blocks; a pair within the total budget is within a block's share of it (in proportion to the block's dimensions)
in one block at least. In each block, a grid on its leading coordinates (cells twice as wide as the range, so that a
point looks into two cells along each; the more vectors a label has, the more coordinates) brings points to those that
may be in range. Where they meet, a tree that halves the points along any of the block's coordinates, and then the
coordinates one by one, leave few pairs whose distance in the block is computed. What any block finds is verified exactly
on whole vectors, by the first block only that has the pair.

Equal vectors of a label are one class with a weight. A cell with many points is dealt out in parts of bounded size.
Candidates travel as lists of points that meet, and come back as counts and as edges that span what is linked: pairs
are never written out.

Vectors that are null, zero, or hold null or non-finite components, and rows without label, link with nothing; so do
vectors of different length. Rows are vectors: repeated rows link with each other. Rows that share an id share a
component. Rows with a null id count as others' links, and have a null component. An empty table gives an empty one.
Vectors may be of any length; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions.arrow import tidy
from sluice.llm import components, vectors

#: Dimensions of a block, leading coordinates that the grid has at least, points that a part of a cell has about, and points that look into it at a time.
BLOCK, GRID, PART, PROBES = 8, 3, 4096, 1024
#: Classes of a label from which the grid has a coordinate more, for each of so many times as many; pairs that the tree leaves together.
DEEPER, TIMES, LEAF = 100_000, 2, 1 << 15


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _blocks(d: int, budget: float) -> list[tuple[slice, float]]:
    n = max(1, d // BLOCK)
    cuts = [round(d * i / n) for i in range(n + 1)]
    return [(slice(a, b), budget * (b - a) / d) for a, b in itertools.pairwise(cuts)]


@tidy
def _packed(batches):
    """(id, label, vector) to (id, label, dim, vec): the components as bytes, in doubles."""
    for batch in batches:
        for d, rows, x in vectors.by_length(batch.column(2)):
            ok = np.einsum("nd,nd->n", x, x) > 0
            at = pa.array(rows[ok])
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array([d] * len(at), pa.int32()), pa.array([v.tobytes() for v in x[ok]], pa.binary())], names=["vec_id", "label", "dim", "vec"])


def _units(vecs: list[bytes], d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h ^= p.astype(np.int64).view(np.uint64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _within(p: np.ndarray, h: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (row of p, row of h) whose squared distance is share at most, and how many distances were computed."""
    reach, measured = np.sqrt(share), 0
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    todo = [(np.arange(len(p)), np.arange(len(h)))]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) > LEAF:
            spread = np.ptp(h[b], axis=0)
            c = int(np.argmax(spread))
            x, y = h[b, c], p[a, c]
            middle = np.median(x)
            low = x <= middle
            if spread[c] > 2 * reach and not low.all():
                todo += [(a[y <= middle + reach], b[low]), (a[y >= middle - reach], b[~low])]
                continue
        i, j = np.nonzero(np.abs(p[a, 0][:, None] - h[b, 0][None, :]) <= reach)
        i, j = a[i], b[j]
        for c in range(1, p.shape[1]):
            keep = np.abs(p[i, c] - h[j, c]) <= reach
            i, j = i[keep], j[keep]
        measured += len(i)
        close = ((p[i] - h[j]) ** 2).sum(axis=1) <= share
        found.append((i[close], j[close]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found]), measured


def _cells(budget: float):
    """Classes (cid, label, dim, vec, depth) to rows (dim, block, cell, probe, cid, near): a home in each block, and the cells a point looks into."""

    @tidy
    def run(batches):
        for batch in batches:
            cid, label, dims = (batch.column(i).to_numpy() for i in range(3))
            depths = batch.column(4).to_numpy()
            for d, depth in {*zip(dims.tolist(), depths.tolist(), strict=True)}:
                rows = np.flatnonzero((dims == d) & (depths == depth))
                x = _units([batch.column(3)[int(i)].as_py() for i in rows], d) @ _rotation(d)
                for b, (cut, share) in enumerate(_blocks(d, budget)):
                    y = x[:, cut]
                    near = y.astype("<f4")
                    reach = np.sqrt(share) * (1 + 1e-6) + 1e-9
                    lead = y[:, :depth]
                    home = np.floor(lead / (2 * reach)).astype(np.int64)
                    low, high = np.floor((lead - reach) / (2 * reach)).astype(np.int64), np.floor((lead + reach) / (2 * reach)).astype(np.int64)
                    for probe, corner in [(0, None), *((1, c) for c in itertools.product((0, 1), repeat=lead.shape[1]))]:
                        at, new = (home, np.ones(len(rows), bool)) if corner is None else (np.where(corner, high, low), ~((high == low) & np.array(corner, bool)).any(axis=1))
                        cell = _mix(label[rows], *at.T)[new]
                        n = len(cell)
                        yield pa.record_batch([pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(cell), pa.array(np.full(n, probe, np.int32)), pa.array(cid[rows][new]), pa.array([v.tobytes() for v in near[new]], pa.binary())], names=["dim", "block", "cell", "probe", "cid", "near"])

    return run


def _meetings(budget: float):
    """Rows in the order of dim, block, cell, part, probe: homes, then those that look in. Gives the points that meet, as lists of classes."""

    @tidy
    def run(batches):
        made, key, homes = TaskContext.get().partitionId() << 32, None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)  # dim, block, cell, part, probe
            cid, near = batch.column(5).to_numpy(), batch.column(6)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]) if len(keys) else [0]
            for a, z in itertools.pairwise(cuts):
                d, b, cell, part, probe = keys[a].tolist()
                raw = b"".join(near[int(a) : int(z)].to_pylist())
                y = np.frombuffer(raw, "<f4").reshape(z - a, -1)
                if key != (d, b, cell, part):
                    key, homes = (d, b, cell, part), []
                if not probe:
                    homes.append((cid[a:z], y))
                    continue
                if not homes:
                    continue
                if len(homes) > 1:
                    homes = [(np.concatenate([h[0] for h in homes]), np.concatenate([h[1] for h in homes]))]
                h_id, h = homes[0]
                share = _blocks(d, budget)[b][1] * (1 + 1e-5) + 1e-6
                for at in range(0, z - a, PROBES):
                    p_id, p = cid[a:z][at : at + PROBES], y[at : at + PROBES]
                    i, j, _ = _within(p, h, share)
                    other = p_id[i] != h_id[j]
                    left, right = np.unique(i[other]), np.unique(j[other])
                    if len(left):
                        yield pa.record_batch([pa.array([made], pa.int64()), pa.array([d], pa.int32()), pa.array([b], pa.int32()), pa.array([p_id[left].tolist()], pa.list_(pa.int64())), pa.array([h_id[right].tolist()], pa.list_(pa.int64()))], names=["task", "dim", "block", "probes", "homes"])
                        made += 1

    return run


def _verify(threshold: float, budget: float):
    """Rows in the order of task, side: (task, block, side, cid, label, dim, weight, rep, vec). Gives (cid, links) and edges (a, b) between classes' ids."""

    def finish(block, rows):
        sides = [[r for r in rows if r[0] == s] for s in (0, 1)]
        d = rows[0][3]
        (pu, hu), rot = [_units([r[6] for r in s], d) for s in sides], _rotation(d)
        p, h = sides
        linked = pu @ hu.T >= threshold
        linked &= np.array([r[2] for r in p])[:, None] == np.array([r[2] for r in h])[None, :]
        linked &= np.array([r[1] for r in p])[:, None] != np.array([r[1] for r in h])[None, :]
        pr, hr = pu @ rot, hu @ rot
        for b, (cut, share) in enumerate(_blocks(d, budget)[: block + 1]):  # the first block that has the pair counts it
            x, y = pr[:, cut], hr[:, cut]
            within = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) <= share * (1 + 1e-9) + 1e-12
            linked &= within if b == block else ~within
        counts = linked @ np.array([r[4] for r in h], np.int64)
        at = np.flatnonzero(counts)
        edges = components.spanning(linked) if len(at) else []
        n, m = len(at), len(edges)
        yield pa.record_batch(
            [
                pa.array([p[i][1] for i in at] + [None] * m, pa.int64()),
                pa.array(counts[at].tolist() + [None] * m, pa.int64()),
                pa.array([None] * n + [p[i][5] for i, _ in edges], pa.int64()),
                pa.array([None] * n + [h[j][5] for _, j in edges], pa.int64()),
            ],
            names=["cid", "links", "a", "b"],
        )

    @tidy
    def run(batches):
        now, block, rows = None, 0, []
        for batch in batches:
            for task, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != now:
                    if rows:
                        yield from finish(block, rows)
                    now, block, rows = task, b, []
                rows.append(row)
        if rows:
            yield from finish(block, rows)

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of rows. A staged table."""
    with staging.scope() as kept:
        out = staging.stage(_linked(rows, threshold, id_col, vec_col, label_col), "near-vectors")
        kept.append(out)
    return out


def _linked(rows: DataFrame, threshold: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    spark = rows.sparkSession
    n, budget = staging.partitions(spark), (2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    plain = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    takes = F.col("label").isNotNull() & vectors.usable("vec") & (F.size("vec") > 0)
    packed = plain.where(takes).mapInArrow(_packed, "vec_id long, label long, dim int, vec binary")
    classes = packed.groupBy("label", "dim", "vec").agg(F.count("*").alias("weight"), F.min("vec_id").alias("rep")).withColumn("cid", F.monotonically_increasing_id())
    classes = staging.stage(classes, "vectors")
    # as many labels as there are, each with its number of classes
    sizes = classes.groupBy("label").agg(F.count("*").alias("n"))
    more = F.ceil(F.log(F.col("n") / F.lit(DEEPER)) / F.lit(float(np.log(TIMES))))
    sizes = sizes.select("label", F.greatest(F.lit(GRID), F.least(F.lit(BLOCK), F.lit(GRID) + more)).cast("int").alias("depth"))
    deep = classes.select("cid", "label", "dim", "vec").join(sizes, "label")
    cells = staging.stage(deep.select("cid", "label", "dim", "vec", "depth").mapInArrow(_cells(budget), "dim int, block int, cell long, probe int, cid long, near binary"), "cells")
    key = ["dim", "block", "cell"]
    full = cells.where("probe = 0").groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    both = cells.join(full, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("probe") == 0, F.array(F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = both.withColumn("part", F.explode(part)).select(*key, "part", "probe", "cid", "near").repartition(n, *key, "part").sortWithinPartitions(*key, "part", "probe")
    tasks = staging.stage(dealt.mapInArrow(_meetings(budget), "task long, dim int, block int, probes array<long>, homes array<long>"), "meetings")
    sides = tasks.select("task", "block", F.lit(0).alias("side"), F.explode("probes").alias("cid")).unionByName(tasks.select("task", "block", F.lit(1).alias("side"), F.explode("homes").alias("cid")))
    full_rows = sides.join(classes, "cid").select("task", "block", "side", "cid", "label", "dim", "weight", "rep", "vec").repartition(n, "task").sortWithinPartitions("task", "side")
    found = staging.stage(full_rows.mapInArrow(_verify(threshold, budget), "cid long, links long, a long, b long"), "links")
    links = found.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "cid", "left").select("label", "dim", "vec", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    members = packed.where("vec_id is not null").join(of_class, ["label", "dim", "vec"]).select("vec_id", "rep", "n_links")
    # ids that stand for several classes tie these together
    several = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("vec_id", "a")
    ties = members.join(several, "vec_id").select("a", F.col("rep").alias("b"))
    comps = components.connected(found.where("a is not null").select("a", "b").unionByName(ties)).withColumnRenamed("node", "rep")
    linked = members.join(comps, "rep", "left").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component_id"))
    rest = plain.where(~takes | F.col("vec_id").isNull() | F.forall("vec", lambda x: x == 0)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
