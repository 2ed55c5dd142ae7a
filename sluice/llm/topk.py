"""Exact top-k by inner product, a set of queries against all rows in blocks.

In each pair of a query block and a candidate block, bounds from segment means and deviations are computed for few
long segments first, then for more and shorter ones (by Cauchy-Schwarz on the deviations, a segment of length L adds
L (m m' + s s') to the inner product at most; in distances, (m - m')^2 + (s - s')^2 times L at least). Only rows whose
bound reaches the k-th best score known so far, by this pair of blocks or by those before it in the task, are looked at
more finely, and survivors get their exact score. How many survive depends on the data: where all directions are alike,
only the finest segments tell rows apart.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; a query's own id
is not among its results, and vectors of another length aren't either. Repeated query rows are answered each by
itself, repeated candidate rows count each. Ties go to the smaller id. Components are taken as floor(256 x); scores are
exact while they are below 2**63. Empty tables give an empty one; vectors may be of any length; other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions.arrow import tidy
from sluice.llm import vectors

#: Segments of each resolution, rows of a block, query blocks whose k-th scores a task remembers, pairs that are scored one by one at a time, pairs of blocks of an Arrow batch.
SEGMENTS = (1, 4, 16, 32)
QUERY_BLOCK, ROW_BLOCK, REMEMBERED, PAIRS, MET = 1024, 8192, 1000, 1 << 16, 16


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold all of them."""
    low, high = x.min(initial=0), x.max(initial=0)
    return x.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _wide(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (rows * dim) if dim else 8}").astype(np.int64).reshape(rows, dim)


def grid(row_blocks: int, query_blocks: int, tasks: int) -> tuple[int, int]:
    """Groups of row blocks and of query blocks, a pair of groups for each task about, so that few copies of blocks travel: rows go to
    each group of queries and queries to each group of rows."""
    most = max(1, min(row_blocks, tasks))
    by_row = min(most, max(1, round((tasks * row_blocks * ROW_BLOCK / max(1, query_blocks * QUERY_BLOCK)) ** 0.5)))
    return by_row, max(1, min(query_blocks, -(-tasks // by_row)))


def _blocks(size: int):
    """Rows (id, vector) to blocks (block, dim, n, ids, data) of whole numbers."""

    @tidy
    def run(batches):
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for d, rows, x in vectors.by_length(batch.column(1)):
                whole = np.floor(256 * x).astype("<i8")
                for at in range(0, len(rows), size):
                    part = rows[at : at + size]
                    yield pa.record_batch([pa.array([made], pa.int64()), pa.array([d], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()], pa.binary()), pa.array([_narrow(whole[at : at + size])], pa.binary())], names=["block", "dim", "ids", "data"])
                    made += 1

    return run


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose products with those of another matrix, added up, bound the rows' inner products from above."""
    means, deviations = [], []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        root = np.sqrt(part.shape[1])
        means.append(part.mean(axis=1) * root)
        deviations.append(part.std(axis=1) * root)
    return np.stack(means + deviations, axis=1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums stay below 2**53, else in 64-bit numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if most < 2**53 else q @ x.T


def _exact(q: np.ndarray, x: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row, score) of the survivors: pair by pair if they are few, else by products with the rows that any query needs."""
    i, j = np.nonzero(alive)
    if len(i) * 8 < alive.size:
        parts = [_pairwise(q[i[a : a + PAIRS]], x[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)]
        return i, j, np.concatenate([np.empty(0, np.int64), *parts])
    columns = np.flatnonzero(alive.any(axis=0))
    place = np.empty(len(x), np.int64)
    place[columns] = np.arange(len(columns))
    return i, j, _scores(q, x[columns])[i, place[j]]


def _pairwise(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", q, x)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, best: np.ndarray | None = None):
    """(query number, id, score) of each query's k best in the block, where they reach best, and how many pairs were scored.

    best: a score that k rows of other blocks reach, for each query; it is raised by what is found here.
    """
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    best = np.full(len(q), -np.inf) if best is None else best
    alive = q_ids[:, None] != ids[None, :]
    for s in SEGMENTS:
        if s > 1 and s >= q.shape[1]:
            break
        bound = _stats(qf, s) @ _stats(xf, s).T
        bound += 1e-9 * np.abs(bound) + 1
        bound[~alive] = -np.inf
        if s == SEGMENTS[0] or s == SEGMENTS[-2]:  # the rows of the highest bounds give k scores
            seeds = min(k, bound.shape[1])
            top = np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds]
            score = np.einsum("qd,qkd->qk", qf, xf[top])
            score[~np.take_along_axis(alive, top, 1)] = -np.inf
            if seeds == k:
                least = score.min(axis=1)
                np.maximum(best, np.where(np.isfinite(least), least - np.abs(least) * 1e-12, least), out=best)
        alive &= bound >= best[:, None]
    i, j, score = _exact(q, x, alive)
    out = []
    cuts = np.searchsorted(i, np.arange(len(q) + 1))
    for n in range(len(q)):
        at, value = j[cuts[n] : cuts[n + 1]], score[cuts[n] : cuts[n + 1]]
        if len(at) > k:
            keep = value >= np.partition(value, len(value) - k)[len(value) - k]
            at, value = at[keep], value[keep]
        found = ids[at]
        order = np.lexsort((found, -value))[:k]
        out += [(n, int(found[m]), int(value[m])) for m in order]
        if len(order) == k:
            best[n] = max(best[n], float(value[order[-1]]))
    return out, len(i)


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of rows, all if there are fewer; ties go to the smaller id. A staged table."""
    with staging.scope() as kept:
        found = _searched(rows, queries, k, id_col, vec_col)
        with staging.small_batches(rows.sparkSession, MET):  # rows of these batches hold two blocks each
            out = staging.stage(found, "top")
        kept.append(out)
    return out


def _searched(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    spark = rows.sparkSession

    def blocks(df: DataFrame, size: int, pack: bool) -> DataFrame:
        df = df.select(F.col(id_col).cast("long"), F.col(vec_col)).where(F.col(id_col).isNotNull() & vectors.usable(vec_col))
        if pack:
            df = df.repartition(max(1, -(-df.count() // size)))
        return staging.stage(df.mapInArrow(_blocks(size), "block long, dim int, ids binary, data binary"), "blocks")

    asked, stored = blocks(queries, QUERY_BLOCK, True), blocks(rows, ROW_BLOCK, False)
    parts = staging.partitions(spark)
    by_row, by_query = grid(stored.count(), asked.count(), 4 * parts)

    @tidy
    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, dim, q_ids, q, ids, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                q, x = _wide(q, len(q_ids), dim), _wide(x, len(ids), dim)
                if block not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[block] = np.full(len(q_ids), -np.inf)
                found, _ = search_block(q_ids, q, ids, x, k, known[block])
                if found:
                    n, i, s = zip(*found, strict=True)
                    n = np.array(n)
                    yield pa.record_batch([pa.array([block] * len(n), pa.int64()), pa.array(n.astype(np.int32)), pa.array(q_ids[n]), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["block", "n", "query_id", "vec_id", "score"])

    # every query block meets every row block, in the pair of their groups: the stated set against all rows. Blocks are few rows of
    # many bytes, so that no side may be broadcast and the tasks' number is fixed
    def dealt(df: DataFrame, own: str, groups: int, other: str, copies: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return df.repartition(parts, "r", "q_group", "dim")

    left = dealt(asked.select("block", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q")), "q_group", by_query, "r", by_row)
    right = dealt(stored, "r", by_row, "q_group", by_query).drop("block")
    pairs = left.hint("merge").join(right, ["r", "q_group", "dim"]).select("block", "dim", "q_ids", "q", "ids", "data")
    found = pairs.mapInArrow(run, "block long, n int, query_id long, vec_id long, score long")
    w = Window.partitionBy("block", "n").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
