"""Connected components of a graph that is a table of edges, by alternating large and small stars.

Every node's edges move to the smallest node that it knows; no neighbourhood is gathered in one place, and a hub's
rows are minima (combined before the shuffle) and a join that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions.arrow import tidy

#: Edges up to which a graph is joined up by one task, which then holds some tens of MB; larger ones take the rounds.
FEW = 200_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large: larger neighbours of u move to u's smallest; small: smaller ones and u itself do."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = edges.join(least, "u")
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.where("u > v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


@tidy
def _joined(batches):
    """All edges (u, v) of a small graph to (node, component)."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        yield pa.record_batch([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64())], names=["node", "component"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node of edges (a long, b long), nulls and loops aside.

    Repeated edges and both directions are allowed; no edges give no rows. The result is a staged table.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = staging.stage(now, "components")
    if now.limit(FEW + 1).count() <= FEW:
        out = staging.stage(now.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
    else:
        before, mark = None, _print(now)
        while mark != before:
            grown = staging.stage(_stars(now, True), "components")
            after = staging.stage(_stars(grown, False), "components")
            staging.drop(grown)
            staging.drop(now)
            now, before, mark = after, mark, _print(after)
        out = staging.stage(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    staging.drop(now)
    return out


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the matrix connects, as few as can be."""
    out, rows, columns = [], linked.any(axis=1), linked.any(axis=0)
    while rows.any():
        first = int(np.argmax(rows))
        new_r, seen_c = np.zeros(len(rows), bool), np.zeros(len(columns), bool)
        new_r[first], rows[first] = True, False
        while True:
            front = np.flatnonzero(new_r)
            reach = linked[front].any(axis=0) & ~seen_c
            at = np.flatnonzero(reach)
            out += zip(front[np.argmax(linked[np.ix_(front, at)], axis=0)].tolist(), at.tolist(), strict=True)
            seen_c |= reach
            new_r = linked[:, at].any(axis=1) & rows
            back = np.flatnonzero(new_r)
            out += zip(back.tolist(), at[np.argmax(linked[np.ix_(back, at)], axis=1)].tolist(), strict=True) if len(at) else []
            rows &= ~new_r
            if not len(back):
                break
    return out
