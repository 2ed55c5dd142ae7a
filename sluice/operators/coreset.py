"""Fewer rows of a large class that still cover it: a density filter, boundary scores, farthest-first centres, their quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions import ranking, scalars
from sluice.functions.arrow import tidy
from sluice.operators import clean, cluster, neighbours

#: Rows that one round's centres are chosen from on the driver.
CANDIDATES = 2048


def density_filter(dist: DataFrame, small: float = 0.001, percentile: float = 92.0, rate: float = 0.03, least: int = 50, seed: int = 42) -> DataFrame:
    """(row_id, cluster, dist, reason) of the rows that stay: all of clusters with a share of rows of small at most ("small"); of the
    others those as far from the centre as the percentile ("edge") and, of the rest, floor(rate n) at random, least at least ("sample").
    """
    sizes = dist.groupBy("cluster").agg(F.count("*").alias("n"))
    total = sizes.agg(F.ceil(F.sum("n") * F.lit(float(small))).alias("limit"))
    sized = sizes.crossJoin(F.broadcast(total)).select("cluster", "n", (F.col("n") <= F.col("limit")).alias("is_small"))  # one row
    ends = cluster.percentiles(dist, percentile).withColumn("limit", F.round("limit", 9))
    known = sized.join(ends, "cluster", "left")
    # as many rows as clusters
    rows = dist.join(cluster.few(known), "cluster")
    reason = F.when(F.col("is_small"), "small").when(F.col("dist") >= F.col("limit"), "edge")
    rows = rows.withColumn("reason", reason)
    chance = ranking.ranked(rows.where("reason is null"), ["cluster"], ranking.digest("row_id", seed=seed))
    picked = chance.where(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("n") * F.lit(float(rate))))).withColumn("reason", F.lit("sample"))
    names = ["row_id", "cluster", "dist", "reason"]
    return rows.where("reason is not null").select(*names).unionByName(picked.select(*names))


def boundary_scores(rows: DataFrame, others: DataFrame) -> DataFrame:
    """(row_id, dist, score): 1 / (1 + the distance to the nearest of the others)."""
    return cluster.nearest_other(rows, others).withColumn("score", F.round(1 / (1 + F.col("dist")), 9))


def pins(scored: DataFrame, n: int) -> DataFrame:
    """row_id of the n highest scores, ties to the smaller id."""
    return clean.top_by(scored.where("score is not null"), F.desc("score"), "row_id", n).select("row_id")


def _nearer(centres):
    """(row_id, vec, dist) with the distance to the nearest of the broadcast centres, if that is less."""

    @tidy
    def run(batches):
        tree = cluster.CentreTree.of(centres.value)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            at, _ = tree.nearest(x)
            d = np.sqrt(((x - tree.centres[at]) ** 2).sum(axis=1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.minimum(d, batch.column(2).to_numpy()))], names=["row_id", "vec", "dist"])

    return run


def greedy(ids: np.ndarray, x: np.ndarray, dist: np.ndarray, below: float, n: int) -> list[tuple[int, float]]:
    """(place, distance) of up to n rows, each the farthest from all centres, ties to the smaller id, for as long as that is one of these.

    below: no other row was farther than that; it is -1 where there is none. The first one is always among these.
    """
    dist, out = dist.copy(), []
    order = np.lexsort((ids, -dist))
    ids, x, dist, place = ids[order], x[order], dist[order], order
    while len(out) < n and len(ids):
        i = int(dist.argmax())
        if dist[i] <= 0 or (out and dist[i] <= below):
            break
        out.append((int(place[i]), float(dist[i])))
        dist = np.minimum(dist, np.sqrt(((x - x[i]) ** 2).sum(axis=1)))
    return out


def farthest_first(rows: DataFrame, n: int, start: DataFrame | None = None, candidates: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(row_id, rank, gap) of n centres, and (row_id, vec, dist) of all rows with the distance to the nearest centre.

    Each centre is the row that is farthest from all before it, start (row_id) included; without any, the row of the smallest id comes
    first, with a gap of null. A round takes the farthest rows to the driver and chooses among them for as long as no other row can be farther, so
    that the choice is that of a row at a time; then all rows' distances are brought up to date. Fewer than n are given
    if all rows are at centres. Rows with a null id or an unusable vector take no part.
    """
    spark = rows.sparkSession
    usable = rows.select(F.col("row_id").cast("long").alias("row_id"), scalars.doubles(F.col("vec")).alias("vec")).where(neighbours.usable(F.col("vec")) & F.col("row_id").isNotNull())
    found: list[tuple[int, int, float | None]] = []
    with staging.scope() as kept:
        state = usable.withColumn("dist", F.lit(float("inf")))
        first = None
        if start is not None:
            chosen = usable.join(start.select("row_id").distinct(), "row_id", "left_semi")
            near = neighbours.nearest(usable.withColumn("cls", F.lit(0)), chosen.select("vec", F.lit(1).alias("cls")))
            gap = near.select("row_id", F.coalesce(F.get("near", F.lit(0))["dist"], F.lit(float("inf"))).alias("dist"))
            state = staging.stage(usable.join(gap, "row_id").select("row_id", "vec", "dist"), "gaps")
            first = state.where("dist < double('inf')").limit(1).count()
        else:
            state = staging.stage(state, "gaps")
        if not first and n > 0:
            one = state.orderBy("row_id").limit(1).collect()
            if one:
                found.append((one[0].row_id, 1, None))
                state = _updated(spark, state, np.array([one[0].vec]))
        while len(found) < n:
            top = state.where("dist > 0").orderBy(F.desc("dist"), "row_id").limit(candidates + 1).collect()
            below = top[-1].dist if len(top) > candidates else -1.0
            some = top[:candidates]
            if not some:
                break
            x = np.array([r.vec for r in some])
            picked = greedy(np.array([r.row_id for r in some]), x, np.array([r.dist for r in some]), below, n - len(found))
            found += [(some[i].row_id, len(found) + j + 1, gap) for j, (i, gap) in enumerate(picked)]
            state = _updated(spark, state, x[[i for i, _ in picked]])
        kept.append(state)
    return spark.createDataFrame(found, "row_id long, rank int, gap double"), state


def _updated(spark, state: DataFrame, centres: np.ndarray) -> DataFrame:
    out = staging.stage(state.mapInArrow(_nearer(spark.sparkContext.broadcast(centres)), "row_id long, vec array<double>, dist double"), "gaps")
    staging.drop(state)
    return out


def select(rows: DataFrame, others: DataFrame, budget: int, pin_share: float = 0.3, candidates: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(row_id, role, score) of the budget's rows, role "pin" or "core", and (row_id, dist, score) of all rows.

    Pins are the rows nearest to the other class; cores are chosen farthest first from these and each other.
    """
    with staging.scope() as kept:
        scored = staging.stage(boundary_scores(rows, others), "scored")
        pinned = staging.stage(pins(scored, int(budget * pin_share)), "pins")
        cores, state = farthest_first(rows, budget - pinned.count(), pinned, candidates)
        chosen = pinned.select("row_id", F.lit("pin").alias("role")).unionByName(cores.select("row_id", F.lit("core").alias("role")))
        out = staging.stage(chosen.join(scored.select("row_id", "score"), "row_id"), "coreset")
        gaps = staging.stage(state.select("row_id", "dist").join(scored.select("row_id", "score"), "row_id"), "gaps")
        kept += [out, gaps]
    return out, gaps


def quality(gaps: DataFrame, chosen: DataFrame, clusters: DataFrame, small: float = 0.001) -> DataFrame:
    """One row: rows chosen and pinned, the covering radius (distance to the nearest chosen row) at 50, 90, 95 and 100 %, clusters and how many of them, and of the
    small ones, have a chosen row, and the mean boundary score of those chosen. clusters: (row_id, cluster)."""
    whole = gaps.select(F.lit(0).alias("cluster"), F.col("dist"))
    radius = None
    for name, p in (("radius_p50", 50.0), ("radius_p90", 90.0), ("radius_p95", 95.0), ("radius_max", 100.0)):
        one = cluster.percentiles(whole, p).agg(F.round(F.max("limit"), 9).alias(name))
        radius = one if radius is None else radius.crossJoin(F.broadcast(one))  # one row each
    marked = clusters.join(chosen.select("row_id", "role", "score"), "row_id", "left")
    each = marked.groupBy("cluster").agg(F.count("*").alias("n"), F.count("role").alias("kept"))
    total = each.agg(F.ceil(F.sum("n") * F.lit(float(small))).alias("limit"))
    is_small, has = F.col("n") <= F.col("limit"), F.col("kept") > 0
    cover = each.crossJoin(F.broadcast(total)).agg(F.count("*").alias("clusters"), F.count_if(has).alias("clusters_kept"), F.count_if(is_small).alias("small_clusters"), F.count_if(is_small & has).alias("small_kept"))
    picked = chosen.agg(F.count("*").alias("chosen"), F.count_if(F.col("role") == "pin").alias("pins"), F.round(F.avg("score"), 9).alias("mean_score"))
    return picked.crossJoin(F.broadcast(radius)).crossJoin(F.broadcast(cover))  # one row each
