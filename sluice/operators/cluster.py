"""Representatives of clusters under a budget. Tables are (row_id, cluster, vec or dist); centers are (cluster, center)."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions import ranking, scalars
from sluice.functions.arrow import tidy
from sluice.operators import neighbours

#: Centres up to which these are broadcast; beyond it the join is left to the planner.
FEW = 20_000


def centers_of(df: DataFrame, cluster: str, vec: str, dim: int, places: int = 6) -> DataFrame:
    """(cluster, center): means by component, rounded so that they don't depend on the order of sums."""
    means = df.groupBy(F.col(cluster).alias("cluster")).agg(*(F.bround(F.avg(F.get(vec, F.lit(i)).cast("double")), places).alias(f"c{i}") for i in range(dim)))
    return means.select("cluster", F.array(*(f"c{i}" for i in range(dim))).alias("center"))


def few(centers: DataFrame) -> DataFrame:
    return F.broadcast(centers) if centers.limit(FEW + 1).count() <= FEW else centers


def dist_to_center(rows: DataFrame, centers: DataFrame, places: int = 9) -> DataFrame:
    """(row_id, cluster, dist) from (row_id, cluster, vec)."""
    d = F.sqrt(scalars.squared_distance(scalars.doubles(F.col("vec")), F.col("center")))
    return rows.join(few(centers), "cluster").select("row_id", "cluster", F.round(d, places).alias("dist"))


def assign_nearest_center(rows: DataFrame, centers: DataFrame, places: int = 9) -> DataFrame:
    """(row_id, cluster) by the nearest centre, ties to the smaller cluster.

    Up to FEW centres go to the rows as one array; more are searched like other vectors, with a metric's bounds.
    """
    if centers.limit(FEW + 1).count() > FEW:
        own = rows.select("row_id", "vec", F.lit(-1).alias("cls"))
        found = neighbours.nearest(own, centers.select(F.col("center").alias("vec"), F.col("cluster").alias("cls")))
        return found.select("row_id", F.get("near", F.lit(0))["cls"].alias("cluster"))
    table = centers.agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("centers"))
    best = F.array_min(F.transform("centers", lambda c: F.struct(F.round(scalars.squared_distance(F.col("v"), c["center"]), places).alias("d2"), c["cluster"].alias("cluster"))))
    near = rows.select("row_id", scalars.doubles(F.col("vec")).alias("v")).crossJoin(F.broadcast(table))  # one row of a checked number of centres
    return near.select("row_id", best["cluster"].alias("cluster"))


def core_representatives(dist: DataFrame) -> DataFrame:
    """(row_id, cluster, dist) of the row nearest to each centre, ties to the smaller id."""
    best = dist.groupBy("cluster").agg(F.min(F.struct("dist", "row_id")).alias("m"))
    return best.select(F.col("m.row_id").alias("row_id"), "cluster", F.col("m.dist").alias("dist"))


#: Ranges of a cluster's distances that are counted before one of them is looked into.
RANGES = 1024


def percentiles(dist: DataFrame, percentile: float) -> DataFrame:
    """(cluster, limit): the linear percentile of each cluster's distances. Ranges of them are counted, and the values of those
    that hold the two ranks next to it; no cluster's distances are held in one place."""
    ends = dist.groupBy("cluster").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("dist").alias("n"))
    at = F.lit(percentile / 100.0) * (F.col("n") - 1)
    ends = ends.where("n > 0").select("cluster", "low", "high", at.alias("at"), F.floor(at).alias("k0"), F.ceil(at).alias("k1"))
    share = F.when(F.col("high") > F.col("low"), (F.col("dist") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    placed = dist.join(ends, "cluster").where("dist is not null").withColumn("range", F.least(F.lit(RANGES - 1), F.floor(share * RANGES).cast("int")))
    values = placed.groupBy("cluster", "range", "dist").agg(F.count("*").alias("m"))
    ranges = values.groupBy("cluster", "range").agg(F.sum("m").alias("r"))
    before = ranges.select("cluster", "range", "r", (F.sum("r").over(Window.partitionBy("cluster").orderBy("range")) - F.col("r")).alias("before"))
    hit = before.join(ends, "cluster").where("(before <= k0 and k0 < before + r) or (before <= k1 and k1 < before + r)").select("cluster", "range", "before", "at", "k0", "k1")
    inner = values.join(hit, ["cluster", "range"])
    first = F.col("before") + F.sum("m").over(Window.partitionBy("cluster", "range").orderBy("dist")) - F.col("m")
    inner = inner.withColumn("first", first)
    holds = lambda k: F.max(F.when((F.col("first") <= F.col(k)) & (F.col(k) < F.col("first") + F.col("m")), F.col("dist")))
    found = inner.groupBy("cluster", "at", "k0", "k1").agg(holds("k0").alias("v0"), holds("k1").alias("v1"))
    between = (F.col("k1") - F.col("at")) * F.col("v0") + (F.col("at") - F.col("k0")) * F.col("v1")
    return found.select("cluster", F.when(F.col("k0") == F.col("k1"), F.col("v0")).otherwise(between).alias("limit"))


def edge_candidates(dist: DataFrame, percentile: float = 95.0) -> DataFrame:
    """Rows as far as the cluster's percentile (linear) or farther."""
    limit = percentiles(dist, percentile).withColumn("limit", F.round("limit", 9))
    return dist.join(limit, "cluster").where(F.col("dist") >= F.col("limit")).select("row_id", "cluster", "dist")


def distribute_edges(edges: DataFrame, need: int) -> DataFrame:
    """row_id of up to need edges: by quotas in proportion to the clusters' edges and in the order of ids; then, if quotas
    leave a remainder, round by round again from each cluster's first. Rows taken twice count once."""
    if need <= 0:
        return edges.select("row_id").limit(0)
    counts = edges.groupBy("cluster").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    quotas = counts.crossJoin(F.broadcast(total)).withColumn("quota", F.least(F.bround(F.lit(float(need)) * (F.col("n") / F.col("total"))).cast("long"), F.col("n")))
    remaining = need - (quotas.agg(F.sum("quota")).first()[0] or 0)
    rn = F.row_number().over(Window.partitionBy("cluster").orderBy("row_id"))
    numbered = edges.withColumn("rn", rn).join(quotas.select("cluster", "quota"), "cluster")
    chosen = numbered.where(F.col("rn") <= F.col("quota")).select("row_id")
    if remaining > 0:
        chosen = chosen.unionByName(numbered.orderBy("rn", "cluster").limit(remaining).select("row_id"))
    return chosen.distinct()


def trim(selection: DataFrame, budget: int) -> DataFrame:
    """selection (row_id, cluster, dist, tier) within a budget: excess goes from edges, then top-ups, then cores, the nearest first."""
    excess = selection.count() - budget
    if excess <= 0:
        return selection
    order = F.when(F.col("tier") == "edge", 0).when(F.col("tier") == "topup", 1).otherwise(2)
    gone = selection.orderBy(order, "dist", "row_id").limit(excess)
    return selection.join(gone.select("row_id"), "row_id", "left_anti")


def _tiers(dist: DataFrame, core: DataFrame, edges: DataFrame, topup: DataFrame) -> DataFrame:
    """Each chosen row once, by its first tier."""
    tagged = core.select("row_id", F.lit(0).alias("t")).unionByName(edges.select("row_id", F.lit(1).alias("t"))).unionByName(topup.select("row_id", F.lit(2).alias("t")))
    first = tagged.groupBy("row_id").agg(F.min("t").alias("t"))
    tier = F.get(F.array(F.lit("core"), F.lit("edge"), F.lit("topup")), F.col("t"))
    return dist.join(first, "row_id").select("row_id", "cluster", "dist", tier.alias("tier"))


def select_diverse(dist: DataFrame, budget: int, percentile: float = 95.0) -> DataFrame:
    """Cores, then edges, then the nearest of the rest; (row_id, cluster, dist, tier), as many as the budget or all."""
    dist = staging.stage(dist, "dist")  # several actions read it
    core = core_representatives(dist)
    need = budget - core.count()
    none = dist.limit(0).select("row_id")
    chosen, edges = core.select("row_id"), none
    if need > 0:
        candidates = edge_candidates(dist, percentile)
        edges = distribute_edges(candidates, min(need, candidates.count())).orderBy("row_id").limit(need)
        chosen = chosen.unionByName(edges).distinct()
    missing = budget - chosen.count()
    topup = dist.join(chosen, "row_id", "left_anti").orderBy("dist", "row_id").limit(missing).select("row_id") if missing > 0 else none
    return trim(_tiers(dist, core, edges, topup), budget)


def select_core(dist: DataFrame, budget: int, fallback: str = "random", percentile: float = 95.0, seed: int = 42) -> DataFrame:
    """Cores, and below the budget others at random, or edges and then the nearest; above it nothing is trimmed."""
    dist = staging.stage(dist, "dist")
    core = core_representatives(dist)
    missing = budget - core.count()
    none = dist.limit(0).select("row_id")
    if missing <= 0:
        return _tiers(dist, core, none, none)
    if fallback == "random":
        rest = dist.join(core, "row_id", "left_anti").select("row_id")
        return _tiers(dist, core, none, rest.orderBy(ranking.digest("row_id", seed=seed), "row_id").limit(missing))
    if fallback != "edge_topup":
        raise ValueError(f"unknown fallback: {fallback}")
    candidates = edge_candidates(dist, percentile)
    edges = distribute_edges(candidates, min(missing, candidates.count())).orderBy("row_id").limit(missing)
    chosen = core.select("row_id").unionByName(edges).distinct()
    left = budget - chosen.count()
    topup = dist.join(chosen, "row_id", "left_anti").orderBy("dist", "row_id").limit(left).select("row_id") if left > 0 else none
    return _tiers(dist, core, edges, topup)


def default_n_clusters(n_rows: int, budget: int, strategy: str, per_cluster: float) -> int:
    if budget <= 0:
        return 0
    return budget if strategy == "core" else max(1, min(n_rows, int(budget // max(1.0, per_cluster))))


def kmeans(rows: DataFrame, k: int, seed: int = 42):
    """(row_id, cluster, vec) and centers: fitted on all rows, dealt by row_id, so that files' borders don't matter."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select("row_id", "vec", array_to_vector(scalars.doubles(F.col("vec"))).alias("_features"))
    dealt = data.repartition(staging.partitions(rows.sparkSession), "row_id").sortWithinPartitions("row_id")
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(dealt)
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centers = rows.sparkSession.createDataFrame(found, "cluster int, center array<double>")
    return model.transform(data).select("row_id", "cluster", "vec"), centers


def nearest_other(rows: DataFrame, others: DataFrame, k: int = 1) -> DataFrame:
    """(row_id, dist): of each row, the distance to the k-th nearest of the other vectors, null if there are fewer; any number of them."""
    own = rows.select("row_id", "vec", F.lit(0).alias("cls"))
    found = neighbours.nearest(own, others.select("vec", F.lit(1).alias("cls")), k)
    return found.select("row_id", neighbours.kth_distance(F.col("near"), k).alias("dist"))


# --- many centres, fitted batch by batch ----------------------------------------------------------------------------------
@dataclasses.dataclass
class CentreTree:
    """Centres in groups around some of them: a group is looked into for those rows only that it may hold the nearest for."""

    centres: np.ndarray
    heads: np.ndarray
    members: list[np.ndarray]
    radius: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray) -> CentreTree:
        heads = neighbours.spread(centres, max(1, round(len(centres) ** 0.5)))
        own = neighbours.distances(centres, heads).argmin(axis=1)
        members = [np.flatnonzero(own == g) for g in range(len(heads))]
        radius = np.array([np.sqrt(neighbours.distances(centres[m], heads[g : g + 1]).max()) for g, m in enumerate(members)])
        return cls(centres, heads, members, radius)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest centre, ties to the smaller one, and the squared distance."""
        to = np.sqrt(neighbours.distances(x, self.heads))
        low = to - self.radius
        first = to.argmin(axis=1)
        best, where = np.full(len(x), np.inf), np.full(len(x), len(self.centres))
        for own in (True, False):
            for g, m in enumerate(self.members):
                near = (first == g) if own else (first != g) & (low[:, g] <= np.sqrt(best) * (1 + 1e-9) + 1e-9)
                rows = np.flatnonzero(near)
                if len(rows):
                    d = neighbours.distances(x[rows], self.centres[m])
                    at = d.argmin(axis=1)
                    d, at = d[np.arange(len(rows)), at], m[at]
                    better = (d < best[rows]) | ((d == best[rows]) & (at < where[rows]))
                    best[rows[better]], where[rows[better]] = d[better], at[better]
        return where, best


def _sums(centres):
    """Vectors to (cluster, n, inertia, sums), a row for each centre that a task has rows of."""

    @tidy
    def run(batches):
        tree = CentreTree.of(centres.value)
        k, dim = tree.centres.shape
        n, inertia, sums = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, dim))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own, d = tree.nearest(x)
            n += np.bincount(own, minlength=k)
            inertia += np.bincount(own, weights=d, minlength=k)
            np.add.at(sums, own, x)
        some = np.flatnonzero(n)
        if len(some):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(sums[some].ravel()))
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(inertia[some]), lists], names=["cluster", "n", "inertia", "sums"])

    return run


def _started(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows, each drawn by its squared distance from those before it."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = far.sum()
        at = int(np.searchsorted(np.cumsum(far), rng.random() * total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(min(at, len(x) - 1))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


#: Rows that the first centres are drawn from, for each centre and at least.
STARTS, LEAST_START = 3, 10_000


def minibatch_kmeans(rows: DataFrame, k: int, batch: int = 10_000, rounds: int = 100, patience: int = 10, seed: int = 42):
    """(row_id, cluster, vec) and centers, like kmeans(), fitted batch by batch.

    All rows are dealt into batches by a hash, every round takes the next one: each centre moves to the mean of what it has
    been given so far. Rounds end when the batches' mean inertia, smoothed, hasn't fallen for so many of them. The first
    centres are drawn from a bounded sample. Assignment goes through a tree of centres, so that thousands of them are cheap.
    """
    spark = rows.sparkSession
    data = rows.select("row_id", "vec", scalars.doubles(F.col("vec")).alias("x")).where("x is not null")
    with staging.scope() as kept:
        order = F.xxhash64("row_id", F.lit(seed))
        n = data.count()
        if not n:
            raise ValueError("no rows to cluster")
        batches = max(1, -(-n // batch))
        dealt = data.select("x", "row_id", F.pmod(order, F.lit(batches)).cast("int").alias("batch"))
        # a batch's rows lie together, so that the others' files are left out
        dealt = staging.stage(dealt.repartitionByRange(staging.partitions(spark), "batch").sortWithinPartitions("batch", "row_id"), "batches")
        first = dealt.select("x", order.alias("o"), "row_id").orderBy("o", "row_id").limit(max(STARTS * k, LEAST_START)).toArrow()
        start = first["x"].combine_chunks().flatten().to_numpy().reshape(first.num_rows, -1)
        centres = _started(start, min(k, len(start)), seed)
        seen, smooth, best, waited = np.zeros(len(centres)), None, np.inf, 0
        for i in range(rounds):
            own = dealt.where(F.col("batch") == i % batches).select("x")
            part = own.mapInArrow(_sums(spark.sparkContext.broadcast(centres)), "cluster int, n long, inertia double, sums array<double>")
            dim = centres.shape[1]
            found = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*(F.sum(F.get("sums", F.lit(j))) for j in range(dim))).alias("sums")).collect()  # a row for each centre
            total = sum(r.n for r in found)
            if not total:
                continue
            moved = centres.copy()
            for r in sorted(found, key=lambda r: r.cluster):
                seen[r.cluster] += r.n
                moved[r.cluster] += (np.array(r.sums) - r.n * centres[r.cluster]) / seen[r.cluster]
            centres = moved
            inertia = sum(r.inertia for r in found) / total
            smooth = inertia if smooth is None else smooth + min(1.0, 2 * total / (n + 1)) * (inertia - smooth)
            best, waited = (smooth, 0) if smooth < best * (1 - 1e-6) else (best, waited + 1)
            if waited >= patience:
                break
        centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, center array<double>")
        placed = staging.stage(data.drop("vec").mapInArrow(_placing(spark.sparkContext.broadcast(centres)), "row_id long, cluster int").join(data.select("row_id", "vec"), "row_id").select("row_id", "cluster", "vec"), "placed")
        kept.append(placed)
    return placed, centers


def _placing(centres):
    """(row_id, vector) to (row_id, number of the nearest centre)."""

    @tidy
    def run(batches):
        tree = CentreTree.of(centres.value)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column(0), pa.array(tree.nearest(x)[0].astype(np.int32))], names=["row_id", "cluster"])

    return run
