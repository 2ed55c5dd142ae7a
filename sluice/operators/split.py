"""Splits and samples of exact size, reproducible by a seed: rows are ranked by a digest within their label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.ranking import digest, ranked


def stratified_split(df: DataFrame, label: str, keys: list[str], test: float = 0.30, seed: int = 42) -> DataFrame:
    """df and subset: of each label's n rows ceil(test n) are test, the others train. A label with one row is left out."""
    rows = ranked(df, [label], digest(*keys, seed=seed)).where("total >= 2")
    n_test = F.ceil(F.col("total") * F.lit(float(test)))
    return rows.withColumn("subset", F.when(F.col("rank") <= n_test, "test").otherwise("train")).drop("rank", "total")


def stratified_validation(df: DataFrame, label: str, keys: list[str], fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """df and subset: ceil(fraction n) rows in all are validation, shared out to the labels by largest remainder (ties to the smaller label).

    With one label only, rows are taken from all alike.
    """
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("n"))
    # as many rows as labels
    whole = counts.agg(F.sum("n").alias("total")).withColumn("want", F.ceil(F.col("total") * F.lit(float(fraction))))
    share = counts.crossJoin(F.broadcast(whole)).withColumn("exact", F.col("n") * F.col("want") / F.col("total")).withColumn("base", F.floor("exact").cast("long"))
    from pyspark.sql import Window

    left = F.col("want") - F.sum("base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.bround(F.col("exact") - F.col("base"), 9)), "_l"))
    quota = share.withColumn("quota", F.col("base") + (place <= left).cast("long")).select("_l", "quota")
    rows = ranked(df, [label], digest(*keys, seed=seed)).join(F.broadcast(quota), F.col(label).eqNullSafe(F.col("_l")))
    return rows.withColumn("subset", F.when(F.col("rank") <= F.col("quota"), "validation").otherwise("train")).drop("rank", "total", "_l", "quota")


def capped_sample(df: DataFrame, label: str, keys: list[str], tau: int, seed: int = 42) -> DataFrame:
    """Of each label min(tau, n) rows; all if tau isn't positive."""
    if tau <= 0:
        return df
    return ranked(df, [label], digest(*keys, seed=seed)).where(F.col("rank") <= tau).drop("rank", "total")


def first_by_digest(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows at random."""
    return df.orderBy(digest(*keys, seed=seed), *keys).limit(n)


def random_topup(df: DataFrame, selected: DataFrame, row_id: str, need: int, seed: int = 42) -> DataFrame:
    """Row ids: the selected ones and, if these are fewer than need, others at random; the smallest need of them, if more."""
    chosen = selected.select(row_id).distinct()
    n = chosen.count()
    if n >= need:
        return chosen.orderBy(row_id).limit(need)
    rest = df.select(row_id).join(chosen, row_id, "left_anti")
    return chosen.unionByName(first_by_digest(rest, [row_id], need - n, seed))


def head(df: DataFrame, order: str | Column, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(digest(*keys, seed=seed), *keys)
