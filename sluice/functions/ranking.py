"""Ranks by a digest within groups: reproducible random order, the same in any engine that has md5.

A group may hold a large part of all rows, so ranks don't come from one window for each group. Rows are put into
buckets by the digest's first digits, which keep its order; buckets are counted, and rows are numbered within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def digest(*keys: str | Column, seed: int | str = 42) -> Column:
    """md5 of the keys and the seed, joined by bars."""
    return F.md5(F.concat_ws("|", *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed))).cast("binary"))


def ranked(df: DataFrame, groups: list[str], order: Column, rank: str = "rank", total: str = "total", digits: int = DIGITS) -> DataFrame:
    """df with each row's rank by order (a digest in hexadecimal) from 1 within its group, and the group's size."""
    rows = df.withColumn("_d", order).withColumn("_b", F.substring("_d", 1, digits))
    keyed = rows.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "_b") if groups else rows.select("_b")
    names = [f"_g{i}" for i in range(len(groups))]
    counts = keyed.groupBy(*names, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*names)
    counts = counts.select(*names, F.col("_b").alias("_c"), (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias(total))
    same = F.col("_b") == F.col("_c")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_d"))
    return rows.withColumn("_i", inner).join(counts, same).withColumn(rank, F.col("_before") + F.col("_i")).drop("_d", "_b", "_c", "_i", "_before", *names)
