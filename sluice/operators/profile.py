"""Statistics of labelled tables: one pass each, partial sums before any exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import clean


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n), null labels as their own."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def categorical_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_distinct, min_value, max_value), values as strings. Values are made distinct before they are compared."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns)))
    values = df.select(pairs.alias("p")).select("p.*").distinct()
    return values.groupBy("feature").agg(F.count("value").alias("n_distinct"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def cont_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std): population deviation, one below 1e-6 counts as 1."""
    row = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") < 1e-6, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in columns)))
    return row.select(each.alias("e")).select("e.*")


def clip_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the smallest and the largest value of all columns."""
    row = df.agg(*(x for c in columns for x in (F.min(F.col(c).cast("double")).alias(f"l_{c}"), F.max(F.col(c).cast("double")).alias(f"h_{c}"))))
    low, high = [F.col(f"l_{c}") for c in columns], [F.col(f"h_{c}") for c in columns]
    return row.select((F.least(*low) if len(low) > 1 else low[0]).alias("clip_min"), (F.greatest(*high) if len(high) > 1 else high[0]).alias("clip_max"))


def class_prior(df: DataFrame, label: str) -> DataFrame:
    """(label, n, prior)."""
    counts = label_distribution(df, label)
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("label", "n", (F.col("n") / F.col("total")).alias("prior"))


def class_weight(df: DataFrame, target: str) -> DataFrame:
    """One row: pos, neg, weight = neg / pos, 1 without positives."""
    row = df.agg(F.coalesce(F.sum((F.col(target) == 1).cast("long")), F.lit(0)).alias("pos"), F.coalesce(F.sum((F.col(target) == 0).cast("long")), F.lit(0)).alias("neg"))
    return row.withColumn("weight", F.when(F.col("pos") == 0, 1.0).otherwise(F.col("neg") / F.when(F.col("pos") != 0, F.col("pos"))))


def zero_heavy_summary(df: DataFrame, label: str, columns: list[str], thresholds: tuple[int, ...]) -> DataFrame:
    """(label, total_rows, rows_zero_gte_<threshold>...)."""
    zeros = clean.zero_count(columns)
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("total_rows"), *(F.sum((zeros >= t).cast("long")).alias(f"rows_zero_gte_{t}") for t in thresholds))
