"""Rows and columns made fit for use: projection, coercion, quality filters, duplicates, routing by label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import scalars
from sluice.spec import DatasetSpec

_NUMBERS = (T.FloatType, T.DoubleType)


def _fractional(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, _NUMBERS)}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_features(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Features and label; a strict spec needs all, otherwise those that are there are taken."""
    features = [c for c in spec.ordered if c in df.columns] if not spec.strict else list(spec.ordered)
    return df.select(*(F.col(f"`{c}`") for c in features), F.col(f"`{spec.label}`"))


def align_schema(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """These columns in this order; missing ones are null, of the given type."""
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def coerce(df: DataFrame, floats: list[str], ints: list[str], label: str | None = None) -> DataFrame:
    """What isn't a number becomes null; labels are trimmed, and empty ones or NaN become null."""
    columns = {c: F.col(f"`{c}`").try_cast("float") for c in floats if c in df.columns}
    # whole numbers written with a fraction count, others don't
    for c in ints:
        if c in df.columns:
            x = F.col(f"`{c}`").try_cast("double")
            columns[c] = F.when((x == F.floor(x)) & (F.abs(x) <= 2147483647), x).try_cast("int")
    if label and label in df.columns:
        text = F.trim(F.col(f"`{label}`").cast("string"), F.lit(scalars.BLANKS))
        columns[label] = F.when((text != "") & (F.lower(text) != "nan"), text)
    return df.withColumns(columns)


def is_complete(df: DataFrame, columns: list[str] | None = None) -> Column:
    fractional = _fractional(df)
    return scalars.all_of(scalars.finite(f"`{c}`", c in fractional) for c in columns or df.columns)


def drop_missing_inf(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.where(is_complete(df, columns))


def has_missing_or_inf(df: DataFrame) -> DataFrame:
    """One row: found, false for an empty table."""
    return df.agg(F.coalesce(F.bool_or(~is_complete(df)), F.lit(False)).alias("found"))


def is_nonnegative(df: DataFrame, columns: list[str] | None = None) -> Column:
    """No number is negative or NaN; null where one is missing, so that the plain comparisons reach the scan."""
    fractional = _fractional(df)
    columns = columns or numeric_columns(df)
    return scalars.all_of(F.col(f"`{c}`") >= 0 for c in columns) & scalars.all_of(~F.isnan(F.col(f"`{c}`")) for c in columns if c in fractional)


def drop_negative_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.where(is_nonnegative(df, columns))


def drop_header_rows(df: DataFrame, label: str, header: str | None = None) -> DataFrame:
    """Without rows that repeat the header within the data."""
    return df.where(F.coalesce(F.trim(F.col(f"`{label}`")) != (header or label), F.lit(True)))


def zero_count(columns: list[str]) -> Column:
    return scalars.total(F.coalesce((F.col(f"`{c}`") == 0).cast("int"), F.lit(0)) for c in columns)


def zero_heavy_filter(df: DataFrame, columns: list[str], ratio: float = 0.5, threshold: int | None = None) -> DataFrame:
    """Rows with fewer zeros than the threshold, by default that part of the columns."""
    return df.where(zero_count(columns) < (int(len(columns) * ratio) if threshold is None else threshold))


def label_filter(df: DataFrame, label: str, include: list[str] | None = None, exclude: list[str] | None = None, known: tuple[str, ...] | None = None) -> DataFrame:
    """Rows with these labels; names that aren't known raise an error."""
    for names in (include, exclude):
        if known is not None and (wrong := [x for x in names or [] if x not in known]):
            raise ValueError(f"unknown labels: {wrong}")
    if include:
        df = df.where(F.col(f"`{label}`").isin(include))
    return df.where(~F.col(f"`{label}`").isin(exclude)) if exclude else df


def dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_keep_first(df: DataFrame, technical: list[str], order: str) -> DataFrame:
    """Of rows equal but for the technical columns, that with the smallest order; by one partial aggregate."""
    keys = [c for c in df.columns if c not in technical]
    first = df.groupBy(*(F.col(f"`{c}`") for c in keys)).agg(F.min(F.struct(order, *(F.col(f"`{c}`") for c in technical if c != order))).alias("_first"))
    return first.select(*(F.col(f"`{c}`") if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, distinct_rows, duplicates."""
    each = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias("_n"))
    return each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def with_row_id(df: DataFrame, *natural: str, name: str = "row_id") -> DataFrame:
    """An id by natural keys, the same in every plan."""
    return df.withColumn(name, F.xxhash64(*natural))


#: Copies of a row that one task numbers.
COPIES = 100_000


def with_copy_ids(df: DataFrame, name: str = "row_id", copies: int = COPIES) -> DataFrame:
    """An id for each row by all its columns and its number among equal rows, the same in every plan.

    Equal rows are counted before they are dealt out and made again by number, many of them by several tasks.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    n, first, number = (f"_{x}{'_' * max(map(len, df.columns))}" for x in ("n", "first", "number"))
    each = df.groupBy(*columns).agg(F.count("*").alias(n))
    parts = F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(copies).cast("long"))
    few = each.where(F.col(n) <= copies).withColumn(first, F.lit(0).cast("long"))
    many = each.where(F.col(n) > copies).withColumn(first, F.explode(parts)).repartition(*columns, first)
    rows = few.unionByName(many)
    last = F.least(F.col(n), F.col(first) + copies) - 1
    rows = rows.withColumn(number, F.explode(F.sequence(F.col(first), last)))
    return rows.select(*columns, F.xxhash64(*columns, F.col(number)).alias(name))


def cleaned(raw: DataFrame, floats: list[str], ints: list[str], label: str) -> DataFrame:
    """Header rows, missing and infinite values, negatives and duplicates removed, in this order and one plan."""
    df = coerce(drop_header_rows(raw, label), floats, ints, label)
    return dedup(drop_negative_rows(drop_missing_inf(df)))


def _staged(raw: DataFrame, floats: list[str], ints: list[str], label: str) -> tuple[DataFrame, Column]:
    """Coerced rows with _header, and the step of cleaning that takes a row away: 0 header, 1 missing, 2 negative, 3 none."""
    df = coerce(raw, floats, ints)
    header = F.coalesce(F.trim(F.col(f"`{label}`")) == label, F.lit(False))
    df = coerce(df.withColumn("_header", header), [], [], label)
    rest = [c for c in df.columns if c != "_header"]
    return df, F.when(F.col("_header"), 0).when(~is_complete(df, rest), 1).when(~F.coalesce(is_nonnegative(df, [c for c in numeric_columns(df) if c != "_header"]), F.lit(False)), 2).otherwise(3)


def cleaned_and_counted(raw: DataFrame, floats: list[str], ints: list[str], label: str) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """What cleaned() gives, and the counters of clean_funnel() as they are taken while the first action on it runs, without another pass.

    An executor lost between may have rows counted twice; rows themselves aren't.
    """
    before, after = Observation(), Observation()
    df, stage = _staged(raw, floats, ints, label)
    df = df.withColumn("_stage", stage)
    is_ = lambda k: F.count_if(F.col("_stage") == k)
    df = df.observe(before, F.count("*").alias("rows_read"), is_(0).alias("header_rows"), is_(1).alias("missing_rows"), is_(2).alias("negative_rows"), is_(3).alias("clean_rows"))
    out = dedup(df.where("_stage = 3").drop("_stage", "_header")).observe(after, F.count("*").alias("distinct_rows"))
    return out, lambda: dict(before.get) | dict(after.get)


def clean_funnel(raw: DataFrame, floats: list[str], ints: list[str], label: str) -> DataFrame:
    """One row of counters: what each step of cleaning takes away."""
    df, stage = _staged(raw, floats, ints, label)
    rest = [c for c in df.columns if c != "_header"]
    each = df.withColumn("_stage", stage).groupBy("_stage", *(F.when(stage == 3, F.col(f"`{c}`")).alias(c) for c in rest)).agg(F.count("*").alias("_n"))
    count = lambda k: F.coalesce(F.sum(F.when(F.col("_stage") == k, F.col("_n"))), F.lit(0))
    return each.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_read"), count(0).alias("header_rows"), count(1).alias("missing_rows"), count(2).alias("negative_rows"),
        count(3).alias("clean_rows"), F.count(F.when(F.col("_stage") == 3, 1)).alias("distinct_rows"),
    )


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows, columns by name in alphabetical order, what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*(F.col(f"`{c}`") for c in sorted(out.columns)))


def tagged(df: DataFrame, source: str, name: str = "__source__") -> DataFrame:
    return df.withColumn(name, F.lit(source))


def routed(df: DataFrame, label: str) -> DataFrame:
    """With label_safe, by which rows are written apart."""
    return df.withColumn("label_safe", scalars.safe_name(F.col(f"`{label}`")))


def row_id_lookup(source: DataFrame, selected: DataFrame, row_id: str) -> DataFrame:
    """The source's rows that are selected."""
    return source.join(selected.select(row_id).distinct(), row_id, "left_semi")


def anti_join_keys(rows: DataFrame, known: list[DataFrame], columns: list[str], places: int = 6) -> DataFrame:
    """Rows whose key, rounded, none of the known tables has. Rows that repeat among themselves stay."""
    keys = None
    for t in known:
        k = t.select(*scalars.key(*columns, places=places))
        keys = k if keys is None else keys.unionByName(k)
    keys = keys.distinct().select(*(F.col(c).alias(f"_k_{c}") for c in columns))
    on = scalars.all_of(k.eqNullSafe(F.col(f"_k_{c}")) for k, c in zip((F.bround(F.col(c).cast("double"), places) for c in columns), columns, strict=True))
    return rows.join(keys, on, "left_anti")


def keep_labels_with(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows of labels that have so many rows at least; labels are counted, then joined."""
    enough = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(enough, label, "left_semi")


def top_by(df: DataFrame, order: Column, tie: str, k: int) -> DataFrame:
    return df.orderBy(order, tie).limit(k)


def top_per_group(df: DataFrame, groups: list[str], order: Column, tie: str, k: int | Column) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(order, tie)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
