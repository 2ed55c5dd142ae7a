"""Classification metrics from (y_true, y_pred) or (target, score) tables; only counts cross the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import scalars


def _pairs(df: DataFrame) -> DataFrame:
    return df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, classes: int) -> DataFrame:
    """(y_true, y_pred, n) for all pairs of classes, zeros too."""
    spark = df.sparkSession
    grid = spark.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("y_true"), (F.col("id") % classes).cast("int").alias("y_pred"))
    return grid.join(_pairs(df), ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def classification_metrics(df: DataFrame) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1 over the classes that occur, 0 where there is nothing to divide by."""
    pairs = _pairs(df)
    sides = F.explode(F.array(F.struct(F.col("y_true").alias("c"), F.col("n").alias("true"), F.lit(0).cast("long").alias("pred"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("y_pred").alias("c"), F.lit(0).cast("long").alias("true"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("hit"))))
    each = pairs.select(sides.alias("s")).select("s.*").groupBy("c").agg(F.sum("true").alias("t"), F.sum("pred").alias("p"), F.sum("hit").alias("h"))
    each = each.withColumns({"precision": scalars.divided(F.col("h"), F.col("p")), "recall": scalars.divided(F.col("h"), F.col("t"))})
    each = each.withColumn("f1", scalars.divided(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return each.agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"), F.count("*").cast("int").alias("n_classes"))


def pr_curve(df: DataFrame, target: str = "target", score: str = "score") -> DataFrame:
    """(score, tp, fp, precision, recall) at each distinct score, from the highest; sums run over ranges first, then within."""
    by = df.groupBy(F.col(score).alias("score")).agg(F.sum((F.col(target) == 1).cast("long")).alias("pos"), F.sum((F.col(target) == 0).cast("long")).alias("neg"))
    # distinct scores may be many: cumulative sums come from at most 1024 ranges of them, then within each
    ends = by.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    part = by.crossJoin(F.broadcast(ends)).withColumn("range", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * 1023)).otherwise(0))
    above = part.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    w = Window.orderBy(F.desc("range"))
    above = above.select("range", (F.sum("p").over(w) - F.col("p")).alias("p_above"), (F.sum("n").over(w) - F.col("n")).alias("n_above"), F.sum("p").over(Window.partitionBy()).alias("all_pos"))
    inner = Window.partitionBy("range").orderBy(F.desc("score"))
    run = part.withColumns({"tp": F.sum("pos").over(inner), "fp": F.sum("neg").over(inner)}).join(F.broadcast(above), "range")
    tp, fp = F.col("tp") + F.col("p_above"), F.col("fp") + F.col("n_above")
    return run.select("score", tp.alias("tp"), fp.alias("fp"), (tp / (tp + fp)).alias("precision"), scalars.divided(tp, F.col("all_pos")).alias("recall"))


def calibrate_threshold(df: DataFrame, min_precision: float, target: str = "target", score: str = "score") -> DataFrame:
    """One row: threshold and its f1, the best F1 among points precise enough, else of all, else 0.5; ties to the higher score."""
    curve = pr_curve(df, target, score).withColumn("f1", F.round(scalars.f1(F.col("precision"), F.col("recall")), 12))
    best = lambda rows: F.max(F.when(rows, F.struct("f1", "score")))
    row = curve.agg(best(F.col("precision") >= min_precision).alias("a"), best(F.lit(True)).alias("b"))
    pick = F.coalesce("a", "b")
    return row.select(F.coalesce(pick["score"].cast("double"), F.lit(0.5)).alias("threshold"), pick["f1"].alias("f1"))


def robustness_delta(plain: DataFrame, perturbed: DataFrame) -> DataFrame:
    """(metric, plain, perturbed, delta)."""
    names = ["accuracy", "precision_macro", "recall_macro", "f1_macro"]
    both = classification_metrics(plain).select(*(F.col(n).alias(f"a_{n}") for n in names)).crossJoin(F.broadcast(classification_metrics(perturbed).select(*(F.col(n).alias(f"b_{n}") for n in names))))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"a_{n}").alias("plain"), F.col(f"b_{n}").alias("perturbed")) for n in names)))
    return both.select(each.alias("e")).select("e.*").withColumn("delta", F.col("perturbed") - F.col("plain"))


def histogram_compare(before: DataFrame, after: DataFrame, column: str, label: str, bins: int = 10) -> DataFrame:
    """(label, bin, n_before, n_after, density_before, density_after) over bins of equal width common to both."""
    rows = before.select(F.col(label).alias("label"), F.col(column).cast("double").alias("x"), F.lit(0).alias("side")).unionByName(after.select(F.col(label).alias("label"), F.col(column).cast("double").alias("x"), F.lit(1).alias("side"))).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.when(width > 0, width)))).otherwise(0)
    counted = rows.crossJoin(F.broadcast(ends)).groupBy("label", place.cast("int").alias("bin"), width.alias("width")).agg(F.sum((F.col("side") == 0).cast("long")).alias("n_before"), F.sum((F.col("side") == 1).cast("long")).alias("n_after"))
    whole = Window.partitionBy("label")
    share = lambda c: scalars.divided(F.col(c), F.sum(c).over(whole) * F.col("width"))
    return counted.select("label", "bin", "n_before", "n_after", share("n_before").alias("density_before"), share("n_after").alias("density_after"))
