"""Voting over models' class probabilities: (row_id, model, p), p an array with a value for each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import scalars

#: Weights of the ensemble's models.
WEIGHTS = {"xgb": 0.3, "dnn": 0.1, "catb": 0.2, "bagging": 0.2, "histgbm": 0.2}


def weighted_vote(probabilities: DataFrame, classes: int, weights: dict[str, float] | None = None, places: int = 9) -> DataFrame:
    """(row_id, p, y_pred): weighted means over models that have a positive weight and the right number of classes.

    If a row has no such model, all with the right number count alike. Ties go to the smaller class.
    """
    weights = WEIGHTS if weights is None else weights
    w = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("model")), F.lit(0.0)) if weights else F.lit(0.0)
    rows = probabilities.where(F.size("p") == classes).withColumn("w", F.greatest(w, F.lit(0.0)))
    # partial sums for each class: no list of a row's models is gathered
    sums = rows.groupBy("row_id").agg(F.sum("w").alias("total"), F.count("*").alias("models"), *(x for c in range(classes) for x in (F.sum(F.col("w") * F.get("p", F.lit(c))).alias(f"s{c}"), F.sum(F.get("p", F.lit(c))).alias(f"u{c}"))))
    mean = [F.round(F.when(F.col("total") > 0, F.col(f"s{c}") / F.when(F.col("total") > 0, F.col("total"))).otherwise(F.col(f"u{c}") / F.col("models")), places) for c in range(classes)]
    return sums.select("row_id", F.array(*mean).alias("p")).select("row_id", "p", scalars.argmax(F.col("p")).alias("y_pred"))


def predictions_as_probabilities(df: DataFrame, classes: int) -> DataFrame:
    """(row_id, model, p) from (row_id, model, y_pred), for models without probabilities."""
    return df.select("row_id", "model", scalars.one_hot(F.col("y_pred"), classes).alias("p"))
