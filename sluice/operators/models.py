"""Classifiers behind one interface: trees fitted in tasks of their own, a network fitted in rounds, and their evaluation."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions import nets, network, scalars, trees
from sluice.functions.ranking import digest, ranked
from sluice.functions.trees import Boosting
from sluice.operators import cluster, ensemble, forest, metrics, split, training

#: Kinds of models and the learners that stand for them.
KINDS = ("xgb", "catb", "bagging", "histgbm", "dnn")

#: Boosted trees are fitted on at most so many rows, as many of each label; weights keep the labels' shares.
ROWS = 200_000
#: A bagged tree, or a node of it, is grown by one task if it has so many rows at most; bagged trees take all rows.
WITHIN = 100_000

#: Rounds, patience, depth, steps, parts and penalties of the boosted kinds, number of trees of the bagged one.
BOOSTED = {
    "xgb": Boosting(1200, 20, 8, 0.08, rows=0.9, columns=0.9, weight=1.0, penalty=1.0),
    "catb": Boosting(2000, 50, 8, 0.08, penalty=3.0),
    "histgbm": Boosting(500, 10, 30, 0.1, leaf=20),
}
BAGGED = 300
#: A bagged tree's depth at most; its leaves are pure long before.
DEEPEST = 200


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(scalars.doubles(F.col(column))))


@dataclasses.dataclass
class TreeModel:
    """Trees of one group (bagged; many nodes: each tree by itself, packed) or of a group for each class (boosted, one against the rest; one group for two classes)."""

    cuts: list[np.ndarray]
    groups: list[trees.Trees] | list[bytes]
    bagged: bool
    classes: int

    def shares(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes)"""
        codes = trees.binned(x, self.cuts)
        if self.bagged:
            out, n = 0.0, 0
            for g in self.groups:
                g = trees.Trees.unpack(g) if isinstance(g, bytes) else g
                out, n = out + g.total(codes, max(512, (1 << 14) // len(g.roots))), n + len(g.roots)
            return out / n
        odds = np.concatenate([1 / (1 + np.exp(-np.clip(g.total(codes), -500, 500))) for g in self.groups], axis=1)
        return np.concatenate([1 - odds, odds], axis=1) if self.classes == 2 else odds / odds.sum(axis=1, keepdims=True)

    @property
    def width(self) -> int:
        return len(self.cuts)

    def with_shares(self, df: DataFrame, features: str = "features", name: str = "p") -> DataFrame:
        return with_shares(self, df, features, name)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("cuts", i, np.asarray(c, np.float64).tobytes()) for i, c in enumerate(self.cuts)]
        rows += [("bagged" if self.bagged else "boosted", self.classes, None), *(("group", i, bytearray(g if isinstance(g, bytes) else g.pack())) for i, g in enumerate(self.groups))]
        spark.createDataFrame(rows, "part string, number int, data binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.number)
        kind = next(r for r in rows if r.part in ("bagged", "boosted"))
        cuts = [np.frombuffer(r.data, np.float64) for r in rows if r.part == "cuts"]
        groups = [bytes(r.data) for r in rows if r.part == "group"]
        return cls(cuts, trees.sized(groups) if kind.part == "bagged" else [trees.Trees.unpack(g) for g in groups], kind.part == "bagged", kind.number)


def with_shares(model: TreeModel | network.Network, df: DataFrame, features: str = "features", name: str = "p") -> DataFrame:
    return df.withColumn(name, shares_of(df.sparkSession.sparkContext.broadcast(model))(vector_to_array(features)))


def shares_of(model: Broadcast) -> Callable:
    @F.pandas_udf("array<double>")
    def shares(features: pd.Series) -> pd.Series:
        unknown = np.full(model.value.width, np.nan)
        x = np.stack([unknown, *(unknown if f is None else f for f in features)])
        return pd.Series(list(model.value.shares(x)[1:]), dtype=object)

    return shares


def learnable(df: DataFrame) -> DataFrame:
    """(x, label, w) of all rows that have features and a label."""
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    plain = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"), weight.alias("w"))
    return plain.where("x IS NOT NULL AND label IS NOT NULL")


def sampled(df: DataFrame, classes: int, seed: int, rows: int = ROWS) -> tuple[np.ndarray, ...]:
    """(features, label, weight, held): a bounded sample, of which a tenth of each label is held for validation.

    All rows come if there are no more than rows // classes of a label; those without features or label never do.
    The order doesn't depend on partitions.
    """
    most = max(1, rows // classes)
    plain = learnable(df).withColumn("_key", F.xxhash64("x", "label"))
    with staging.scope():
        some = ranked(plain, ["label"], digest("_key", seed=seed)).where(F.col("rank") <= most)
        some = staging.stage(some.withColumn("w", F.col("w") * F.col("total") / F.least("total", F.lit(most))).drop("rank", "total"), "training")
        got = split.stratified_validation(some, "label", ["_key"], seed=seed).toArrow()
    if not got.num_rows:
        raise ValueError("no rows to learn from")
    got = got.sort_by([("_key", "ascending"), ("label", "ascending"), ("subset", "ascending")]).combine_chunks()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return x, got["label"].to_numpy(), got["w"].to_numpy(), np.array(got["subset"].to_pylist()) == "validation"


def fitted(spark: SparkSession, tasks: int, fit: Callable[[int, object], trees.Trees], data: object) -> list[bytes]:
    """fit(task, data) for each task, packed, in a Spark task of its own; data (a bounded sample) goes to the executors once."""
    sent = spark.sparkContext.broadcast(data)

    def run(batches):
        for b in batches:
            for i in b.id:
                yield pd.DataFrame({"id": [i], "made": [fit(int(i), sent.value).pack()]})

    rows = spark.range(0, tasks, 1, tasks).mapInPandas(run, "id long, made binary").collect()
    sent.destroy()
    return [bytes(r.made) for r in sorted(rows, key=lambda r: r.id)]


def boosted(df: DataFrame, classes: int, how: Boosting, seed: int = 42) -> TreeModel:
    """A boosted model for each class against the rest, each with its own end; for two classes one of the second."""
    x, label, w, held = sampled(df, classes, seed)
    cuts = trees.cuts_of(x[~held])

    def one(i, data):
        codes, label, w, held = data
        return trees.boost(codes, (label == (1 if classes == 2 else i)).astype(float), w, held, how, seed)

    groups = fitted(df.sparkSession, 1 if classes == 2 else classes, one, (trees.binned(x, cuts), label, w, held))
    return TreeModel(cuts, [trees.Trees.unpack(g) for g in groups], False, classes)


def bagged(df: DataFrame, classes: int, n: int = BAGGED, depth: int = DEEPEST, seed: int = 42) -> TreeModel:
    """n full trees, each on as many rows as there are, drawn with replacement from all of them.

    Up to WITHIN rows each tree is a task on all rows' codes; of more rows a tree's upper nodes come from counts over all rows.
    """
    rows = learnable(df)
    many = rows.count()
    if not many:
        raise ValueError("no rows to learn from")
    if many > WITHIN:
        cuts, packed = forest.fit(rows, classes, n, depth, seed, WITHIN)
        return TreeModel(cuts, trees.sized(packed), True, classes)
    got = rows.withColumn("_key", F.xxhash64("x", "label")).toArrow().sort_by([("_key", "ascending"), ("label", "ascending"), ("w", "ascending")]).combine_chunks()
    x, label, w = got["x"].combine_chunks().flatten().to_numpy().reshape(many, -1), got["label"].to_numpy(), got["w"].to_numpy()
    cuts = trees.cuts_of(x)

    def one(i, data):
        codes, label, w = data
        return trees.bag(codes, label, w, classes, depth, seed * 100_003 + i)

    return TreeModel(cuts, trees.sized(fitted(df.sparkSession, n, one, (trees.binned(x, cuts), label, w))), True, classes)


@dataclasses.dataclass
class Classifier:
    """fit, predict, save, load over tables with features (a vector) and label (a number from 0).

    inputs: of a network, {"categorical": {place: number of values}, "binary": [places]}. "mlp" is Spark ML's perceptron.
    """

    kind: str
    classes: int
    model: object = None
    inputs: dict | None = None

    def fit(self, df: DataFrame, seed: int = 42, size: int = 1) -> Classifier:
        """size scales the number of trees, rounds or iterations."""
        if self.kind in BOOSTED:
            how = BOOSTED[self.kind]
            self.model = boosted(df, self.classes, dataclasses.replace(how, rounds=how.rounds * size), seed)
        elif self.kind == "bagging":
            self.model = bagged(df, self.classes, BAGGED * size, seed=seed)
        elif self.kind == "dnn":
            how = training.Schedule()
            self.model = training.fit(df, self.classes, self.inputs, dataclasses.replace(how, rounds=how.rounds * size), seed)
        elif self.kind == "mlp":
            inputs = len(df.select(vector_to_array("features").alias("f")).first().f)
            net = MultilayerPerceptronClassifier(featuresCol="scaled", layers=[inputs, 256, 128, self.classes], maxIter=40 * size, seed=seed)
            self.model = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), net]).fit(df)
        else:
            raise ValueError(f"unknown kind of model: {self.kind}")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with p (a probability for each class) and y_pred, ties to the smaller label. Rows without features count as unknown in all columns."""
        if isinstance(self.model, (TreeModel, network.Network)):
            out = with_shares(self.model, df).withColumn("y_pred", F.array_position("p", F.array_max("p")).cast("int") - 1)
        else:
            p = vector_to_array("probability")
            out = self.model.transform(df).withColumn("p", p).withColumn("y_pred", F.col("prediction").cast("int"))
        return out.select(*df.columns, "p", "y_pred")

    def scorer(self) -> TreeModel | network.Network | nets.Net:
        """What gives the shares of many rows at once within a task; but for trees derivatives too."""
        if isinstance(self.model, (TreeModel, network.Network)):
            return self.model
        scaler, net = self.model.stages
        std = scaler.std.toArray()
        return nets.of_perceptron(net.weights.toArray(), list(net.getLayers()), scaler.mean.toArray(), np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0))

    def save(self, path: str) -> None:
        to = f"{path}/{self.kind}"
        if isinstance(self.model, TreeModel):
            self.model.save(SparkSession.active(), to)
        elif isinstance(self.model, network.Network):
            SparkSession.active().createDataFrame(self.model.rows(), "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(to)
        else:
            self.model.write().overwrite().save(to)

    @classmethod
    def load(cls, path: str, kind: str, classes: int) -> Classifier:
        where = f"{path}/{kind}"
        if kind == "dnn":
            return cls(kind, classes, network.Network.of_rows([tuple(r) for r in SparkSession.active().read.parquet(where).collect()]))
        return cls(kind, classes, PipelineModel.load(where) if kind == "mlp" else TreeModel.load(SparkSession.active(), where))


def softmax(df: DataFrame, penalty: float = 0.0, passes: int = 100) -> nets.Net:
    """A multinomial logistic regression of label by features."""
    made = LogisticRegression(regParam=penalty, maxIter=passes, family="multinomial").fit(df)
    return nets.of_logistic(made.coefficientMatrix.toArray(), made.interceptVector.toArray())


def nearest_centre(df: DataFrame, column: str, classes: int, width: int, places: int = 6) -> nets.Net:
    """The linear classifier by the nearest mean of a class (label, from 0); a class without rows is never given."""
    means = {r.cluster: r.center for r in cluster.centers_of(df, "label", column, width, places).collect()}  # as many rows as classes
    net = nets.of_centres(np.array([means.get(c, [0.0] * width) for c in range(classes)], np.float64))
    net.layers[0][1][[c for c in range(classes) if c not in means]] = -np.inf
    return net


def evaluate(model: Classifier, test: DataFrame) -> DataFrame:
    return metrics.classification_metrics(model.predict(test).select(F.col("label").cast("int").alias("y_true"), "y_pred"))


def evaluate_all(models: dict[str, Classifier], test: DataFrame) -> DataFrame:
    """(model, accuracy, ...), a row for each."""
    rows = None
    for name, m in models.items():
        one = evaluate(m, test).select(F.lit(name).alias("model"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def vote(models: dict[str, Classifier], test: DataFrame, row_id: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(row_id, p, y_pred) of the weighted ensemble."""
    rows = None
    for name, m in models.items():
        one = m.predict(test).select(F.col(row_id).alias("row_id"), F.lit(name).alias("model"), "p")
        rows = one if rows is None else rows.unionByName(one)
    return ensemble.weighted_vote(rows, next(iter(models.values())).classes, weights)
