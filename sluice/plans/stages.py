"""The stages between raw files and evaluated models, each from tables to tables.

Cleaned rows are one table for each resource, in folders by subset and label. Every stage is one plan over all labels;
only cluster fits go label by label, since each is a model of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent import futures

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions import encoders, scalars
from sluice.operators import adversarial, augment, clean, cluster, metrics, models, profile, split
from sluice.sources import tables
from sluice.spec import DatasetSpec

NUMERICAL = ("minmax", "standard", "quantile_uniform", "quantile_normal")


def column_types(spec: DatasetSpec) -> tuple[list[str], list[str]]:
    """Columns to coerce to floats, and to whole numbers."""
    whole = [c for c in spec.categorical if c in spec.ports] + list(spec.binary)
    return list(spec.continuous), whole


def raw_flows(spark: SparkSession, paths: list[str], spec: DatasetSpec) -> DataFrame:
    """Raw files with headers: of the columns most of them have, features and label."""
    heads = tables.first_lines(spark, paths)
    columns = tables.majority_schema(tables.headers(spark, paths, heads)).first()["columns"]
    return clean.select_features(tables.read_csv(spark, paths, columns, heads), spec)


def merge_clean(spark: SparkSession, paths: list[str], spec: DatasetSpec) -> DataFrame:
    """Raw files with headers, cleaned, without duplicates."""
    return clean.cleaned(raw_flows(spark, paths, spec), *column_types(spec), spec.label)


def clean_and_write(raw: DataFrame, spec: DatasetSpec, path: str) -> dict[str, int]:
    """Cleaned rows in a folder for each label; the counters of the steps, which the pass over the raw rows gives by the way."""
    df, counts = clean.cleaned_and_counted(raw, *column_types(spec), spec.label)
    with staging.scope():
        tables.write_by_label(staging.stage(df, "cleaned"), spec.label, path)
    return counts()


def problems(df: DataFrame) -> dict[str, int | bool]:
    """Is anything missing or infinite, and how many rows are duplicates: before or after cleaning."""
    return {"missing": clean.has_missing_or_inf(df).first().found} | clean.duplicate_count(df).first().asDict()


def by_label(spark: SparkSession, labels: list[str], work: Callable, jobs: int = 1) -> dict:
    """{label: work(label)}, up to so many labels at a time.

    Each runs in a thread, and a scheduler's pool, of its own, so that with spark.scheduler.mode FAIR they share the executors evenly. If
    one fails the others' jobs are cancelled by their tag, and those not begun don't run. With one job, labels follow each other.
    """
    if jobs <= 1 or len(labels) <= 1:
        return {x: work(x) for x in labels}
    sc, tag = spark.sparkContext, f"labels-{uuid.uuid4().hex}"

    def one(label: str):
        sc.setLocalProperty("spark.scheduler.pool", scalars.safe_name_of(label))
        sc.addJobTag(tag)
        try:
            return work(label)
        finally:
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.scheduler.pool", None)

    with futures.ThreadPoolExecutor(jobs) as pool:
        started = {pool.submit(inheritable_thread_target(spark)(one), x): x for x in labels}
        try:
            for f in futures.as_completed(started):
                f.result()
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            while futures.wait(started, timeout=0.5).not_done:  # a thread may begin another job
                sc.cancelJobsWithTag(tag)
            raise
    return {x: f.result() for f, x in started.items()}


def raw_connections(spark: SparkSession, path: str, spec: DatasetSpec) -> DataFrame:
    """A raw file without header: attacks to families, features and label."""
    raw = tables.read_headerless(spark, path, list(spec.raw))
    raw = raw.withColumn(spec.label, scalars.mapped(F.col("attack"), spec.family_map(), spec.other_family))
    return clean.select_features(raw, spec)


def clean_connections(spark: SparkSession, path: str, spec: DatasetSpec) -> DataFrame:
    """A raw file without header: attacks to families, features and label, cleaned, without duplicates."""
    raw = tables.read_headerless(spark, path, list(spec.raw))
    raw = raw.withColumn(spec.label, scalars.mapped(F.col("attack"), spec.family_map(), spec.other_family))
    floats, ints = column_types(spec)
    return clean.cleaned(clean.select_features(raw, spec), floats, ints, spec.label)


def split_subsets(df: DataFrame, spec: DatasetSpec, test: float = 0.30, seed: int = 42, include=None, exclude=None) -> DataFrame:
    """Rows with subset, train or test, by label."""
    rows = clean.label_filter(df, spec.label, include, exclude)
    keyed = rows.withColumn("__key__", F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))
    return split.stratified_split(keyed, spec.label, ["__key__"], test, seed).drop("__key__")


def write_subsets(df: DataFrame, spec: DatasetSpec, path: str) -> None:
    clean.routed(df, spec.label).write.mode("overwrite").partitionBy("subset", "label_safe").parquet(path)


def read_subset(spark: SparkSession, path: str, subset: str, labels: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).where(F.col("subset") == subset)
    return (df.where(F.col("label_safe").isin([scalars.safe_name_of(x) for x in labels])) if labels else df).drop("subset", "label_safe")


def fit_encoders(train: DataFrame, spec: DatasetSpec, fixed_labels: bool = False) -> dict:
    """From training rows only; labels by the specification's list, if they are to be fixed."""
    numeric = [c for c in spec.numerical if c in train.columns]
    keys = list(train.columns)
    renamed = {c: f"k{i}" for i, c in enumerate(keys)}
    keyed = train.select("*", *(F.col(f"`{c}`").alias(n) for c, n in renamed.items()))
    out = {
        "minmax": encoders.Linear.minmax(train, numeric),
        "standard": encoders.Linear.standard(train, numeric),
        "ordinal": encoders.Ordinal.fit(train, list(spec.categorical), ports=list(spec.ports), strict=spec.strict),
        "label": encoders.label_encoder(spec.label, list(spec.labels)) if fixed_labels else encoders.label_encoder(spec.label, df=train),
    }
    if spec.one_hot:
        out["onehot"] = encoders.OneHot.fit(train, list(spec.one_hot))
    if not spec.strict:
        uniform = encoders.Quantile.fit(keyed, numeric, list(renamed.values()))
        out |= {"quantile_uniform": uniform, "quantile_normal": encoders.Quantile(uniform.grids, True)}
    return out


def _numeric(made: dict, kind: str):
    if kind not in made:
        raise ValueError(f"no encoder {kind} for these data")
    return made[kind]


def encode(df: DataFrame, spec: DatasetSpec, made: dict, numerical: str = "minmax") -> DataFrame:
    """Numbers scaled, flags as whole numbers, labels as numbers, categories as columns; in this order."""
    out = _numeric(made, numerical).transform(df)
    out = out.withColumns({c: F.col(f"`{c}`").cast("int") for c in spec.binary if c in df.columns})
    if spec.label in df.columns:
        out = made["label"].transform(out)
    return made["onehot"].transform(out) if spec.one_hot else out


def decode(df: DataFrame, spec: DatasetSpec, made: dict, numerical: str = "minmax") -> DataFrame:
    """Categories, numbers, ports, labels and flags back; tiny and negative numbers to 0; columns in their order."""
    out = made["onehot"].inverse(df) if spec.one_hot else df
    out = _numeric(made, numerical).inverse(out)
    if spec.label in df.columns:
        out = made["label"].inverse(out)
    out = encoders.clamp_decoded(out, list(spec.binary), list(spec.continuous), list(spec.ports))
    return out.select(*(F.col(f"`{c}`") for c in [*spec.ordered, spec.label] if c in out.columns))


def compress(rows: DataFrame, spec: DatasetSpec, made: dict, label: str, budget: int, clusters: int | None = None, strategy: str = "diverse", percentile: float = 95.0, per_cluster: float = 3.0, fallback: str = "random", numerical: str = "standard", seed: int = 42, algorithm: str = "full") -> DataFrame:
    """Of a label's rows as many as the budget, chosen from clusters of their scaled numbers; as they were. algorithm: full or minibatch. What it stages goes with the caller's scope."""
    own = staging.stage(clean.with_copy_ids(rows.where(F.col(f"`{spec.label}`") == label)), "own")
    n = own.count()
    if n <= budget:
        return own.drop("row_id")
    scaled = _numeric(made, numerical).transform(own)
    points = scaled.select("row_id", F.array(*(F.col(f"`{c}`").cast("double") for c in spec.numerical)).alias("vec"))
    k = min(clusters or cluster.default_n_clusters(n, budget, strategy, per_cluster), n)
    if algorithm not in ("full", "minibatch"):
        raise ValueError(f"unknown algorithm: {algorithm}")
    fit = cluster.kmeans if algorithm == "full" else cluster.minibatch_kmeans
    placed, centers = fit(points, max(2, k), seed=seed)
    dist = cluster.dist_to_center(placed, centers)
    chosen = cluster.select_diverse(dist, budget, percentile) if strategy == "diverse" else cluster.select_core(dist, budget, fallback, percentile, seed)
    return clean.row_id_lookup(own, chosen, "row_id").drop("row_id")


def augment_label(rows: DataFrame, spec: DatasetSpec, made: dict, label: str, tau: int, opposite: DataFrame | None = None, test: DataFrame | None = None, numerical: str = "minmax", generator=augment.GaussianGenerator, min_precision: float | None = 0.9, seed: int = 42) -> DataFrame:
    """A label's rows brought up to tau by generated ones: encoded, generated, judged against an opposite class, decoded."""
    own = encode(rows.where(F.col(f"`{spec.label}`") == label), spec, made, numerical)
    columns = [c for c in own.columns if c != spec.label]
    plain = {c: f"f{i}" for i, c in enumerate(columns)}

    def named(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").cast("double").alias(n) for c, n in plain.items()))

    train = staging.stage(named(own), "encoded")
    score, threshold = None, None
    if opposite is not None:
        against = staging.stage(named(encode(opposite, spec, made, numerical)), "encoded")
        score, threshold = augment.fit_postfilter(train, against, list(plain.values()), min_precision=min_precision)
    known = [staging.stage(named(encode(test, spec, made, numerical)), "encoded")] if test is not None else []
    out = augment.augment_to(train, generator.fit(train, list(plain.values()), seed), list(plain.values()), tau, known, score, threshold)
    number = made["label"].values[spec.label].index(label)
    back = out.select(*(F.col(n).alias(c) for c, n in plain.items()), F.lit(number).alias(spec.label))
    return decode(back, spec, made, numerical)


def merge(parts: dict[str, DataFrame], keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Parts by name, each tagged with it as its source, in random order if keys are given."""
    out = clean.union_by_name(*(clean.tagged(df, name) for name, df in parts.items()))
    return split.shuffled(out, keys, seed) if keys else out


def prepared(df: DataFrame, spec: DatasetSpec, made: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """A model's input: features (a vector, categories and ports as numbers, in the model's order) and label, and the columns to keep."""
    out = made["ordinal"].transform(df)
    out = out.withColumns({c: F.col(f"`{c}`").cast("int") for c in spec.binary})
    out = made["label"].transform(out).withColumn("label", F.col(f"`{spec.label}`").cast("double"))
    plain = [f"f{i}" for i in range(len(spec.ordered))]
    named = out.select("label", *keep, *(F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(spec.ordered, plain, strict=True)))
    return models.assembled(named, plain).select("features", "label", *keep)


def metadata(df: DataFrame, spec: DatasetSpec, made: dict) -> dict:
    """What a model needs to know of its input."""
    stats = _stats(df, spec)
    renamed = made["ordinal"].transform(df).select(*(F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(spec.ordered)))
    clip = profile.clip_range(renamed, renamed.columns).first()
    return {
        "feature_names": list(spec.ordered),
        "class_names": made["label"].values[spec.label],
        "categorical": made["ordinal"].cardinalities,
        "stats": {c: list(v) for c, v in stats.items()},
        "clip_values": [clip.clip_min, clip.clip_max],
        "immutable": list(spec.categorical + spec.binary),
    }


def _stats(df: DataFrame, spec: DatasetSpec) -> dict:
    plain = {f"f{i}": c for i, c in enumerate(spec.continuous)}
    named = df.select(*(F.col(f"`{c}`").alias(n) for n, c in plain.items()))
    return {plain[r.feature]: (r["mean"], r["std"]) for r in profile.cont_stats(named, list(plain)).collect()}


def network_inputs(spec: DatasetSpec, made: dict) -> dict:
    """Places of a network's categories, with their numbers of values, and flags among what prepared() gives."""
    n = len(spec.categorical)
    known = made["ordinal"].cardinalities
    return {"categorical": {i: max(1, known[c]) for i, c in enumerate(spec.categorical)}, "binary": list(range(n, n + len(spec.binary)))}


def train_models(train: DataFrame, kinds: list[str], classes: int, path: str | None = None, size: int = 1, seed: int = 42, inputs: dict | None = None) -> dict[str, models.Classifier]:
    out = {}
    for kind in kinds:
        out[kind] = models.Classifier(kind, classes, inputs=inputs).fit(train, seed, size)
        if path:
            out[kind].save(path)
    return out


def load_models(path: str, kinds: list[str], classes: int) -> dict[str, models.Classifier]:
    return {k: models.Classifier.load(path, k, classes) for k in kinds}


def _voted(fitted: dict[str, models.Classifier], test: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(y_true, y_pred) of the weighted vote, as a staged table."""
    with staging.scope() as kept:
        rows = staging.stage(test.withColumn("row_id", F.monotonically_increasing_id()), "test")
        voted = models.vote(fitted, rows, "row_id", weights)
        out = staging.stage(voted.join(rows.select("row_id", F.col("label").cast("int").alias("y_true")), "row_id").select("y_true", "y_pred"), "votes")
        kept.append(out)
    return out


def evaluate_ensemble(fitted: dict[str, models.Classifier], test: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row of metrics of the weighted vote."""
    return metrics.classification_metrics(_voted(fitted, test, weights))


def perturb(df: DataFrame, spec: DatasetSpec, made: dict, model: models.Classifier, attack: str = "hsja", given: dict | None = None, samples: int | None = None, random: bool = False, scaled: bool = False, seconds: float | None = None, retries: int = 3, placeholder: str = "original", seed: int = 42) -> DataFrame:
    """Rows as an attack on a fitted model leaves them, decoded; categories, flags and labels stay.

    Values move between the smallest and the largest of all inputs, or with scaled each column between its own, as if these were 0 and 1.
    samples: the first rows, or random ones. A staged table.
    """
    with staging.scope() as kept:
        rows = clean.with_copy_ids(df)
        if samples:
            rows = split.first_by_digest(rows, ["row_id"], samples, seed) if random else split.head(rows, "row_id", samples)
        rows = staging.stage(rows, "rows")
        data = staging.stage(prepared(rows, spec, made, keep=("row_id",)).withColumn("features", vector_to_array("features")), "inputs")
        scorer = model.scorer()
        low, high = data.agg(F.min(F.array_min("features")), F.max(F.array_max("features"))).first()
        if scaled:
            ends = data.agg(*(f(F.get("features", F.lit(i))) for i in range(len(spec.ordered)) for f in (F.min, F.max))).first()
            scorer = adversarial.Scaled.of(scorer, np.array(ends[::2], float), np.array(ends[1::2], float))
            data, low, high = data.withColumn("features", scorer.inside(F.col("features"))), 0.0, 1.0
        fixed = len(spec.categorical) + len(spec.binary)
        moved = adversarial.attacked(data, scorer, attack, given, tuple(range(fixed)), low, high, seed, seconds, retries, placeholder)
        x = scorer.outside(F.col("x")) if scaled else F.col("x")
        plain = {c: f"f{i}" for i, c in enumerate(spec.continuous)}
        back = moved.withColumn("x", x).select("row_id", *(F.get("x", F.lit(fixed + i)).alias(c) for i, c in enumerate(plain)))
        out = augment.masked(rows, back, "row_id", list(plain), [], placeholder)
        out = staging.stage(out.select(*(F.col(f"`{c}`") for c in df.columns)), "perturbed")
        kept.append(out)
    return out


def robustness(fitted: dict[str, models.Classifier], plain: DataFrame, perturbed: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(model, metric, plain, perturbed, delta) of every model and, of several, of their vote."""

    def judged(model: models.Classifier, df: DataFrame) -> DataFrame:
        return model.predict(df).select(F.col("label").cast("int").alias("y_true"), "y_pred")

    rows = None
    for name, m in fitted.items():
        one = metrics.robustness_delta(judged(m, plain), judged(m, perturbed)).select(F.lit(name).alias("model"), "*")
        rows = one if rows is None else rows.unionByName(one)
    if len(fitted) > 1:
        both = metrics.robustness_delta(_voted(fitted, plain, weights), _voted(fitted, perturbed, weights))
        rows = rows.unionByName(both.select(F.lit("ensemble").alias("model"), "*"))
    return rows


def zero_profile(df: DataFrame, spec: DatasetSpec, thresholds: tuple[int, ...] = (28, 40)) -> DataFrame:
    return profile.zero_heavy_summary(df, f"`{spec.label}`", list(spec.continuous), thresholds)


def two_components(df: DataFrame, columns: list[str], label: str, cap: int, seed: int = 42) -> DataFrame:
    """(label, pc1, pc2) of a capped sample of each class, by principal components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    some = df if cap < 0 else split.capped_sample(df, label, columns, cap, seed)
    data = models.assembled(some.select(F.col(label).alias("label"), *columns), columns)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(data).transform(data)
    out = PCA(k=2, inputCol="scaled", outputCol="pc").fit(scaled).transform(scaled).withColumn("pc", vector_to_array("pc"))
    return out.select("label", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path)
