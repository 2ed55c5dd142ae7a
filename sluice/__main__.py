"""python -m sluice STAGE ...: the stages on folders of Parquet tables. Paths may be in any store that Spark reads."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from sluice import staging
from sluice.functions import encoders
from sluice.operators import augment, clean, models, split
from sluice.plans import stages
from sluice.sources import tables
from sluice.spec import SPECS


#: What makes rows of a rare label.
GENERATORS = {"gaussian": augment.GaussianGenerator, "flow": augment.FlowGenerator, "learnt-flow": augment.LearntFlow}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sluice")
    sub = top.add_subparsers(dest="stage", required=True)

    def add(name: str, *paths: str, **options):
        p = sub.add_parser(name)
        p.add_argument("--resource", choices=sorted(SPECS), required=True)
        for x in paths:
            p.add_argument(f"--{x}", required=True)
        for x, default in options.items():
            flag = f"--{x.replace('_', '-')}"
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            elif default is None or isinstance(default, list):
                p.add_argument(flag, nargs="*" if isinstance(default, list) else None, default=default)
            else:
                p.add_argument(flag, type=type(default), default=default)
        return p

    add("merge-clean", "input", "output", files=[], precheck=False, postcheck=False)
    add("split", "input", "output", labels=[], exclude_labels=[], test_size=0.30, random_state=42)
    add("setup-encoders", "input", "output", label_set="fixed")
    add("encode", "input", "encoders", "output", subset="train", num_encoder="standard", labels=[])
    add("compress", "input", "encoders", "output", labels=[], budget=20_000, n_clusters=0, strategy="diverse", edge_percentile=95.0, per_cluster=3.0, core_fallback="random", kmeans_algo="full", jobs=1)
    add("augment", "input", "encoders", "output", labels=[], tau=10_000, opposite_label="Benign", num_encoder="minmax", generator="gaussian", jobs=1)
    add("decode", "input", "encoders", "output", numerical_inverse="minmax")
    add("merge", "output", major=[], minor=[], shuffle=False, random_state=42)
    add("sample", "input", "output", tau=1000, labels=[], seed=42)
    add("train", "input", "encoders", "output", models=["xgb", "bagging"], exclude_models=[], size=1)
    add("evaluate", "input", "encoders", "models_path", "output", models=["xgb", "bagging"], mode="ensemble")
    add("perturb", "input", "encoders", "models_path", "output", model="xgb", attack="hsja", attack_params="{}", samples=0, sampling_mode="first", space="raw", timeout=0.0, max_retries=3, placeholder="original")
    add("robustness", "input", "perturbed", "encoders", "models_path", "output", models=["xgb"])
    add("zero-profile", "input", "output")
    return top


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    spec = SPECS[args.resource]
    made = encoders.load_all(spark, args.encoders) if getattr(args, "encoders", None) else {}
    names = list(getattr(args, "labels", None) or spec.labels)
    if unknown := [x for x in names if x not in spec.labels]:
        raise ValueError(f"unknown labels: {unknown}")
    match args.stage:
        case "merge-clean":
            if spec.raw:
                raw = stages.raw_connections(spark, args.input, spec)
            else:
                raw = stages.raw_flows(spark, args.files or [f.path for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(args.input).select("path").collect()], spec)
            if args.precheck:
                print(json.dumps({"before": stages.problems(clean.coerce(raw, *stages.column_types(spec), spec.label))}))
            print(json.dumps(stages.clean_and_write(raw, spec, args.output)))
            if args.postcheck:
                print(json.dumps({"after": stages.problems(tables.read_labels(spark, args.output).drop("label_safe"))}))
        case "split":
            df = tables.read_labels(spark, args.input, args.labels or None).drop("label_safe")
            stages.write_subsets(stages.split_subsets(df, spec, args.test_size, args.random_state, exclude=args.exclude_labels), spec, args.output)
        case "setup-encoders":
            encoders.save_all(spark, stages.fit_encoders(stages.read_subset(spark, args.input, "train"), spec, args.label_set == "fixed"), args.output)
        case "encode":
            _write(stages.encode(stages.read_subset(spark, args.input, args.subset, names), spec, made, args.num_encoder), args.output)
        case "compress":
            rows = stages.read_subset(spark, args.input, "train", names)


            def compress(x: str) -> None:
                with staging.scope():
                    out = stages.compress(rows, spec, made, x, args.budget, args.n_clusters or None, args.strategy, args.edge_percentile, args.per_cluster, args.core_fallback, algorithm=args.kmeans_algo)
                    _write(out, f"{args.output}/{tables.clean_merged_name(spec.name, x, 'compressed')}")

            stages.by_label(spark, names, compress, args.jobs)
        case "augment":


            def augmented(x: str) -> None:
                with staging.scope():
                    rows = stages.read_subset(spark, args.input, "train", [x])
                    other = stages.read_subset(spark, args.input, "train", [args.opposite_label])
                    out = stages.augment_label(rows, spec, made, x, args.tau, other, stages.read_subset(spark, args.input, "test", [x]), args.num_encoder, GENERATORS[args.generator])
                    _write(out, f"{args.output}/{tables.clean_merged_name(spec.name, x, 'augmented')}")

            stages.by_label(spark, names, augmented, args.jobs)
        case "decode":
            _write(stages.decode(spark.read.parquet(args.input), spec, made, args.numerical_inverse), args.output)
        case "merge":
            parts = {f"{kind}:{p.rstrip('/').rpartition('/')[2]}": spark.read.parquet(p) for kind, paths in (("major", args.major), ("minor", args.minor)) for p in paths}
            keys = sorted({c for df in parts.values() for c in df.columns}) if args.shuffle else None
            _write(stages.merge(parts, [f"`{c}`" for c in keys] if keys else None, args.random_state), args.output)
        case "sample":
            df = stages.read_subset(spark, args.input, "test", names)
            keyed = clean.with_row_id(df, *(f"`{c}`" for c in df.columns))
            _write(split.capped_sample(keyed, spec.label, ["row_id"], args.tau, args.seed).drop("row_id"), args.output)
        case "train":
            data = stages.prepared(clean.dedup(spark.read.parquet(args.input)), spec, made)
            stages.train_models(data, [k for k in args.models if k not in args.exclude_models], len(made["label"].values[spec.label]), args.output, args.size, inputs=stages.network_inputs(spec, made))
        case "evaluate":
            data = stages.prepared(clean.dedup(spark.read.parquet(args.input)), spec, made)
            fitted = stages.load_models(args.models_path, args.models, len(made["label"].values[spec.label]))
            tables.write_metrics(stages.evaluate_ensemble(fitted, data) if args.mode == "ensemble" else models.evaluate_all(fitted, data), args.output)
        case "perturb":
            model = stages.load_models(args.models_path, [args.model], len(made["label"].values[spec.label]))[args.model]
            given = json.loads(args.attack_params)
            _write(stages.perturb(spark.read.parquet(args.input), spec, made, model, args.attack, given, args.samples or None, args.sampling_mode == "random", args.space == "scaled", args.timeout or None, args.max_retries, args.placeholder), args.output)
        case "robustness":
            fitted = stages.load_models(args.models_path, args.models, len(made["label"].values[spec.label]))
            both = [stages.prepared(spark.read.parquet(p), spec, made) for p in (args.input, args.perturbed)]
            tables.write_metrics(stages.robustness(fitted, *both), args.output)
        case "zero-profile":
            tables.write_csv(stages.zero_profile(tables.read_labels(spark, args.input), spec), args.output)


def main() -> None:
    args = parser().parse_args()
    run(args, SparkSession.builder.appName(f"sluice {args.stage}").getOrCreate())


if __name__ == "__main__":
    main()
