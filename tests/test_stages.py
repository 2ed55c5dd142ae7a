"""All stages on small made-up raw files of both kinds, by the command line."""

from __future__ import annotations

import functools
import json
import random

import numpy as np
import pytest

from sluice.__main__ import parser, run
from sluice.operators import models, training
from sluice.plans import stages
from sluice.spec import CONNECTIONS, FLOWS


@pytest.fixture(scope="module")
def flows(tmp_path_factory):
    rng = random.Random(1)
    root = tmp_path_factory.mktemp("flows")
    names = [*FLOWS.ordered, *FLOWS.dropped, FLOWS.label]
    (root / "raw").mkdir()
    for k in range(3):
        lines = [",".join([*(["Extra"] if k == 2 else []), *names])]
        for i in range(160):
            label = ["Benign", "Bot", "SQL Injection"][min(2, i // 70)]
            base = {"Benign": 1, "Bot": 50, "SQL Injection": 200}[label]
            row = [str(rng.choice([80, 443, 8080])), *(str(rng.randint(0, 1)) for _ in FLOWS.binary), *(f"{base + rng.random() * (j + 1):.3f}" for j in range(57)), *("0" for _ in FLOWS.dropped), label]
            lines.append(",".join([*(["x"] if k == 2 else []), *row]))
        lines += [lines[0], lines[5], lines[5].replace("Benign", " Benign "), ",".join(["x"] * len(lines[0].split(","))), lines[6].replace(lines[6].split(",")[9], "-3", 1)]
        (root / "raw" / f"{k}.csv").write_text("\n".join(lines) + "\n")
    return root


def go(spark, *args):
    run(parser().parse_args([str(a) for a in args]), spark)


def test_flows_from_raw_files_to_metrics(spark, flows, capsys, monkeypatch):
    monkeypatch.setattr(training, "Schedule", functools.partial(training.Schedule, rounds=3, rate=1e-2, batch=64))
    monkeypatch.setattr(models, "BAGGED", 30)
    r = ["--resource", "cic2018"]
    files = [str(p) for p in sorted((flows / "raw").iterdir())]
    go(spark, "merge-clean", *r, "--input", flows / "raw", "--output", flows / "clean", "--precheck", "--postcheck", "--files", *files)
    said = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert said[0]["before"]["missing"] and said[1] == {"rows_read": 495, "header_rows": 3, "missing_rows": 3, "negative_rows": 3, "clean_rows": 486, "distinct_rows": 480}
    assert said[2]["after"] == {"missing": False, "rows": 480, "distinct_rows": 480, "duplicates": 0}
    clean = spark.read.parquet(str(flows / "clean"))
    assert {x.label_safe: x["count"] for x in clean.groupBy("label_safe").count().collect()} == {"benign": 210, "bot": 210, "sql_injection": 60}
    go(spark, "split", *r, "--input", flows / "clean", "--output", flows / "split")
    counts = {(x.subset, x.label_safe): x["count"] for x in spark.read.parquet(str(flows / "split")).groupBy("subset", "label_safe").count().collect()}
    assert counts[("test", "benign")] == 63 and counts[("train", "sql_injection")] == 42
    go(spark, "setup-encoders", *r, "--input", flows / "split", "--output", flows / "enc")
    enc = ["--encoders", flows / "enc"]
    go(spark, "encode", *r, *enc, "--input", flows / "split", "--output", flows / "encoded", "--num-encoder", "minmax")
    go(spark, "decode", *r, *enc, "--input", flows / "encoded", "--output", flows / "decoded")
    before, after = stages.read_subset(spark, str(flows / "split"), "train"), spark.read.parquet(str(flows / "decoded"))
    order = [*FLOWS.ordered, "Label"]
    x, y = (df.toPandas()[order].sort_values(["Flow Duration", "Tot Fwd Pkts", "Idle Min"]) for df in (before, after))
    assert x["Label"].tolist() == y["Label"].tolist() and np.allclose(x[order[:-1]].astype(float), y[order[:-1]].astype(float), atol=1e-6)
    go(spark, "compress", *r, *enc, "--input", flows / "split", "--output", flows / "major", "--labels", "Benign", "Bot", "--budget", 60, "--jobs", 2)
    go(spark, "augment", *r, *enc, "--input", flows / "split", "--output", flows / "minor", "--labels", "SQL Injection", "--tau", 70)
    major, minor = ([str(p) for p in sorted((flows / k).iterdir())] for k in ("major", "minor"))
    go(spark, "merge", *r, "--output", flows / "train", "--shuffle", "--major", *major, "--minor", *minor)
    train = spark.read.parquet(str(flows / "train"))
    assert sorted((x.Label, x["count"]) for x in train.groupBy("Label").count().collect()) == [("Benign", 60), ("Bot", 60), ("SQL Injection", 70)]
    assert train.select("__source__").distinct().count() == 3
    go(spark, "sample", *r, "--input", flows / "split", "--output", flows / "test", "--tau", 15)
    assert spark.read.parquet(str(flows / "test")).count() == 45
    go(spark, "train", *r, *enc, "--input", flows / "train", "--output", flows / "models", "--models", "bagging", "dnn", "xgb", "--exclude-models", "xgb")
    go(spark, "evaluate", *r, *enc, "--input", flows / "test", "--models_path", flows / "models", "--output", flows / "metrics", "--models", "bagging")
    assert spark.read.json(str(flows / "metrics")).first().accuracy > 0.95
    attack = [*r, *enc, "--input", flows / "test", "--models_path", flows / "models", "--space", "scaled"]
    go(spark, "perturb", *attack, "--output", flows / "adv", "--model", "dnn", "--attack", "pgd", "--attack-params", '{"targeted": false, "eps": 0.4}')
    adv, fixed = spark.read.parquet(str(flows / "adv")), ["`Dst Port`", *(f"`{c}`" for c in FLOWS.binary), "Label"]
    assert adv.count() == 45 and adv.select(*fixed).exceptAll(spark.read.parquet(str(flows / "test")).select(*fixed)).count() == 0
    go(spark, "robustness", *r, *enc, "--input", flows / "test", "--perturbed", flows / "adv", "--models_path", flows / "models", "--output", flows / "delta", "--models", "bagging", "dnn")
    delta = {(x.model, x.metric): x.delta for x in spark.read.json(str(flows / "delta")).collect()}
    assert len(delta) == 12 and {m for m, _ in delta} == {"bagging", "dnn", "ensemble"} and delta["dnn", "accuracy"] < 0
    quick = json.dumps({"max_iter": 1, "init_eval": 3, "init_size": 5})
    go(spark, "perturb", *attack, "--output", flows / "adv2", "--model", "bagging", "--attack", "hsja", "--attack-params", quick, "--samples", 5, "--timeout", 30.0, "--placeholder", "drop")
    assert spark.read.parquet(str(flows / "adv2")).count() <= 5
    go(spark, "zero-profile", *r, "--input", flows / "clean", "--output", flows / "zeros")
    assert spark.read.option("header", True).csv(str(flows / "zeros")).count() == 3


def test_connections(spark, tmp_path):
    rng = random.Random(2)
    lines = []
    for i in range(120):
        row = {c: str(rng.randint(0, 9)) for c in CONNECTIONS.raw} | {"protocol_type": rng.choice(["tcp", "udp"]), "service": rng.choice(["http", "smtp"]), "flag": "SF", "attack": ["normal", "smurf", "nmap"][i % 3]}
        row |= {c: "1" for c in CONNECTIONS.binary}
        lines.append(",".join(row[c] for c in CONNECTIONS.raw))
    (tmp_path / "kdd.txt").write_text("\n".join(lines))
    df = stages.clean_connections(spark, str(tmp_path / "kdd.txt"), CONNECTIONS)
    assert sorted({r.Label for r in df.select("Label").collect()}) == ["Benign", "DoS", "Probe"]
    made = stages.fit_encoders(df, CONNECTIONS)
    there = stages.encode(df, CONNECTIONS, made, "standard")
    assert there.columns[:5] == ["protocol_type_tcp", "protocol_type_udp", "service_http", "service_smtp", "flag_SF"]
    back = stages.decode(there, CONNECTIONS, made, "standard")
    assert back.count() == df.count() and back.columns == [*CONNECTIONS.ordered, "Label"]
    with pytest.raises(ValueError, match="no encoder"):
        stages.encode(df, CONNECTIONS, made, "quantile_uniform")
    meta = json.loads(json.dumps(stages.metadata(df, CONNECTIONS, made)))
    assert meta["class_names"] == ["Benign", "DoS", "Probe"] and meta["categorical"]["service"] == 2 and len(meta["stats"]) == 34
    assert stages.two_components(df, ["duration", "src_bytes", "hot"], "Label", 10).count() == 30
