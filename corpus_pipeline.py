"""A training corpus from raw documents: quality, near duplicates, personal data, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Rows with a null doc_id pass the
stages that go by links, empty texts are judged by the quality stage like any other, extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import staging
from sluice.llm import bpe, jaccard, mixing, pii, quality

#: Score below which the quality stage rejects a document.
THRESHOLD = 0.3
#: Characters of a chunk of the last stage: smaller than by default, as workers of the stages before still hold memory.
CHUNK_CHARS = 4_000_000
#: Shares of the domains' tokens after mixing, in proportion to the good and clean ones, which all stay.
WEIGHTS = {"q1t0": 0.95, "q1t1": 0.03, "q0t0": 0.015, "q0t1": 0.005}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a staged table, computed with small Arrow batches, as its rows hold whole texts."""
    with staging.small_batches(df.sparkSession):
        return staging.stage(df, name)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches THRESHOLD. Null and empty texts are scored like any other, each repeated row by itself."""
    return _written(quality.kept(docs, quality.train(docs, _labels(spark, sf_dir), threshold=THRESHOLD), THRESHOLD), "quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays; of rows with the same id the first by text (a null one before all others), then by the other columns. Rows with a null id and empty texts stay."""
    found = jaccard.join(docs)
    out = jaccard.first_of_each(docs, found)
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        least = out.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row"))
        out = least.select(*(F.col("doc_id") if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns)).unionByName(out.where("doc_id is null"))
    return _written(out, "near-duplicates")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in its text replaced by its kind in brackets, and the new length. Null texts stay null."""
    return _written(pii.redact(docs, length_col="n_chars"), "personal-data")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their copies; those that may well be good and clean have a rate of 1, the others of 1 at most. Rows are rated each by itself; extra columns stay."""
    classifier = mixing.train(docs, _labels(spark, sf_dir))
    rated = mixing.fit(docs, classifier, WEIGHTS, anchor="q1t0", keep="q1t0", keep_from=0.25, high=1.0, carry=tuple(docs.columns))
    rows = rated.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of ids and of what they decode to."""
    return bpe.digests(docs, keep_ids=True, chunk_chars=CHUNK_CHARS)


STAGES = [("quality", by_quality), ("near duplicates", near_duplicates), ("personal data", without_personal_data), ("mixing", mix), ("tokens", tokens)]
#: Classifiers and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. Every stage's table is written in the shared folder, where the next one reads it; all but the last are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with staging.scope() as kept:
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            docs = docs if hasattr(docs, "staged_at") else _written(docs, name.replace(" ", "-"))
        kept.append(docs)
    return docs
