"""Cleaning of files as they arrive: each micro-batch is cleaned like a table, duplicates are remembered across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluice.functions import scalars
from sluice.operators import clean


def read_stream(spark: SparkSession, folder: str, columns: list[str], files_per_batch: int = 100) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.readStream.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def cleaned_stream(raw: DataFrame, floats: list[str], ints: list[str], label: str, dedup: bool = True) -> DataFrame:
    """Without a watermark state holds every distinct row; give raw a watermark and dedup=False to bound it otherwise."""
    df = clean.coerce(clean.drop_header_rows(raw, label), floats, ints, label)
    df = clean.drop_negative_rows(clean.drop_missing_inf(df))
    return df.dropDuplicates() if dedup else df


def write_stream(df: DataFrame, label: str, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, once, into a folder for each label; a batch that is repeated replaces what it wrote."""
    out = df.withColumn("label_safe", scalars.safe_name(F.col(f"`{label}`")))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("label_safe").parquet(f"{path}/batch={number}")

    return out.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(df: DataFrame, label: str) -> DataFrame:
    """Labels counted so far, as a stream."""
    return df.groupBy(F.col(label).alias("label")).count()
