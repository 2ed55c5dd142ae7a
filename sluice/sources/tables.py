"""Raw files in, tables out: CSV with and without headers, the schema most files share, partitions by label, metrics."""

from __future__ import annotations

from concurrent import futures

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import scalars


#: Files whose first lines are read at a time.
AT_A_TIME = 16


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line of each file ("" if it has none), by the stores' own interface, compressed ones too: no job, and no more than a line is read of any."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def one(path: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(path)
        raw = at.getFileSystem(conf).open(at)
        try:
            codec = codecs.getCodec(at)
            stream = raw if codec is None else codec.createInputStream(raw)
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
        finally:
            raw.close()

    with futures.ThreadPoolExecutor(AT_A_TIME) as pool:
        return dict(zip(paths, pool.map(inheritable_thread_target(spark)(one), paths), strict=True))


def _names(line: str) -> list[str]:
    return [c.strip() for c in line.split(",")] if line else []


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, trimmed; only its first line is read."""
    return _names(first_lines(spark, [path])[path])


def headers(spark: SparkSession, paths: list[str], heads: dict[str, str] | None = None) -> DataFrame:
    """(file, columns) of CSV files; heads: their first lines, if known."""
    heads = first_lines(spark, paths) if heads is None else heads
    return spark.createDataFrame([(p, _names(heads[p])) for p in sorted(paths)], "file string, columns array<string>")


def majority_schema(headers: DataFrame) -> DataFrame:
    """One row (columns, files): the list of columns that most files have; of equally frequent ones that of the first file."""
    votes = headers.groupBy("columns").agg(F.count("*").alias("files"), F.min("file").alias("first"))
    return votes.orderBy(F.desc("files"), "first").limit(1).select("columns", "files")


def schema_outliers(headers: DataFrame, columns: list[str]) -> DataFrame:
    """(file, extra, missing) of files with other columns."""
    want = F.array(*(F.lit(c) for c in columns))
    diff = headers.select("file", F.array_except("columns", want).alias("extra"), F.array_except(want, F.col("columns")).alias("missing"))
    return diff.where((F.size("extra") > 0) | (F.size("missing") > 0))


def read_csv(spark: SparkSession, paths: list[str], columns: list[str], heads: dict[str, str] | None = None) -> DataFrame:
    """Files with headers, as strings, these columns only; a file that lacks one is an error. Leading blanks are ignored. heads: their first lines, if known."""
    out = None
    heads = first_lines(spark, paths) if heads is None else heads
    by_header: dict[tuple, list[str]] = {}
    for p in sorted(paths):
        by_header.setdefault(tuple(_names(heads[p])), []).append(p)
    for names, files in by_header.items():
        if missing := [c for c in columns if c not in names]:
            raise ValueError(f"{files[0]} lacks {missing}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).csv(files).select(*(F.col(f"`{c}`") for c in columns))
        out = part if out is None else out.unionByName(part)
    return out


def read_headerless(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)


#: Rows that a file of a label has about.
ROWS_OF_FILE = 500_000


def write_by_label(df: DataFrame, label: str, path: str, rows_of_file: int | None = None) -> None:
    """A folder for each label; a label's rows are spread over as many tasks, and files, as its number of rows asks for."""
    from sluice import staging

    columns, free = [F.col(f"`{c}`") for c in df.columns], "_" * (1 + max(map(len, df.columns)))
    out = df.withColumn("label_safe", scalars.safe_name(F.col(f"`{label}`")))
    files = out.groupBy("label_safe").agg(F.ceil(F.count("*") / F.lit(rows_of_file or ROWS_OF_FILE)).cast("int").alias(f"{free}n"))
    # as many rows as labels
    dealt = out.join(files.withColumnRenamed("label_safe", f"{free}of"), F.col("label_safe").eqNullSafe(F.col(f"{free}of"))).withColumn(f"{free}salt", F.pmod(F.xxhash64(*columns), F.col(f"{free}n")))
    dealt = dealt.repartition(staging.partitions(df.sparkSession), "label_safe", f"{free}salt").select(*columns, "label_safe")
    dealt.write.mode("overwrite").partitionBy("label_safe").parquet(path)


def read_labels(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """All labels, or those given: other folders aren't read."""
    df = spark.read.parquet(path)
    return df.where(F.col("label_safe").isin([scalars.safe_name_of(x) for x in labels])) if labels else df


def clean_merged_name(resource: str, label: str, subset: str | None = None) -> str:
    return "_".join([resource, scalars.safe_name_of(label), *([subset] if subset else []), "clean_merged"])


def encoded_name(resource: str, label: str, subset: str) -> str:
    return f"{resource}_{scalars.safe_name_of(label)}_{subset}_encoded"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def find_models(spark: SparkSession, path: str, kinds: tuple[str, ...], exclude: tuple[str, ...] = ()) -> dict[str, str]:
    """kind to folder, of the models that are saved there; in any store."""
    return {k: p for k in kinds if k not in exclude and exists(spark, p := f"{path.rstrip('/')}/{k}")}


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
