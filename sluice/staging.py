"""Tables written between the stages of one job, in a folder that every executor can read."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where the session has none: a temporary folder if everything runs in one JVM; on a cluster that is an error, as no
    other folder is known to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local-") and spark.sparkContext.master.startswith("local"):
        if "local" not in _own:
            _own["local"] = path = tempfile.mkdtemp(prefix="sluice-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        return "file://" + _own["local"]
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"


#: The scopes that the running thread or task is in, the innermost last; each has the tables staged in it.
_scopes: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scope(*keep: DataFrame):
    """Tables staged within, by the same thread, but for those in the list that it gives, are deleted at its end."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = list(keep)
    outer = _scopes.get()
    token = _scopes.set((*outer, made))
    try:
        yield kept
    finally:
        _scopes.reset(token)
        for df in made:
            if not any(df is k for k in kept):
                drop(df)
            elif outer:
                outer[-1].append(df)


def _clear(spark: SparkSession) -> None:
    """What this process has staged and not dropped goes when it ends, if its session still runs."""
    with contextlib.suppress(Exception):
        for path in list(_left):
            delete(spark, path)


_left: set[str] = set()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: what follows doesn't depend on executors' disks."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if not _left:
        atexit.register(_clear, spark)
    _left.add(path)
    if _scopes.get():
        _scopes.get()[-1].append(out)
    return out


def drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    for made in _scopes.get():
        made[:] = [x for x in made if x is not df]
    delete(df.sparkSession, df.staged_at)


_batches = threading.Lock()
#: How many threads are within small_batches, and the setting before the first of them.
_within: list[str] = []


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of so many rows for what is run within, unless the session says otherwise: rows hold whole texts.

    The setting is the session's: of several threads the first changes it and the last puts it back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _batches:
        before = _within[0] if _within else spark.conf.get(key)
        _within.append(before)
        if before == "10000":
            spark.conf.set(key, str(min(rows, int(spark.conf.get(key)))))
    try:
        yield
    finally:
        with _batches:
            _within.pop()
            if not _within:
                spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _left.discard(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
