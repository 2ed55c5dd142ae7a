"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(of: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(of).cast("string").cast("binary")), F.lit(n))


#: Characters of a text that are taken at most, in how many windows, and of all texts, half of them for each label: what comes to the driver is bounded.
LONGEST, WINDOWS, TOTAL = 50_000, 5, 64_000_000


def windowed(text: Column, longest: int = LONGEST) -> Column:
    """A text, or of a longer one WINDOWS parts of equal length that lie evenly over all of it, a line break between them."""
    part = longest // WINDOWS
    starts = [F.floor((F.length(text) - part) * F.lit(i) / (WINDOWS - 1)).cast("int") + 1 for i in range(WINDOWS)]
    return F.when(F.length(text) <= longest, text).otherwise(F.concat_ws("\n", *(F.substring(text, s, F.lit(part)) for s in starts)))


def sample(docs: DataFrame, labels: DataFrame, label: str, where, positives: int, negatives: int, longest: int = LONGEST, total: int = TOTAL) -> list[tuple[str, int]]:
    """(text, label) of at most so many labelled documents for which where holds, those of the smallest hashes of their ids.

    Drawn are labelled ids that docs has, until their number or half of total characters is reached; of a text longer than longest,
    windows of it are taken. The bounds keep what comes to the driver and what is broadcast independent of the corpus.
    Null labels don't count; of documents with the same id and label, the first by text stands for all. A label without
    a document is said in a warning.
    """
    known = labels.where(F.col(label).isin(0, 1)).where(where).where("doc_id is not null").select("doc_id", F.col(label).alias("y")).distinct()
    sizes = docs.where("doc_id is not null").select("doc_id", F.least(F.coalesce(F.length("text"), F.lit(0)), F.lit(longest)).alias("size"))
    there = known.join(sizes, "doc_id").groupBy("doc_id", "y").agg(F.max("size").cast("long").alias("size")).withColumn("order", F.xxhash64("doc_id"))
    picked = None
    for value, most in ((1, positives), (0, negatives)):
        some = there.where(F.col("y") == value).orderBy("order", "doc_id").limit(most)
        before = F.sum("size").over(Window.partitionBy("y").orderBy("order", "doc_id")) - F.col("size")  # of most rows
        some = some.withColumn("before", before).where(F.col("before") < total // 2).select("doc_id", "y")
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.select("doc_id", "y", windowed(F.col("text"), longest).alias("text")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = sorted((r.doc_id, r.text, r.y) for r in rows.toLocalIterator())
    for value in (0, 1):
        if not any(y == value for _, _, y in found):
            warnings.warn(f"no document with {label} = {value} to learn from", stacklevel=2)
    return [(t, y) for _, t, y in found]
