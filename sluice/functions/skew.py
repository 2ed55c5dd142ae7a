"""Joins with tables that say how frequent a key is, so that frequent keys aren't dealt to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is broadcast; there are fewer such keys than that.
PARTS = 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, total: int, parts: int = PARTS) -> DataFrame:
    """rows joined with counted, which has a row for each value of keys with its number of rows, n; keys aren't null.

    The few keys that hold a part of all rows are broadcast back to these, others are joined by key.
    """
    heavy = F.col(n) * parts > total
    known = [c for c in counted.columns if c not in keys]
    first = rows.join(F.broadcast(counted.where(heavy)), keys, "left")
    rest = first.where(F.col(n).isNull()).drop(*known).join(counted.where(~heavy), keys)
    return first.where(F.col(n).isNotNull()).unionByName(rest)
