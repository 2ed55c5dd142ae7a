"""Shards of consecutive runs along a Hilbert curve through the documents' metadata, by DataFrame functions alone.

Language, source and size are quantised into 32 steps each that keep their order: strings are compared with cuts that are
quantiles of all distinct values (by their first 256 characters), sizes are cut at quantiles of the rows. The cells of that cube
follow one another along the curve, so that a shard covers a compact part of it and files can be left out by minimum and
maximum in any of the three. Runs are cut by rank: shards' row counts are at most one apart, whatever a cell holds.

Ranks need no global sort: cells are counted (32 768 at most), a large cell is dealt by hash into parts of bounded size,
and rows are numbered within a part. Null text has no bytes and the checksum of no bytes. Null languages and sources
come before all others. Rows with equal or null ids are dealt each by itself; rows equal in all may change places. An
empty table gives an empty one; very long texts are only measured. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice import staging

#: Bits of each of the three coordinates; rows that a part of a cell has about; characters of a string that its order goes by.
BITS, PART, PREFIX = 5, 10_000, 256
#: Crowded parts that are broadcast at most.
CROWDED = 10_000


def ordered(value: Column) -> Column:
    """A string that sorts like the value, null before all others."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("x"), F.substring(value.cast("string"), 1, PREFIX)))


def _string_cuts(rows: DataFrame, column: str) -> list[str]:
    """At most 2**BITS - 1 of the distinct strings, between which there are as many of them each.

    All are sorted by ranges; which range and row within it has a cut follows from the ranges' counts, so that cuts alone come to the driver.
    """
    ranges = rows.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    # the number of the partition is above 33 bits for the row within it
    values = staging.stage(ranges.withColumn("at", F.monotonically_increasing_id()), "values")
    counts = values.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()  # as many as shuffle partitions
    total = sum(r.n for r in counts)
    wanted, before = [], 0
    places = sorted({math.ceil(i * total / (1 << BITS)) - 1 for i in range(1, 1 << BITS)} - {total - 1} - {-1})
    for r in counts:
        wanted += [(r.range << 33) + p - before for p in places if before <= p < before + r.n]
        before += r.n
    return sorted((r[0] for r in values.where(F.col("at").isin(wanted)).select(column).collect()), key=str.encode) if wanted else []


def _cuts(values: DataFrame, column: str) -> list[int]:
    """At most 2**BITS - 1 numbers between which there are as many rows each about."""
    share = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    found = values.agg(F.percentile_approx(column, share, 10_000).alias("cuts"), F.max(column).alias("most")).first()
    return sorted({c for c in found.cuts or [] if c < found.most})


def _step(value: Column, cuts: list[int] | list[str]) -> Column:
    """How many cuts a number or string is above of, spread over all steps, so that few values differ in the first bits."""
    # without cuts nothing is counted, but not as a constant: it would be folded through all of the curve's columns
    above = F.size(F.filter(F.lit(cuts), lambda c: c < value)) if cuts else F.when(value.isNull(), F.lit(1)).otherwise(F.lit(0))
    return F.floor(above * F.lit((1 << BITS) - 1) / F.lit(max(1, len(cuts)))).cast("int")


def along(cells: DataFrame, coordinates: list[str], bits: int) -> DataFrame:
    """cells with a column h, the index along a Hilbert curve of the point with these coordinates.

    By reflections and exchanges of the lower bits from the top down, then a Gray code: every step is a column of its own.
    """
    n = len(coordinates)
    df = cells.select("*", *(F.col(c).cast("long").alias(f"_x{i}") for i, c in enumerate(coordinates)))
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            set_ = F.col(f"_x{i}").bitwiseAND(1 << b) != 0
            swap = F.col("_x0").bitwiseXOR(F.col(f"_x{i}")).bitwiseAND(low)
            df = df.withColumn("_t", F.when(set_, F.lit(0)).otherwise(swap)).withColumn("_f", F.when(set_, F.lit(low)).otherwise(F.lit(0)))
            df = df.withColumn("_x0", F.col("_x0").bitwiseXOR(F.col("_t")).bitwiseXOR(F.col("_f")))
            if i:
                df = df.withColumn(f"_x{i}", F.col(f"_x{i}").bitwiseXOR(F.col("_t")))
    for i in range(1, n):
        df = df.withColumn(f"_x{i}", F.col(f"_x{i}").bitwiseXOR(F.col(f"_x{i - 1}")))
    flip = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        flip = F.when(F.col(f"_x{n - 1}").bitwiseAND(1 << b) != 0, flip.bitwiseXOR(F.lit((1 << b) - 1))).otherwise(flip)
    df = df.withColumn("_f", flip)
    h = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            h = h * 2 + F.shiftright(F.col(f"_x{i}").bitwiseXOR(F.col("_f")), b).bitwiseAND(1)
    return df.withColumn("h", h).drop("_t", "_f", *(f"_x{i}" for i in range(n)))


def assign(docs: DataFrame, shards: int = 16, keep: tuple[str, ...] = (), **columns) -> DataFrame:
    """(doc_id, size, text_crc32, cell, h, shard, slot) of every row, and the columns to keep under the names kept_...; slot counts up from 0 in each shard. A staged table."""
    with staging.scope() as kept:
        out = staging.stage(_assigned(docs, shards, keep, **columns), "shards")
        kept.append(out)
    return out


def _assigned(docs: DataFrame, shards: int, keep: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", part: int = PART) -> DataFrame:
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    size = F.octet_length(raw).cast("long") + 1
    names = {"x": F.col(lang_col).cast("string"), "y": F.col(source_col).cast("string")}
    keys = [ordered(v).alias(f"{k}_key") for k, v in names.items()]
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("row"), *keys, *(F.col(c).alias(f"kept_{c}") for c in keep))
    rows = staging.stage(measured, "hilbert")
    steps = {k: _step(F.col(f"{k}_key"), _string_cuts(rows, f"{k}_key")) for k in names} | {"z": _step(F.col("size"), _cuts(rows, "size"))}
    side = 1 << BITS
    rows = rows.withColumns(steps).withColumn("cell", (F.col("x") * side + F.col("y")) * side + F.col("z")).drop("x_key", "y_key")
    cells = rows.groupBy("cell", "x", "y", "z").agg(F.count("*").alias("n"))
    order = Window.orderBy("h")  # over the cells: 32 768 rows at most
    cells = along(cells, ["x", "y", "z"], BITS).select("cell", "h", F.ceil(F.col("n") / part).cast("int").alias("parts"), (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    dealt = rows.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("parts")).cast("int"))
    counts = dealt.groupBy("cell", "part").agg(F.count("*").alias("m"))
    # equal rows share a part: one that has too many is dealt on, by row, to several; there are few such parts
    crowded = staging.stage(counts.where(F.col("m") > 4 * part).select("cell", "part", F.ceil(F.col("m") / part).cast("int").alias("pieces")), "crowded")
    split = F.lit(0)
    if not crowded.isEmpty():
        dealt = dealt.join(crowded.hint("broadcast") if crowded.count() <= CROWDED else crowded, ["cell", "part"], "left")
        split = F.coalesce(F.pmod(F.col("row"), F.col("pieces")).cast("int"), F.lit(0))
    dealt = dealt.withColumn("piece", split)
    counts = dealt.groupBy("cell", "part", "piece").agg(F.count("*").alias("m"))
    counts = counts.select("cell", "part", "piece", (F.sum("m").over(Window.partitionBy("cell").orderBy("part", "piece")) - F.col("m")).alias("skip"))
    number = F.row_number().over(Window.partitionBy("cell", "part", "piece").orderBy("text_crc32", "size", "doc_id")) - 1
    ranked = dealt.withColumn("number", number).join(counts, ["cell", "part", "piece"]).withColumn("rank", F.col("before") + F.col("skip") + F.col("number"))
    # the first shards have one row more
    less, more = F.floor(F.col("total") / shards), F.col("total") % shards
    edge = more * (less + 1)
    shard = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (less + 1))).otherwise(more + F.floor((F.col("rank") - edge) / F.greatest(less, F.lit(1))))
    out = ranked.withColumn("shard", shard.cast("int"))
    slot = F.col("rank") - F.when(F.col("shard") <= more, F.col("shard") * (less + 1)).otherwise(edge + (F.col("shard") - more) * less)
    return out.select("doc_id", "size", "text_crc32", "cell", "h", "shard", slot.cast("long").alias("slot"), *(f"kept_{c}" for c in keep))


def write(docs: DataFrame, path: str, shards: int = 16, **columns) -> str:
    """Writes docs as Parquet, a folder for each shard, rows in the order of their slots; gives the folders' key: shard, or a name like it that docs doesn't have."""
    names, key = docs.columns, "shard"
    while key in (n.lower() for n in names):
        key += "_"
    with staging.scope():
        dealt = _assigned(docs, shards, tuple(names), **columns).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
        dealt.select(F.col("shard").alias(key), *(F.col(f"kept_{c}").alias(c) for c in names)).write.partitionBy(key).parquet(path)
    return key


def sharded(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell", "h")
