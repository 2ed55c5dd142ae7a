"""Exact duplicates by progressive refinement: lengths, then hashes of beginnings, then of whole texts, by DataFrame functions alone.

1. One pass over the texts writes every row's length in bytes and a hash of its beginning. Lengths that several rows have
   are counted; of the rows with such a length, beginnings that several of them share.
2. A second pass digests in full the texts whose length and beginning are repeated, and no others: those are known to be
   alone. Which are is looked up in a broadcast bitmap of 16 bits for each repeated key, up to a fixed size; a bit that is
   set by chance costs a digest and changes nothing.
3. Digests are grouped. The groups that hold a thousandth of the rows or more, of which there are a thousand at most, are
   broadcast back to their rows; the others are joined, so that no key of that join is frequent.

Texts are equal when identical after A-Z became a-z; a null text counts as empty, and all empty ones are equal. Of equal
texts the row with the largest id stays, a null id being smaller than any other; of rows that have that id in common, one.
Very long texts are digested as they stream through a task. An empty table gives an empty one. Other columns don't matter,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import staging

#: Characters of a text's beginning; bits of the bitmap for each key and at most; part of all rows that makes a group heavy.
HEAD, BITS_OF_KEY, MOST_BITS, HEAVY = 256, 16, 1 << 29, 1000
#: Bits in a row of a bitmap, as the functions over bitmaps have it.
ROW_BITS = 32_768
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def _bits(keys: DataFrame) -> int:
    n = BITS_OF_KEY * keys.count()
    return min(MOST_BITS, max(ROW_BITS, 1 << (n - 1).bit_length() if n else 0))


def _marked(rows: DataFrame, keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """rows with a column that is true where keys has the row's values of these columns, and seldom where it hasn't.

    keys become a bitmap of MOST_BITS at most, which is broadcast: 64 MB, however many keys there are.
    """
    bits = _bits(keys)
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    bucket, position = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    made = keys.select(bucket.alias("_bucket"), position.alias("_at")).groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_map"))
    found = rows.withColumn("_bucket", bucket).withColumn("_at", position).join(F.broadcast(made), "_bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.expr("int(_at div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return found.withColumn(name, hit).drop("_bucket", "_at", "_map")


def _repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The values of these columns that several rows have. Counts are added up before they are dealt out."""
    return rows.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1").select(*columns)


def _measured(docs: DataFrame, text_col: str, **more: Column) -> DataFrame:
    """(length, head) of each row and what more names."""
    text = F.col(text_col)
    return docs.select(F.coalesce(F.octet_length(text), F.lit(0)).alias("length"), F.xxhash64(folded(F.substring(text, 1, HEAD))).alias("head"), *(c.alias(n) for n, c in more.items()))


def _digested(docs: DataFrame, id_col: str, text_col: str, digests: bool, carry: tuple[str, ...]) -> DataFrame:
    """(row, doc_id, full, digest, kept_...) as a staged table; full, the whole text's digest, only where another text may be equal."""
    with staging.scope() as kept:
        seen = staging.stage(_measured(docs, text_col), "heads")
        lengths = staging.stage(_repeated(seen, ["length"]), "lengths")
        heads = staging.stage(_repeated(_marked(seen, lengths, ["length"], "_again").where("_again"), ["length", "head"]), "heads-again")
        digest = F.unhex(F.sha2(folded(F.col("_text")).cast("binary"), 256))
        names = {"doc_id": F.col(id_col).cast("long"), "_text": F.col(text_col).cast("string")} | {f"kept_{c}": F.col(c) for c in carry}
        rows = _marked(_measured(docs, text_col, **names), heads, ["length", "head"], "_again")
        full = F.when(F.col("_again"), digest)
        out = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", full.alias("full"), (digest if digests else full).alias("digest"), *(f"kept_{c}" for c in carry))
        out = staging.stage(out, "digests")
        kept.append(out)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id (of the row that stays), group_size, kept and digest (binary) of every row, and the columns to carry as kept_...

    Without digests, texts that are known to be alone have a null one: they aren't digested at all.
    """
    with staging.scope() as stay:
        rows = _digested(docs, id_col, text_col, digests, carry)
        groups = rows.where("full is not null").groupBy("full").agg(F.count("*").alias("size"), F.max(F.struct("doc_id", "row")).alias("best")).where("size > 1")
        groups = staging.stage(groups, "groups")
        stay += [rows, groups]
    heavy = F.col("size") * HEAVY >= rows.count()
    first = rows.join(F.broadcast(groups.where(heavy)), "full", "left")  # HEAVY groups at most
    rest = first.where("full is not null and size is null").drop("size", "best").join(groups.where(~heavy), "full", "left")
    out = first.where("full is null or size is not null").unionByName(rest)
    alone = F.col("size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        "digest",
        *(f"kept_{c}" for c in carry),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = classes(docs, id_col, text_col, carry=tuple(docs.columns)).where("kept")
    return found.select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the text as it is compared) of every row."""
    return classes(docs, digests=True).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
