"""Column expressions: names, numbers, vectors, probabilities. All stay in generated code or built-in functions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Blanks that SQL's trim takes away: Unicode's space separators.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _whole(x: Column) -> Column:
    """The text of a whole double below 2**116 by its exact digits."""
    size = F.abs(x)
    high = F.floor(size / 2.0**60)
    exact = high.cast("decimal(19,0)") * F.lit(2**60).cast("decimal(19,0)") + (size - high.cast("double") * 2.0**60).cast("long").cast("decimal(38,0)")
    digits = exact.cast("string")
    ones = F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 40)).cast("decimal(38,36)")
    out = x.cast("string")
    for n in (16, 15, 14):
        fewer = F.concat(F.bround(ones, n).cast("string"), F.lit("E"), (F.length(digits) - 1).cast("string"))
        out = F.when(fewer.try_cast("double") == size, F.concat(F.when(x < 0, "-").otherwise(""), fewer)).otherwise(out)
    return out


def shortest(x: Column) -> Column:
    """A double as text of no more digits than it takes. Java before 19 writes others for some whole numbers beyond 2**53, and a float read from these is the other neighbour."""
    x = x.cast("double")
    large = (F.abs(x) >= 2.0**53) & (F.abs(x) < 2.0**116)
    # within a lambda, so that the code for the rest of the rows stays short
    return F.when(large, F.get(F.transform(F.array(x), _whole), F.lit(0))).otherwise(x.cast("string"))


def all_of(conditions) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def total(columns) -> Column:
    return functools.reduce(operator.add, columns)


def finite(column: str, numeric: bool = True) -> Column:
    """Not null and, for numbers with a fraction, neither NaN nor infinite."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) if numeric else c.isNotNull()


def safe_name(label: Column) -> Column:
    """Lower case, blanks and slashes as underscores."""
    return F.translate(F.lower(label), " /", "__")


def safe_name_of(label: str) -> str:
    return label.lower().replace(" ", "_").replace("/", "_")


def mapped(column: Column, names: dict[str, str], other: str) -> Column:
    """By a literal map, what it doesn't have is other; so is null."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(other)) if pairs else F.lit(other)


def port(column: Column, fill: bool = True) -> Column:
    """A number, rounded half to even, within 1 to 65535; what isn't one becomes 1 (or stays null)."""
    x = column.try_cast("double")
    x = F.when(F.isnan(x), None).otherwise(x)
    p = F.bround(clip(x, 1.0, 65535.0)).cast("int")
    return F.coalesce(p, F.lit(1)) if fill else p


def clip(column: Column, low, high) -> Column:
    """Within low and high; null stays null, which least and greatest alone would pass over."""
    return F.when(column.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), column)))


def clamp_decoded(column: Column) -> Column:
    """Tiny and negative values to 0, eight places."""
    return F.bround(F.when(F.abs(column) < 1e-9, 0.0).when(column < 0, 0.0).otherwise(column), 8)


def as_flag(column: Column) -> Column:
    return (column > 0.5).cast("int")


def key(*columns: str, places: int = 6) -> list[Column]:
    """Columns rounded (half to even) for use as a key."""
    return [F.bround(F.col(c).cast("double"), places).alias(c) for c in columns]


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def argmax(p: Column) -> Column:
    """Number of the first of the largest values."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def between(a: Column, b: Column, t: Column) -> Column:
    """(1 - t) a + t b for vectors."""
    return F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def euler(start: Column, velocity, steps: int) -> Column:
    """x minus velocity(x, t) / steps, steps times, for t from 1 down."""
    dt = 1.0 / steps
    return F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), start, lambda x, k: x - velocity(x, k * F.lit(dt)) * F.lit(dt))


def f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def divided(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def embedding_size(cardinality: int, most: int) -> int:
    """Dimensions of a category's embedding: half of its values, 2 at least and so many at most."""
    return min(most, max(2, cardinality // 2))
