"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(nodes: Column) -> Column:
    """Nodes sorted and without repeats."""
    return F.array_sort(F.array_distinct(nodes))


def edge_key(nodes: Column) -> Column:
    return F.array_join(nodes.cast("array<string>"), ",")


def jaccard(common: Column, size_a: Column, size_b: Column) -> Column:
    """Similarity from counts; 0 where both sets are empty."""
    union = size_a + size_b - common
    return F.when(union <= 0, F.lit(0.0)).otherwise(common / union)


def set_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.size(F.array_intersect(a, b)).cast("double"), F.size(a), F.size(b))


def safe_ratio(value: Column, by: Column) -> Column:
    """value / by; for by <= 0 it is 0 where the value is at most 0, else infinite."""
    return F.when(by <= 0, F.when(value <= 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(value / by)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def anchor_size(size: Column, ratio: float) -> Column:
    """How many of a source's nodes stay: at least one, and at least one goes."""
    return F.least(size - 1, F.greatest(F.lit(1), F.floor(size * F.lit(ratio)).cast("int")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def row_normalized(v: Column) -> Column:
    """A vector over its sum where that is above 0."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(total > 0, F.transform(v, lambda x: x / total)).otherwise(v)


def draw(*parts: Column | str | int) -> Column:
    """A 32-bit draw named by its parts: the same for each retry, order of rows and partitioning."""
    named = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *named).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A draw in [0, 1)."""
    return draw(*parts) / F.lit(4294967296.0)


def enough_draws(want: Column, free: Column) -> Column:
    """A number of even draws that gives ``want`` distinct of ``free`` values nearly always: twice the mean, and 32 more.

    The mean is about free * ln(free / (free - want + 1)) for each value wanted; what fails is drawn anew by another attempt.
    """
    free = F.greatest(free, F.lit(1)).cast("double")
    return (2 * F.ceil(free * F.log((free + 1) / F.greatest(free - want + 1, F.lit(1.0)))) + 32).cast("int")


#: Draws beyond those wanted that are made at first.
SPARE = 2


def distinct_draws(count: Column, nodes: int | Column, tries: Column, *parts: Column | str | int, outside: Column | None = None) -> Column:
    """The first ``count`` distinct values of 0 .. nodes - 1, none of them in ``outside``, in a sequence of ``tries`` draws, in the order drawn.

    The values come in the order of the draws, so a few draws are made first, and all of them only where these hold too few values.
    """

    def found(upto: Column) -> Column:
        drawn = F.transform(F.sequence(F.lit(0), upto - 1), lambda i: draw(*parts, i) % (nodes if isinstance(nodes, Column) else F.lit(nodes)))
        return F.array_distinct(drawn) if outside is None else F.array_except(drawn, outside)

    few = F.array(found(F.least(tries, count + SPARE)))
    return F.slice(F.get(F.transform(few, lambda s: F.when(F.size(s) >= count, s).otherwise(found(tries))), F.lit(0)), F.lit(1), count)
