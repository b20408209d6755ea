"""Distances, pair codes and entropies as Column expressions over lists of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxfold.functions.membership import Columns, total

#: Marks of a missing lower and upper bound, in the unit range and in a free range; the distance when nothing is common.
MISSING_LOW, MISSING_HIGH = 1.001, -0.001
FREE_LOW, FREE_HIGH = 1e9, -1e9
NO_DISTANCE = 2147483647


def manhattan(x: Columns, y: Columns) -> Column:
    return total([F.abs(a - b) for a, b in zip(x, y)])


def midpoint(v: Columns, w: Columns) -> list[Column]:
    return [(a + b) / F.lit(2.0) for a, b in zip(v, w)]


def manhattan_present(xl: Columns, xu: Columns, v: Columns, w: Columns, low: float = MISSING_LOW, high: float = MISSING_HIGH) -> Column:
    """Between midpoints, over the features missing on neither side."""
    parts, seen = [], []
    for a, b, c, d in zip(xl, xu, v, w):
        there = (a != low) & (b != high) & (c != low) & (d != high)
        parts.append(F.when(there, F.abs((a + b) / F.lit(2.0) - (c + d) / F.lit(2.0))).otherwise(0.0))
        seen.append(F.when(there, 1).otherwise(0))
    return F.when(total(seen) == 0, float(NO_DISTANCE)).otherwise(total(parts))


def to_both_corners(x: Columns, v: Columns, w: Columns) -> Column:
    return total([F.abs(a - lo) + F.abs(a - hi) for a, lo, hi in zip(x, v, w)]) / F.lit(2.0 * len(v))


def euclidean(x: Columns, y: Columns) -> Column:
    return F.sqrt(total([(a - b) * (a - b) for a, b in zip(x, y)]))


def pair_code(a: Column, b: Column) -> Column:
    """The same for both orders: the triangular number of the greater plus the lesser."""
    hi, lo = F.greatest(a, b).cast("bigint"), F.least(a, b).cast("bigint")
    return F.expr("bigint(0)") + (hi * (hi + 1) / 2).cast("bigint") + lo


def entropy(hist: Column) -> Column:
    """Bits of a histogram."""
    counts = F.map_values(hist)
    n = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b).cast("double")
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, (c / n) * F.log2(c / n)).otherwise(0.0))


def entropy_growth(extended: Column, current: Column) -> Column:
    """Entropy of the extended histogram less that of the current one, in proportion to their sizes."""
    size = lambda h: F.aggregate(F.map_values(h), F.lit(0).cast("bigint"), lambda a, b: a + b).cast("double")
    return entropy(extended) - size(current) / size(extended) * entropy(current)
