"""Overlap tests between boxes as Column expressions over lists of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxfold.functions.membership import Columns, gfmm, largest, smallest


def every(conditions: Columns) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def some(conditions: Columns) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def well_formed(v: Columns, w: Columns) -> Column:
    """No missing dimension."""
    return every([a <= b for a, b in zip(v, w)])


def overlaps(v1: Columns, w1: Columns, v2: Columns, w2: Columns) -> Column:
    """Closed boxes meet in every feature; boxes with a missing dimension meet nothing."""
    return well_formed(v1, w1) & well_formed(v2, w2) & (gfmm(w1, v1, v2, w2, 1.0) == 1.0)


def overlaps_free(v1: Columns, w1: Columns, v2: Columns, w2: Columns) -> Column:
    return every([F.least(b, d) - F.greatest(a, c) >= 0 for a, b, c, d in zip(v1, w1, v2, w2)])


def contains(v_in: Columns, w_in: Columns, v: Columns, w: Columns) -> Column:
    """The first box lies in the second."""
    return gfmm(v_in, w_in, v, w, 1.0) == 1.0


def least_overlap_dim(v1: Columns, w1: Columns, v2: Columns, w2: Columns) -> Column:
    """Feature of least nonzero overlap (of least overlap if all are zero), the first of equals; NULL without overlap."""
    widths = [F.least(d - a, b - c) for a, b, c, d in zip(v1, w1, v2, w2)]
    zero = every([x == 0 for x in widths])
    at = F.least(*[F.struct(F.when(zero | (x != 0), x).otherwise(float("inf")).alias("x"), F.lit(j).alias("j")) for j, x in enumerate(widths)]) if len(widths) > 1 else F.struct(widths[0].alias("x"), F.lit(0).alias("j"))
    return F.when(well_formed(v1, w1) & overlaps_free(v1, w1, v2, w2), at["j"])


def _pick(candidates: list[tuple[Column, Column, Column]]) -> Column:
    """struct(amount, dim, case) of the least amount under 2, the first of equals; NULL if there is none."""
    rows = [F.when(ok & (amount < 2), F.struct(amount.alias("amount"), F.lit(j).alias("dim"), case.alias("case"))) for j, (ok, amount, case) in enumerate(candidates)]
    return F.least(*rows) if len(rows) > 1 else rows[0]


def fmnn_case(v1: Columns, w1: Columns, v2: Columns, w2: Columns) -> Column:
    """Case and feature by which the extended box (1) and the tested box (2) are to be parted, as struct(amount, dim, case)."""
    found, all_ok = [], []
    for a, b, c, d in zip(v1, w1, v2, w2):
        over, past, right, left = b > d, a > c, d - a, b - c
        crosses_low, crosses_high = ~over & ~past & (left > 0), over & past & (right > 0)
        around, inside = over & ~past, ~over & past
        nearer = right < left
        case = F.when(crosses_low, 1).when(crosses_high, 2).when(around & nearer, 31).when(around, 32).when(inside & nearer, 41).when(inside, 42)
        amount = F.when(crosses_low, left).when(crosses_high, right).otherwise(F.least(left, right))
        ok = crosses_low | crosses_high | around | inside
        found.append((ok, amount, case))
        all_ok.append(ok)
    return F.when(well_formed(v1, w1) & well_formed(v2, w2) & every(all_ok), _pick(found))


def efmnn_case(v1: Columns, w1: Columns, v2: Columns, w2: Columns, x: Columns) -> Column:
    """Like ``fmnn_case`` with cases of equal edges; equal boxes are parted on the side of the sample ``x``.

    Both pairs of corners compare to -1, 0 or 1, and the two comparisons tell the case."""
    found, all_ok = [], []
    for a, b, c, d, s in zip(v1, w1, v2, w2, x):
        right, left = d - a, b - c
        low, high = F.signum(a - c), F.signum(b - d)
        case = (F.when((low == 0) & (high == 0), F.when(b == s, 91).otherwise(92))
                .when((low == 0) & (high < 0) & (left > 0), 3).when((high == 0) & (low < 0) & (left > 0), 4)
                .when((low == 0) & (high > 0) & (right > 0), 5).when((high == 0) & (low > 0) & (right > 0), 6)
                .when((low < 0) & (high < 0) & (left > 0), 1).when((low > 0) & (high > 0) & (right > 0), 2)
                .when((low <= 0) & (high > 0), F.when(right < left, 71).otherwise(72))
                .when((low > 0) & (high <= 0), F.when(right < left, 81).otherwise(82)))
        amount = F.when((low < 0) & (high < 0), left).when((low > 0) & (high > 0) | (low == 0) & (high == 0), right).otherwise(F.least(left, right))
        found.append((case.isNotNull(), amount, case))
        all_ok.append(~((low < 0) & (high <= 0) & (left <= 0) | (low <= 0) & (high < 0) & (left <= 0) | (low > 0) & (high > 0) & (right <= 0)))
    return F.when(every(all_ok), _pick(found))


def categorical_overlap(e1: Columns, f1: Columns, e2: Columns, f2: Columns) -> Column:
    """Some slot is shared in every feature; an empty slot (NULL) equals an empty slot, but two boxes of one value each must share it."""
    tests = []
    for a, b, c, d in zip(e1, f1, e2, f2):
        shared = a.eqNullSafe(c) | a.eqNullSafe(d) | b.eqNullSafe(c) | b.eqNullSafe(d)
        single = ~a.eqNullSafe(c) & b.isNull() & d.isNull()
        tests.append(shared & ~single)
    return every(tests)


def histogram_overlap(h1: Columns, n1: Column, h2: Columns, n2: Column) -> Column:
    """In every feature some value has the same share of the boxes' samples."""
    def feature(a: Column, b: Column) -> Column:
        return F.exists(F.map_keys(a), lambda k: F.coalesce(F.try_element_at(a, k).cast("double") / n1 == F.try_element_at(b, k).cast("double") / n2, F.lit(False)))

    return every([feature(a, b) for a, b in zip(h1, h2)])


def extent(v: Columns, w: Columns) -> Column:
    """Longest edge."""
    return largest([b - a for a, b in zip(v, w)])


def shortest(v: Columns, w: Columns) -> Column:
    return smallest([b - a for a, b in zip(v, w)])
