"""Fuzzy memberships as Column expressions.

Samples and boxes are given feature by feature, as equally long lists of columns, so that every expression stays
inside whole-stage code generation.  ``elements`` turns an array column of known length into such a list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Columns = Sequence[Column]
Gain = float | Sequence[float]


def elements(array: Column | str, n: int) -> list[Column]:
    a = F.col(array) if isinstance(array, str) else array
    return [F.get(a, F.lit(j)) for j in range(n)]


def _gains(g: Gain, n: int) -> list[float]:
    return [float(x) for x in g] if isinstance(g, Sequence) else [float(g)] * n


def smallest(columns: Columns) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def largest(columns: Columns) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def total(columns: Columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def ordered(v: Columns, w: Columns) -> tuple[list[Column], list[Column]]:
    """Corners put in order; a missing dimension (v > w) then spans its two marks."""
    return [F.least(a, b) for a, b in zip(v, w)], [F.greatest(a, b) for a, b in zip(v, w)]


def ramp(z: Column, g: float = 1.0) -> Column:
    """0 below 0, 1 above 1, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), z * F.lit(g)))


def gfmm(xl: Columns, xu: Columns, v: Columns, w: Columns, g: Gain = 1.0) -> Column:
    """Least fulfilled side over all features."""
    sides = [F.lit(1.0) - ramp(d, gain) for a, b, lo, hi, gain in zip(xl, xu, v, w, _gains(g, len(v))) for d in (b - hi, lo - a)]
    return smallest(sides)


def free_range(xl: Columns, xu: Columns, v: Columns, w: Columns, g: Gain = 1.0) -> Column:
    """Like ``gfmm``, violations in units of the box's own edges, the gain divides."""
    sides = [F.lit(1.0) - ramp(d / (hi - lo + F.lit(1.0)), 1.0 / gain) for a, b, lo, hi, gain in zip(xl, xu, v, w, _gains(g, len(v))) for d in (b - hi, lo - a)]
    return smallest(sides)


def capped_slope(z: Column, g: float = 1.0) -> Column:
    """The gain stays outside the cap, unlike in ``ramp``."""
    return F.lit(g) * F.least(F.lit(1.0), z)


def fmnn(x: Columns, v: Columns, w: Columns, g: Gain = 1.0) -> Column:
    """Mean over both sides of all features."""
    zero, one = F.lit(0.0), F.lit(1.0)
    soft = lambda d, gain: F.greatest(zero, one - F.greatest(zero, capped_slope(d, gain)))
    return total([soft(a - hi, gain) + soft(lo - a, gain) for a, lo, hi, gain in zip(x, v, w, _gains(g, len(v)))]) / F.lit(2.0 * len(v))


def asymmetric(xl: Columns, xu: Columns, v: Columns, w: Columns, g: Gain = 1.0, way: str = "max") -> Column:
    """Greater ("max") or lesser ("min") of the two memberships of one box in the other."""
    pair = gfmm(xl, xu, v, w, g), gfmm(v, w, xl, xu, g)
    return F.greatest(*pair) if way == "max" else F.least(*pair)


def pair_similarity(v1: Columns, w1: Columns, v2: Columns, w2: Columns, g: Gain = 1.0, measure: str = "mid", way: str = "max") -> Column:
    """Similarity of two boxes: over the gap ("short"), over the farthest corners ("long"), or of membership ("mid")."""
    if measure == "short":
        return gfmm(w1, v1, v2, w2, g)
    if measure == "long":
        return gfmm(v1, w1, w2, v2, g)
    return asymmetric(v1, w1, v2, w2, g, way)


def shares_bits(x: Columns, d: Columns) -> Column:
    """Share of the categorical features of which some value is in both bit sets."""
    return total([F.when(a.bitwiseAND(b) != 0, 1.0).otherwise(0.0) for a, b in zip(x, d)]) / F.lit(float(len(d)))


def bit_features(d: Columns) -> Column:
    """How many features hold any value."""
    return total([F.when(b != 0, 1).otherwise(0) for b in d])


def onehot(numeric: Column | None, categorical: Column | None) -> Column:
    if numeric is None or categorical is None:
        return categorical if numeric is None else numeric
    return (numeric + categorical) / F.lit(2.0)


def slot_fit(low: Columns, high: Columns, e: Columns, f: Columns) -> Column:
    """Membership of two-slot categorical boxes from the distances to each slot (0 where the table has none).

    A slot wholly unlike the value counts as fitting if the other slot is filled and fits not at all."""
    fits = []
    for lo, hi, a, b in zip(low, high, e, f):
        fit_low, fit_high = F.lit(1.0) - F.coalesce(lo, F.lit(0.0)), F.lit(1.0) - F.coalesce(hi, F.lit(0.0))
        fit_high = F.when((fit_low == 1.0) & a.isNotNull(), 1.0).otherwise(fit_high)
        fit_low = F.when((fit_high == 1.0) & b.isNotNull(), 1.0).otherwise(fit_low)
        fits.append(F.least(fit_low, fit_high))
    return smallest(fits)


def freq_cat(numeric: Column | None, categorical: Column | None) -> Column:
    if numeric is None or categorical is None:
        return categorical if numeric is None else numeric
    return F.least(numeric, categorical)


def histogram_fit(x: Columns, hist: Columns) -> Column:
    """Mean share of the value in each feature's histogram; all shares are of the first feature's total."""
    n = F.aggregate(F.map_values(hist[0]), F.lit(0).cast("bigint"), lambda a, b: a + b).cast("double")
    return total([F.coalesce(F.try_element_at(h, a), F.lit(0)).cast("double") / n for a, h in zip(x, hist)]) / F.lit(float(len(hist)))


def mixed(numeric: Column | None, categorical: Column | None, alpha: float = 0.5) -> Column:
    if numeric is None or categorical is None:
        return categorical if numeric is None else numeric
    return F.lit(alpha) * numeric + F.lit(1.0 - alpha) * categorical
