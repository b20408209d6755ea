"""Parting two overlapping boxes: Column expressions that give both boxes' new corners.

Every function returns struct(v1, w1, v2, w2) of arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxfold.functions.membership import Columns

ALPHA = 1e-5
Corners = tuple[Column, Column, Column, Column]


def _rebuild(v1: Columns, w1: Columns, v2: Columns, w2: Columns, dim: Column, change: Callable[[Column, Column, Column, Column], Corners]) -> Column:
    sides: list[list[Column]] = [[], [], [], []]
    for j, corner in enumerate(zip(v1, w1, v2, w2)):
        for side, old, new in zip(sides, corner, change(*corner)):
            side.append(F.when(dim == j, new).otherwise(old))
    return F.struct(*[F.array(*s).alias(n) for s, n in zip(sides, ("v1", "w1", "v2", "w2"))])


def part_by_case(v1: Columns, w1: Columns, v2: Columns, w2: Columns, case: Column, dim: Column, alpha: float = ALPHA) -> Column:
    """Carry out a case of ``fmnn_case`` or ``efmnn_case``; unchanged where the case is NULL."""
    meets_high, meets_low = case.isin(1, 91), case.isin(2, 92)
    lift_tested, cut_first = case.isin(42, 3, 82), case.isin(32, 4, 72)
    lift_first, cut_tested = case.isin(31, 5, 71), case.isin(41, 6, 81)

    def change(a: Column, b: Column, c: Column, d: Column) -> Corners:
        middle_high, middle_low = (c + b) / F.lit(2.0), (d + a) / F.lit(2.0)
        return (
            F.when(meets_low, middle_low).when(lift_first, d + alpha).otherwise(a),
            F.when(meets_high, middle_high).when(cut_first, c - alpha).otherwise(b),
            F.when(meets_high, middle_high + alpha).when(lift_tested, b + alpha).otherwise(c),
            F.when(meets_low, middle_low - alpha).when(cut_tested, a - alpha).otherwise(d),
        )

    return _rebuild(v1, w1, v2, w2, F.coalesce(dim, F.lit(-1)), change)


def gfmm_case(v1: Columns, w1: Columns, v2: Columns, w2: Columns, limit: float = 2.0) -> Column:
    """struct(amount, dim, case) of the general test: the first feature that only touches, else the least overlap under the limit (infinite for features of any range)."""
    touching, partial = [], []
    for j, (a, b, c, d) in enumerate(zip(v1, w1, v2, w2)):
        right, left = d - a, b - c
        low = (a <= c) & (c < b) & (b <= d)
        high = (c <= a) & (a < d) & (d <= b)
        around, inside = (a < c) & (d < b), (c < a) & (b < d)
        open_case = low | high | around | inside
        nearer = right <= left
        case = F.when(low, 1).when(high, 2).when(around & nearer, 31).when(around, 32).when(inside & nearer, 41).when(inside, 42)
        amount = F.when(low, left).when(high, right).otherwise(F.least(left, right))
        partial.append(F.when(open_case & (amount < limit), F.struct(amount.alias("amount"), F.lit(j).alias("dim"), case.alias("case"))))
        edge = (F.when((a <= b) & (b == c) & (c < d), 5).when((a < b) & (b == c) & (c <= d), 6)
                .when((c <= d) & (d == a) & (a < b), 7).when((c < d) & (d == a) & (a <= b), 8))
        touching.append(F.when(~open_case & edge.isNotNull(), F.struct(F.lit(0.0).alias("amount"), F.lit(j).alias("dim"), edge.alias("case"))))
    least = F.least(*partial) if len(partial) > 1 else partial[0]
    return F.coalesce(*touching, least)


def part_gfmm(v1: Columns, w1: Columns, c1: Column, v2: Columns, w2: Columns, c2: Column, found: Column | None = None, alpha: float = ALPHA) -> Column:
    """Part two boxes of different classes; boxes of one class stay as they are.

    ``found``: a column with ``gfmm_case``, worth its own step in a plan as it is used in every corner."""
    found = gfmm_case(v1, w1, v2, w2) if found is None else found
    case = F.when((c1 != c2) | (c1 == -1), found["case"])

    def change(a: Column, b: Column, c: Column, d: Column) -> Corners:
        high, low = (b + c) / F.lit(2.0), (d + a) / F.lit(2.0)
        return (
            F.when(case == 2, low + alpha).when(case == 31, d + alpha).when(case == 7, F.least(a + alpha, b)).otherwise(a),
            F.when(case == 1, high).when(case == 32, c - alpha).when(case == 6, F.greatest(b - alpha, a)).otherwise(b),
            F.when(case == 1, high + alpha).when(case == 42, b + alpha).when(case == 5, F.least(c + alpha, d)).otherwise(c),
            F.when(case == 2, low).when(case == 41, a - alpha).when(case == 8, F.greatest(d - alpha, c)).otherwise(d),
        )

    return _rebuild(v1, w1, v2, w2, F.coalesce(found["dim"], F.lit(-1)), change)


def split_around(v: Columns, w: Columns, v_in: Columns, w_in: Columns, dim: Column, scale: float = 0.001) -> Column:
    """array of the one or two boxes left of (v, w) around the box inside it along ``dim``, each as struct(v, w)."""
    strictly = F.lit(False)
    for j, (a, b, c, d) in enumerate(zip(v, w, v_in, w_in)):
        strictly = F.when(dim == j, (a < c) & (d < b)).otherwise(strictly)
    box = lambda lo, hi: F.struct(F.array(*lo).alias("v"), F.array(*hi).alias("w"))
    below = box(v, [F.when(dim == j, c - scale).otherwise(b) for j, (b, c) in enumerate(zip(w, v_in))])
    above = box([F.when(dim == j, d + scale).otherwise(a) for j, (a, d) in enumerate(zip(v, w_in))], w)
    return F.when(F.coalesce(strictly, F.lit(False)), F.array(below, above)).otherwise(F.array(box(v, w)))


def replace_slots(e: Columns, f: Columns, dim: Column, low: Column, high: Column) -> Column:
    """struct(e, f) with the slots of one feature replaced where a new value is given."""
    return F.struct(F.array(*[F.when((dim == j) & low.isNotNull(), low).otherwise(a) for j, a in enumerate(e)]).alias("e"),
                    F.array(*[F.when((dim == j) & high.isNotNull(), high).otherwise(b) for j, b in enumerate(f)]).alias("f"))
