"""Samples that match target proportions of a category.

Categories are counted; quotas are whole numbers by largest remainder, with minimum floors and capped by what is
there; of each category the records with the smallest random keys are drawn, and the report sets what was drawn
against what was wanted.  The distinct (record, category) pairs are made once; all later passes over them are
map-only.  The smallest keys are found without sorting a category in one task: bins of about ``EDGE_ROWS`` keys, as
many as the quota needs, are counted; the bins below the one in which the quota ends are taken whole where they
stand, and only that one is shuffled and ranked.

Defined results: a record is a distinct id; rows without id or category are no candidates; a target category that
no record has comes out as a shortfall of its whole want; equal keys fall back to the id; an empty table draws nothing.
"""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxfold.lineage import cut

#: Keys of one bin, about.
EDGE_ROWS = 4096
#: Target categories that are broadcast at most; more are joined by shuffle.
BROADCAST_TARGETS = 10_000


def allocate(shares: list[float], floors: list[int], available: list[int], size: int) -> list[int]:
    """Whole quotas: in proportion to the shares, never under a floor or over what is there, together ``size`` if that can be.

    Categories at a bound are fixed there and the rest is shared out among the others; remainders go to the largest
    fractions first, of equal ones to the earlier category."""
    share = [Decimal(repr(float(s))) if s == s else Decimal(0) for s in shares]
    total = sum(share) or Decimal(1)
    want = [s * size / total if total > 1 else s * size for s in share]
    goal = min(sum(want, Decimal(0)), Decimal(sum(available)))
    fixed: dict[int, int] = {}
    while True:
        free = [k for k in range(len(want)) if k not in fixed]
        left = max(Decimal(0), goal - sum(fixed.values()))
        weight = sum((share[k] for k in free), Decimal(0))
        ideal = {k: (left * share[k] / weight if weight else Decimal(0)) for k in free}
        capped = {k: available[k] for k in free if ideal[k] > available[k]}
        raised = {k: min(floors[k], available[k]) for k in free if ideal[k] < floors[k]}
        over = sum((ideal[k] - v for k, v in capped.items()), Decimal(0))
        under = sum((v - ideal[k] for k, v in raised.items()), Decimal(0))
        step = capped if capped and over >= under else raised or capped
        if not step:
            break
        fixed |= step
    quota = {k: int(ideal[k].to_integral_value(ROUND_FLOOR)) for k in free} | fixed
    rest = int(goal.to_integral_value(ROUND_FLOOR)) - sum(quota.values())
    for k in sorted(free, key=lambda k: (quota[k] - ideal[k], k)):
        if rest > 0 and quota[k] < available[k]:
            quota[k], rest = quota[k] + 1, rest - 1
    return [quota[k] for k in range(len(want))]


def candidates(table: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """(record, field, category): every record once with each of its values, as text; checkpointed."""
    sides = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("category")) for f in fields])
    rows = table.select(F.col(f"`{record}`").alias("record"), F.explode(sides).alias("s")).select("record", "s.field", "s.category")
    return cut(rows.filter("record IS NOT NULL AND category IS NOT NULL").distinct())


def category_counts(found: DataFrame) -> DataFrame:
    """(field, category, available) of ``candidates``."""
    return found.groupBy("field", "category").agg(F.count(F.lit(1)).alias("available"))


_PLAN = "target_id int, field string, category string, wanted bigint, available bigint, quota bigint"


def _plan_target(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("category", kind="stable")
    size = int(pdf["sample_size"].max())
    pdf["quota"] = allocate(pdf["target_share"].tolist(), pdf["min_rows"].tolist(), pdf["available"].tolist(), size)
    return pdf[["target_id", "field", "category", "wanted", "available", "quota"]]


def plan_quotas(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target and category: wanted (share of the size, at least the minimum), available, quota."""
    wanted = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), F.round(F.col("sample_size") * F.col("target_share").cast("decimal(20,10)"), 0).cast("bigint"))
    rows = targets.select("target_id", "field", "category", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), "sample_size", wanted.alias("wanted"))
    rows = rows.join(counts, ["field", "category"], "left").fillna(0, ["available", "wanted"])
    return cut(rows.groupBy("target_id").applyInPandas(_plan_target, _PLAN))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS else df


def draw(found: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(target_id, category, record): of each category the ``quota`` records of ``candidates`` with the smallest keys."""
    quota = F.col("quota").cast("double")
    upto = F.least(F.lit(1.0), (quota + 6 * F.sqrt(quota) + 8) / F.col("available")) * float(1 << 63)  # hardly ever over it; then the last bin is ranked
    quotas = plan.filter("quota > 0").select("target_id", "field", "category", "quota", F.ceil(quota / EDGE_ROWS).alias("bins"), upto.alias("upto"))
    keyed = found.join(_few(quotas), ["field", "category"]).withColumn("key", F.shiftrightunsigned(F.xxhash64("record", "target_id", F.lit(seed)), 1))
    keyed = keyed.select("target_id", "category", "record", "quota", "key", F.least("bins", F.floor(F.col("key") / F.col("upto") * F.col("bins"))).alias("bin"))
    group = ["target_id", "category"]
    counts = keyed.groupBy(*group, "quota", "bin").agg(F.count(F.lit(1)).alias("n"))
    sums = F.sum("n").over(Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = counts.withColumn("sums", sums).filter("sums >= quota AND sums - n < quota").select(*group, F.col("bin").alias("last"), (F.col("quota") - F.col("sums") + F.col("n")).alias("room"), (F.col("sums") == F.col("quota")).alias("full"))
    near = keyed.join(_few(cut(ends)), group).filter("bin <= last")
    whole = near.filter("bin < last OR full").select(*group, "record")
    ranked = near.filter("bin = last AND NOT full").withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("key", "record"))).filter("k <= room")
    return whole.unionByName(ranked.select(*group, "record"))


def report(plan: DataFrame, drawn: DataFrame) -> DataFrame:
    """The plan with ``drawn``, ``shortfall`` (wanted less drawn) and its ``cause``: ``available`` where too few records have the value, ``size`` where the sample's size leaves no room."""
    counts = drawn.groupBy("target_id", "category").agg(F.count(F.lit(1)).alias("drawn"))
    short = F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0))
    cause = F.when(F.col("shortfall") > 0, F.when(F.col("available") < F.col("wanted"), "available").otherwise("size"))
    return plan.join(counts, ["target_id", "category"], "left").fillna(0, ["drawn"]).withColumn("shortfall", short).withColumn("cause", cause)


def shortfalls(told: DataFrame) -> DataFrame:
    """Rows of ``report`` that cannot be met by what there is."""
    return told.filter("cause = 'available'")
