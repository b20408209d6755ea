"""Pruning of boxes by validation samples, and the box relations behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfold.functions.membership import elements, pair_similarity
from boxfold.functions.overlap import contains, overlaps, well_formed
from boxfold.lineage import cut
from boxfold.operators import ensemble, score


def box_confusion(validation: DataFrame, boxes: DataFrame, d: int, kind: str = "gfmm", rule: str = "manhattan", gamma=1.0, **how) -> DataFrame:
    """(box_id, right, wrong) of every box: samples attributed to it that have, or have not, its class."""
    hit = score.attribute(validation, boxes, d, kind, rule, gamma, **how).join(validation.select("sid", "y"), "sid")
    return boxes.select("box_id").join(_counts(hit, ["box_id"]), "box_id", "left").fillna(0, ["right", "wrong"])


def _counts(hit: DataFrame, keys: Sequence[str]) -> DataFrame:
    good = (F.col("c") == F.col("y")) | (F.col("y") == -1)
    return hit.groupBy(*keys).agg(F.sum(good.cast("long")).alias("right"), F.sum((~good).cast("long")).alias("wrong"))


def _marked(seen: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """``seen`` with _good, _empty and _rescued (first box of a class that has no good one)."""
    n = F.col("right") + F.col("wrong")
    marked = seen.withColumn("_good", (n > 0) & (F.col("right") / n >= threshold)).withColumn("_empty", n == 0)
    per = marked.groupBy(*keys, "c").agg(F.bool_or("_good").alias("_alive"), F.min("box_id").alias("_first"))
    return marked.join(per, [*keys, "c"]).withColumn("_rescued", ~F.col("_alive") & (F.col("box_id") == F.col("_first")))


def prune(validation: DataFrame, boxes: DataFrame, d: int, threshold: float = 0.5, keep_empty: bool = False, kind: str = "gfmm", rule: str = "manhattan", gamma=1.0, **how) -> DataFrame:
    """Boxes of which a share ``threshold`` of the attributed samples is right.

    Boxes without samples stay if asked for; else they stay only where the model without them predicts the
    validation samples worse.  A class that would lose all boxes keeps its first one."""
    marked = cut(_marked(boxes.join(box_confusion(validation, boxes, d, kind, rule, gamma, **how), "box_id"), threshold, []))
    full = marked.filter("_good OR _empty").select(*boxes.columns)
    if keep_empty:
        return full
    bare = marked.filter("_good OR _rescued").select(*boxes.columns)
    if full.isEmpty():
        return bare
    right = [score.accuracy(score.predict(validation, b, d, kind, rule, gamma, **how).join(validation.select("sid", "y"), "sid")).first()[0] or 0.0 for b in (bare, full)]
    return bare if right[0] >= right[1] else full


def prune_members(validation: DataFrame, boxes: DataFrame, d: int, threshold: float = 0.5, keep_empty: bool = False, features: DataFrame | None = None, kind: str = "gfmm", rule: str = "manhattan", gamma=1.0) -> DataFrame:
    """``prune`` of every member (``boxes`` has member_id), side by side."""
    hit = ensemble.member_predictions(validation, boxes, d, features, kind, rule, gamma, attribute=True).join(boxes.select("member_id", "box_id", "c"), ["member_id", "box_id"]).join(validation.select("sid", "y"), "sid")
    seen = boxes.join(_counts(hit, ["member_id", "box_id"]), ["member_id", "box_id"], "left").fillna(0, ["right", "wrong"])
    marked = cut(_marked(seen, threshold, ["member_id"]))
    full = marked.filter("_good OR _empty").select(*boxes.columns)
    if keep_empty:
        return full
    bare = marked.filter("_good OR _rescued").select(*boxes.columns)

    def right(b: DataFrame, name: str) -> DataFrame:
        told = ensemble.member_predictions(validation, b, d, features, kind, rule, gamma).join(validation.select("sid", "y"), "sid")
        return told.groupBy("member_id").agg(F.count_if(F.col("y") == F.col("y_pred")).alias(name))

    if full.isEmpty():
        return bare
    better = right(bare, "_bare").join(right(full, "_full"), "member_id", "full").select("member_id", (F.coalesce("_bare", F.lit(0)) >= F.coalesce("_full", F.lit(0))).alias("_less"))
    both = marked.join(better, "member_id", "left").withColumn("_less", F.coalesce("_less", F.lit(True)))
    return both.filter("_good OR (_less AND _rescued) OR (NOT _less AND _empty)").select(*boxes.columns)


def _sides(boxes: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return boxes.select(*keys, F.col("box_id").alias(f"{prefix}_id"), F.col("v").alias(f"{prefix}_v"), F.col("w").alias(f"{prefix}_w"), F.col("c").alias(f"{prefix}_c"))


def cell_width(boxes: DataFrame, reach: float = 0.0) -> float:
    """Width of grid cells: the mean edge of the boxes and their reach, so that a box spans few cells and a cell holds few boxes."""
    edge = F.aggregate(F.zip_with("v", "w", lambda a, b: b - a), F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0))) / F.size("v")
    mean = boxes.agg(F.avg(edge)).first()[0] or 0.0
    return max(2.0 * mean + reach, 1e-6)


def neighbours(boxes: DataFrame, d: int, width: float | None = None, keys: Sequence[str] = (), reach: float = 0.0) -> DataFrame:
    """Pairs of boxes that come within the reach in the first two features, each pair once per order: a_id, a_v, a_w, a_c, b_...

    An equi-join on the grid cells a box spans (``width``: by the boxes' edges unless given) replaces the comparison of all pairs;
    it loses no pair that meets or comes within the reach.  Boxes with a missing dimension meet nothing and are left out."""
    whole = boxes.filter((F.size("v") == d) & (F.size("w") == d)).filter(well_formed(elements("v", d), elements("w", d)))
    width = width or cell_width(whole, reach)
    cell = lambda x: F.floor(x / width)
    a, b = _sides(whole, "a", keys), _sides(whole, "b", keys)
    first = []
    for j in range(min(d, 2)):
        low, high = (F.get(f"a_{c}", F.lit(j)) for c in "vw")
        a = a.withColumn(f"cell{j}", F.explode(F.sequence(cell(low - reach), cell(high + reach))))
        b = b.withColumn(f"cell{j}", F.explode(F.sequence(cell(F.get("b_v", F.lit(j))), cell(F.get("b_w", F.lit(j))))))
        first.append(F.col(f"cell{j}") == F.greatest(cell(low - reach), cell(F.get("b_v", F.lit(j)))))
    cells = [f"cell{j}" for j in range(min(d, 2))]
    met = a.join(b, [*keys, *cells]).filter(F.col("a_id") != F.col("b_id"))
    for once in first:
        met = met.filter(once)
    return met.drop(*cells)


def _columns(d: int) -> tuple:
    return elements("a_v", d), elements("a_w", d), elements("b_v", d), elements("b_w", d)


def overlap_pairs(boxes: DataFrame, d: int, width: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of boxes of different classes, or with an unlabelled one, that meet."""
    rows = neighbours(boxes, d, width, keys)
    return rows.filter((F.col("a_c") != F.col("b_c")) | (F.col("a_c") == -1)).filter(overlaps(*_columns(d)))


def similar_pairs(boxes: DataFrame, d: int, least: float = 0.0, gamma: float = 1.0, measure: str = "mid", way: str = "max", keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of boxes of a similarity above ``least``, with it: their sides differ by less than (1 - least) / gamma, so the grid loses none."""
    rows = neighbours(boxes, d, None, keys, (1.0 - least) / gamma)
    return rows.withColumn("similarity", pair_similarity(*_columns(d), gamma, measure, way)).filter(F.col("similarity") > least)


def containment_pairs(boxes: DataFrame, d: int, width: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(a_id, b_id): box a lies in box b of the same class."""
    rows = neighbours(boxes, d, width, keys)
    return rows.filter((F.col("a_c") == F.col("b_c"))).filter(contains(*_columns(d)))


def uncontained(boxes: DataFrame, d: int, width: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Boxes that lie in no other box of their class; of equal boxes the first stays."""
    a_v, a_w, b_v, b_w = _columns(d)
    inside = containment_pairs(boxes, d, width, keys).filter(~contains(b_v, b_w, a_v, a_w) | (F.col("b_id") < F.col("a_id")))
    return boxes.join(inside.select(F.col("a_id").alias("box_id")).distinct(), "box_id", "left_anti")
