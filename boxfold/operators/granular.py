"""Learning at several granularities: parts side by side, merged by containment, then coarser and coarser levels."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfold.kernels import jvm
from boxfold.kernels import learners as kl
from boxfold.lineage import cut
from boxfold.operators import dictionary, ensemble, prune, score
from boxfold.operators import fit as fitting
from boxfold.operators import prepare

#: Boxes up to which containment is looked for, or a model merged, in one fold; more are worked on cell by cell.  ``fit`` has no such bound.
FOLD_BOXES = 20_000


def level_of(thetas: Sequence[float]) -> dict[float, int]:
    return {t: k for k, t in enumerate(thetas)}


def _merge_contained(pdf: pd.DataFrame) -> pd.DataFrame:
    boxes = fitting.to_boxes(pdf, "online")
    if boxes is None:
        return pdf[["box_id", "v", "w", "c", "n_samples", "centroid"]]
    kept = kl.remove_contained(boxes)
    out = fitting.boxes_frame(boxes, "online").iloc[kept]
    return out.assign(box_id=pdf.sort_values("box_id")["box_id"].to_numpy()[kept])


def _cells(boxes: DataFrame, width: float, shift: tuple[float, ...]) -> DataFrame:
    """``cell``: where a box's midpoint lies in a grid of the first features, shifted by parts of a cell."""
    at = [F.floor((F.get("v", F.lit(j)) + F.get("w", F.lit(j))) / 2 / width + s) for j, s in enumerate(shift)]
    return boxes.withColumn("cell", F.concat_ws("/", *at))


def _grid(boxes: DataFrame, d: int, edge: float) -> tuple[float, list[tuple[float, ...]]]:
    """Width of cells of about ``FOLD_BOXES`` boxes, four edges at least, and all shifts by half a cell in the first two features.

    Boxes of edges up to ``edge`` that meet have midpoints no farther apart, so with one of the shifts they share a cell."""
    n = boxes.count()
    spans = boxes.agg(*[f(F.get(c, F.lit(j))).alias(f"{c}{j}") for j in range(min(d, 2)) for f, c in ((F.min, "v"), (F.max, "w"))]).first()
    area = np.prod([max((spans[f"w{j}"] or 0.0) - (spans[f"v{j}"] or 0.0), 4 * edge) for j in range(min(d, 2))])
    width = max(4 * edge, float(area * FOLD_BOXES / (2 * max(n, 1))) ** (1 / min(d, 2)))
    return width, list(itertools.product((0.0, 0.5), repeat=min(d, 2)))


def _numbered(boxes: DataFrame) -> DataFrame:
    return dictionary.dense_ids(boxes.withColumnRenamed("box_id", "_old"), ["cell", "_old"], "_new").withColumn("box_id", F.col("_new") + 1).drop("_new", "_old", "cell")


def _width(boxes: DataFrame) -> tuple[int, float]:
    edge = F.array_max(F.zip_with("v", "w", lambda a, b: b - a))
    row = boxes.agg(F.max(F.size("v")).alias("d"), F.max(edge).alias("e")).first()
    return row["d"] or 0, max(row["e"] or 0.0, 1e-9)


def _stack(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Lists of d numbers as rows."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _holder_rows(v: np.ndarray, w: np.ndarray, hv: np.ndarray, hw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, holders near them, whether a row lies in a holder), by neighbourhoods of rows."""
    strip = np.floor((v[:, 0] + w[:, 0]) / 2 * max(1.0, np.sqrt(len(v) / 256)))
    order = np.lexsort((v[:, min(1, v.shape[1] - 1)], strip))
    for k in range(0, len(v), 256):
        rows = order[k : k + 256]
        near = np.flatnonzero((hv <= v[rows].max(axis=0)).all(axis=1) & (hw >= w[rows].min(axis=0)).all(axis=1))
        for q in range(0, len(rows), step := max(1, 2_000_000 // max(1, len(near)))):
            part = rows[q : q + step]
            held = np.ones((len(part), len(near)), bool)
            for f in range(v.shape[1]):
                held &= (hv[near, f] <= v[part, f, None]) & (hw[near, f] >= w[part, f, None])
            yield part, near, held


def _holders(df: DataFrame, holders: pa.Table, d: int) -> DataFrame:
    """(box_id, holder): of the holders of its class that another box lies in, the one with the farthest centroid, or NULL."""
    known = {}
    at, c = {x: _stack(holders[x], d) for x in ("v", "w", "centroid")}, holders["c"].to_numpy()
    for y in np.unique(c):
        own = np.flatnonzero(c == y)
        known[int(y)] = (holders["box_id"].to_numpy()[own], *(at[x][own] for x in ("v", "w", "centroid")))
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in score.gathered(batches):
            ids, c, (v, w, m) = batch["box_id"].to_numpy(), batch["c"].to_numpy(), (_stack(batch[x], d) for x in ("v", "w", "centroid"))
            out, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
            for y in np.unique(c).tolist():
                if y not in shared.value:
                    continue
                (hid, hv, hw, hm), own = shared.value[y], np.flatnonzero(c == y)
                for part, near, held in _holder_rows(v[own], w[own], hv, hw):
                    rows = own[part]
                    held &= hid[near] != ids[rows, None]
                    some = np.flatnonzero(held.any(axis=1))
                    if len(some):
                        away = sum((hm[near, f] - m[rows[some], f, None]) ** 2 for f in range(d))
                        out[rows[some]], found[rows[some]] = hid[near[np.where(held[some], away, -1.0).argmax(axis=1)]], True
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out, mask=~found)], names=["box_id", "holder"])

    return df.select("box_id", "c", "v", "w", "centroid").mapInArrow(run, "box_id bigint, holder bigint")


def _outermost(boxes: DataFrame, d: int) -> DataFrame | None:
    """Boxes in no other of their class, with the weight of those inside them; None where what can hold others is more than a block.

    Equal boxes are one (the last).  Only boxes of more than a point hold others: they go to all rows, first to find which of them lie in none,
    then for each other box to give its weight to one of these.  Which boxes are left does not hang on any order."""
    sums = [F.sum(F.col("n_samples") * F.get("centroid", F.lit(j))).alias(f"_m{j}") for j in range(d)]
    centroid = F.array(*[F.col(f"_m{j}") / F.col("n_samples") for j in range(d)])
    single = cut(boxes.groupBy("c", "v", "w").agg(F.max("box_id").alias("box_id"), F.sum("n_samples").alias("n_samples"), *sums).withColumn("centroid", centroid).select("box_id", "v", "w", "c", "n_samples", "centroid"))
    wide = single.filter(F.exists(F.zip_with("v", "w", lambda a, b: a < b), lambda x: x))
    most = score.BLOCK_CELLS // (2 * d)
    if wide.limit(most + 1).count() > most or single.filter(F.exists(F.zip_with("v", "w", lambda a, b: ~(a <= b)), lambda x: x)).limit(1).count():
        return None
    columns = ["box_id", "c", "v", "w", "centroid"]
    inner = _holders(wide.repartition(F.col("box_id")), wide.select(*columns).orderBy("box_id").toArrow(), d).filter("holder IS NOT NULL").select("box_id")
    outer = cut(wide.join(inner, "box_id", "left_anti")).select(*columns).orderBy("box_id").toArrow()
    told = single.join(_holders(single, outer, d), "box_id").withColumn("holder", F.coalesce("holder", "box_id"))
    given = told.groupBy("holder").agg(F.sum("n_samples").alias("n_samples"), *sums).withColumn("centroid", centroid)
    return single.select("box_id", "v", "w", "c").join(given, F.col("box_id") == F.col("holder")).select("box_id", "v", "w", "c", "n_samples", "centroid")


def remove_contained(boxes: DataFrame) -> DataFrame:
    """Boxes left after each box inside another of its class gave its weight to it; class by class, and over all rows side by side where boxes are many."""
    if boxes.count() > FOLD_BOXES:
        d, edge = _width(boxes)
        outer = _outermost(boxes, d)
        if outer is None:
            width, shifts = _grid(boxes, d, edge)
            for shift in shifts:
                boxes = cut(fitting.spread(_cells(boxes, width, shift), ["c", "cell"]).groupBy("c", "cell").applyInPandas(lambda pdf: _merge_contained(pdf), fitting.BOX_FIELDS))
            return boxes
        boxes = cut(outer)
        if boxes.count() > FOLD_BOXES:
            return boxes
    return fitting.spread(boxes, ["c"]).groupBy("c").applyInPandas(lambda pdf: _merge_contained(pdf), fitting.BOX_FIELDS)


def coarsen(boxes: DataFrame, theta: float, gamma=1.0, min_membership_aggregation: float = 0.5) -> DataFrame:
    """A coarser level: boxes learnt from boxes as weighted interval samples, up to edges of theta.

    Up to ``FOLD_BOXES`` boxes are one fold; more are learnt cell by cell, and then, with the grid shifted in every way, boxes that
    still meet a box of another class are parted, which only shrinks them: no two boxes of different classes meet in the end."""
    how = dict(gamma=gamma, min_membership_aggregation=min_membership_aggregation)
    if boxes.count() <= FOLD_BOXES:
        return fitting.fit(fitting.as_samples(boxes), "coarsen", theta=theta, **how)
    d, edge = _width(boxes)
    width, shifts = _grid(boxes, d, max(edge, theta))
    for k, shift in enumerate([shifts[0], *shifts]):  # learnt in the cells as they are; then parted in them and in all shifted ones
        cells = fitting.as_samples(_cells(boxes, width, shift), "cell")
        boxes = cut(_numbered(fitting.fit(cells, "coarsen", ["cell"], theta=theta if k == 0 else -1.0, **how)))
    return boxes


def merge_parts(boxes: DataFrame, theta: float, gamma=1.0) -> DataFrame:
    """One model from the models of parts: contained boxes are taken out, near ones merged up to theta, rivals parted; its size goes by the space, not by the rows."""
    return coarsen(cut(remove_contained(boxes.select("box_id", "v", "w", "c", "n_samples", "centroid"))), theta, gamma)


def merge_members(boxes: DataFrame, learner: str = "agglomerative2", theta: float = 0.2, **params) -> DataFrame:
    """One model over all members' boxes: learnt from them as weighted interval samples in one fold, or, of more than ``FOLD_BOXES``, merged cell by cell."""
    if boxes.count() <= FOLD_BOXES:
        return ensemble.merge_members(boxes, learner, FOLD_BOXES, theta=theta, **params)
    order = F.col("member_id").cast("bigint") * (1 << 40) + F.col("box_id")
    return merge_parts(boxes.withColumn("box_id", order), theta)


def first_level(samples: DataFrame, n_partitions: int, theta: float, gamma=1.0, homogeneous: bool = False) -> DataFrame:
    """Boxes of stratified parts, learnt without contraction; ``homogeneous``: class by class, the unlabelled last."""
    parts = prepare.dealt(samples, "y", n_partitions)
    if homogeneous:
        last = F.when(F.col("y") == -1, F.lit((1 << 31) - 1)).otherwise(F.col("y")).cast("bigint")
        parts = parts.withColumn("seq", last * F.lit(1 << 31) + F.col("seq"))
    boxes = fitting.fit(parts, "online", ["partition_id"], theta=theta, theta_min=theta, gamma=gamma, alpha=0.5, contract=False)
    return boxes.withColumn("box_id", F.col("partition_id").cast("bigint") * (1 << 32) + F.col("box_id"))


def _pack(t: pa.Table) -> bytes:
    """Boxes as the kernels of ``LevelBoxes.java`` read them, in order of their number."""
    t = t.take(pa.array(np.argsort(t["box_id"].to_numpy(), kind="stable")))
    flat = [t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8") for c in ("v", "w", "centroid")]
    numbers = [t[c].to_numpy().astype(kind) for c, kind in (("n_samples", "<f8"), ("c", "<i4"), ("box_id", "<i8"))]
    return b"".join([struct.pack("<ii", len(t), len(flat[0]) // len(t)), *[x.tobytes() for x in (*flat, *numbers)]])


def _folded(boxes: DataFrame, by_class: bool, function: str, *params) -> DataFrame:
    """What a fold in the JVM makes of all boxes, or of those of every class, in order of their number, however many they are."""
    jvm.ensure(boxes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = list(batches)
        t = pa.Table.from_batches(t) if t else None
        if t is None or not len(t):
            return
        groups = (t.filter(pc.equal(t["c"], y)) for y in t["c"].unique()) if by_class else [t]
        for group in groups:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(group)], pa.binary())], names=["rows"])

    plain = boxes.select("box_id", "v", "w", "c", "n_samples", "centroid")
    packed = (fitting.spread(plain, ["c"]) if by_class else plain.repartition(1)).mapInArrow(run, "rows binary")
    return packed.select(F.inline(F.call_function(function, "rows", *map(F.lit, params))))


def outermost_in_order(boxes: DataFrame) -> DataFrame:
    """As ``kernels.learners.remove_contained``, class by class, for any number of boxes: one after the other, a box in others that are left gives its weight to that with the farthest centroid."""
    return _folded(boxes, True, "boxfold_outermost")


def coarsen_in_order(boxes: DataFrame, theta: float, gamma=1.0, min_membership_aggregation: float = 0.5) -> DataFrame:
    """As ``kernels.learners.Coarsen``, for any number of boxes: one fold over all of them, in order of their number."""
    slopes = np.atleast_1d(np.asarray(gamma, float))
    least = max(min_membership_aggregation, float(1 - slopes.max() * theta))
    return _folded(boxes, False, "boxfold_coarser", float(theta), float(least), ",".join(map(repr, slopes.tolist())))


def fit(samples: DataFrame, thetas: Sequence[float] = (0.1, 0.2, 0.3), n_partitions: int = 4, gamma=1.0, min_membership_aggregation: float = 0.5, homogeneous: bool = False,
        validation: DataFrame | None = None, d: int | None = None, threshold: float = 0.5, keep_empty: bool = False) -> DataFrame:
    """Boxes of all levels, finest (level 0) first; each level is learnt from the one before.

    Containment and every coarser level are folds over all boxes in order of their number, whatever their number: no other way is taken beyond some size."""
    base = cut(outermost_in_order(cut(first_level(samples, n_partitions, thetas[0], gamma, homogeneous))))
    if validation is not None:
        base = cut(prune.prune(validation, base, d, threshold, keep_empty, rule="centroid", gamma=gamma))
    levels = [base.withColumn("level", F.lit(0))]
    for k, theta in enumerate(thetas[1:], 1):
        base = cut(coarsen_in_order(base, theta, gamma, min_membership_aggregation))
        levels.append(base.withColumn("level", F.lit(k)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def predict(samples: DataFrame, boxes: DataFrame, d: int, level: int = -1, gamma=1.0) -> DataFrame:
    """(sid, y_pred) at one level, or (-1) the majority over the levels."""
    if level >= 0:
        return score.predict(samples, boxes.filter(F.col("level") == level), d, rule="centroid", gamma=gamma).select("sid", "y_pred")
    levels = boxes.withColumn("member_id", F.col("level"))
    return ensemble.majority(ensemble.member_predictions(samples, levels, d, rule="centroid", gamma=gamma))


def memberships(samples: DataFrame, boxes: DataFrame, d: int, level: int = -1, gamma=1.0) -> DataFrame:
    """(sid, c, membership) at one level, or the mean over the levels."""
    if level >= 0:
        return score.class_memberships(samples, boxes.filter(F.col("level") == level), d, gamma=gamma).select("sid", "c", "membership")
    return ensemble.mean_memberships(samples, boxes.withColumn("member_id", F.col("level")), d, gamma=gamma)
