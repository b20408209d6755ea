"""Granular levels are the same folds over boxes, whatever the number of boxes."""

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from boxfold.kernels import learners as kl
from boxfold.operators import fit, granular
from boxfold.plans import catalog


def test_levels_do_not_hang_on_a_bound_of_boxes(spark, sf, duck, monkeypatch):
    """Beyond ``FOLD_BOXES`` containment and coarser levels used to be learnt cell by cell, with other results."""
    monkeypatch.setattr(granular, "FOLD_BOXES", 10)
    assert rows_of(catalog.QUERIES["fit_granular"](spark, sf).toPandas()) == rows_of(duck.execute(catalog.SQL["fit_granular"]).fetchdf())


def _boxes(n, d, seed, labels, digits=2, missing=False, points=0.3):
    r = np.random.default_rng(seed)
    v = r.random((n, d)).round(digits)
    w = v + (r.random((n, d)) * 0.2).round(digits) * (r.random((n, 1)) > points)
    if missing:
        v[::9, 0], w[::9, 0] = kl.MISSING_LOW, kl.MISSING_HIGH
    boxes = kl.Boxes(d)
    for k in range(n):
        boxes.add(v[k], w[k], r.choice(labels), float(r.integers(1, 5)), r.random(d))
    return boxes


def _frame(spark, boxes):
    pdf = fit.boxes_frame(boxes, "online").sample(frac=1, random_state=0)
    pdf["box_id"] += 1 << 33
    return spark.createDataFrame(pdf.assign(**{c: [x.tolist() for x in pdf[c]] for c in ("v", "w", "centroid")}), fit.BOX_FIELDS)


def _told(frame):
    return [(r["box_id"], list(r["v"]), list(r["w"]), r["c"], r["n_samples"], list(r["centroid"])) for r in frame.orderBy("box_id").collect()]


@pytest.mark.parametrize("n, d, labels, missing", [(400, 2, [1, 2, 3], False), (300, 1, [1, 2], False), (300, 3, [1], False), (300, 2, [1, 2, -1], True), (1, 2, [1], False), (60, 2, [4], False)])
def test_containment_in_the_jvm_is_the_fold(spark, n, d, labels, missing):
    boxes = _boxes(n, d, 1, labels, 1, missing)
    frame, kept = _frame(spark, boxes), []
    for y in np.unique(boxes.c):
        rows, own = np.flatnonzero(boxes.c == y), kl.Boxes(d)
        for k in rows:
            own.add(boxes.v[k], boxes.w[k], boxes.c[k], boxes.n[k], boxes.m[k])
        kept += [((1 << 33) + int(rows[j]) + 1, own.v[j].tolist(), own.w[j].tolist(), int(y), own.n[j], own.m[j].tolist()) for j in kl.remove_contained(own)]
    assert len(kept) < n or n < 2
    assert _told(granular.outermost_in_order(frame)) == sorted(kept)


@pytest.mark.parametrize("n, d, labels, missing, theta, gamma, digits", [
    (500, 2, [1, 2, 3], False, 0.3, 1.0, 2), (500, 2, [1, 2, 3], False, 0.3, 1.0, 6), (300, 1, [1, 2], False, 0.2, 1.0, 2), (300, 3, [1, 2], False, 0.5, [1.0, 0.5, 2.0], 2),
    (400, 2, [1, 2, -1], True, 0.4, 1.0, 2), (400, 2, [1, 2, -1], False, 0.3, 2.0, 1), (1, 2, [1], False, 0.2, 1.0, 2),
])
def test_coarser_levels_in_the_jvm_are_the_fold(spark, n, d, labels, missing, theta, gamma, digits):
    boxes = _boxes(n, d, 2, labels, digits, missing)
    fold = kl.make("coarsen", theta=theta, gamma=gamma)
    out = fold.fit(kl.Samples(boxes.v.copy(), boxes.w.copy(), boxes.c.copy(), boxes.n.copy(), None, boxes.m.copy()))
    told = _told(granular.coarsen_in_order(_frame(spark, boxes), theta, gamma))
    assert told == [(k + 1, out.v[k].tolist(), out.w[k].tolist(), int(out.c[k]), out.n[k], out.m[k].tolist()) for k in range(out.size)]


def test_no_boxes_make_no_levels(spark):
    none = _frame(spark, _boxes(1, 2, 0, [1])).limit(0)
    assert granular.outermost_in_order(none).count() == granular.coarsen_in_order(none, 0.2).count() == 0
    assert granular.fit(none.select(F.col("box_id").alias("sid"), F.col("box_id").alias("seq"), F.col("v").alias("xl"), F.col("w").alias("xu"), F.col("c").alias("y")), (0.1, 0.2), 2).count() == 0
