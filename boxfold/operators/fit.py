"""Fitting boxes: one ordered fold per group, groups in parallel.

A learner looks at its samples in the order of ``seq``, so a group is one task.  Its size is checked: a group of
more than ``most_rows`` is refused, and ``partitioned`` is the way for large data - stratified parts of bounded size
are fitted side by side, and the bare union of their boxes is returned: independent models, one a part.
``granular.merge_parts`` makes one model of them, whose boxes of different classes don't meet.

``samples``: sid, seq, xl, xu, y, optionally n_samples, centroid and cat (codes, bit sets or values).
"""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxfold.kernels import learners as kl
from boxfold.kernels.geometry import EMPTY
from boxfold.operators import prepare

#: Samples of one group at most.
MOST_ROWS = 100_000

BOX_FIELDS = "box_id bigint, v array<double>, w array<double>, c int, n_samples double, centroid array<double>"
CAT_FIELDS = {"eiol": ", hist array<map<string,bigint>>", "onehot": ", bits array<bigint>", "freqcat": ", e array<int>, f array<int>"}


def to_samples(pdf: pd.DataFrame, learner: str) -> kl.Samples:
    n = len(pdf)

    def wide(c: str) -> np.ndarray:
        lists = [np.asarray(x, float) for x in pdf[c]]
        if lists and lists[0].size and all(x.shape == lists[0].shape for x in lists):
            return np.concatenate(lists).reshape(n, -1)
        return np.array(lists, float).reshape(n, -1)

    cat = None
    if learner in CAT_FIELDS:
        lists = [list(x) for x in pdf["cat"]]
        cat = np.array(lists, object).reshape(n, -1) if learner == "eiol" else np.array([[EMPTY if v is None or v != v else int(v) for v in x] for x in lists], np.int64).reshape(n, -1)
        if learner == "eiol":
            cat = np.where(pd.isna(cat), str(EMPTY), cat)
    weight = pdf["n_samples"].fillna(1).to_numpy(float) if "n_samples" in pdf else None
    centre = wide("centroid") if "centroid" in pdf and n else None
    return kl.Samples(wide("xl"), wide("xu"), pdf["y"].fillna(-1).to_numpy(np.int64), weight, cat, centre)


def to_boxes(pdf: pd.DataFrame, learner: str) -> kl.Boxes | None:
    """A model's rows as the state a fit goes on from."""
    if not len(pdf):
        return None
    pdf = pdf.sort_values("box_id", kind="stable")
    d, cats = len(pdf["v"].iloc[0]), {"eiol": "hist", "onehot": "bits", "freqcat": "e"}.get(learner)
    out = kl.Boxes(d, len(pdf[cats].iloc[0]) if cats else 0, object if learner == "eiol" else np.int64)
    for r in pdf.itertuples():
        a = b = None
        if learner == "eiol":
            a = [kl.Counter({k: int(n) for k, n in (h.items() if isinstance(h, dict) else h)}) for h in r.hist]
        elif learner == "onehot":
            a = np.asarray(r.bits, np.int64)
        elif learner == "freqcat":
            a, b = (np.array([EMPTY if x is None or x != x else int(x) for x in s], np.int64) for s in (r.e, r.f))
        out.add(np.asarray(r.v, float), np.asarray(r.w, float), r.c, r.n_samples, np.asarray(r.centroid, float), a, b)
    return out


def boxes_frame(boxes: kl.Boxes | None, learner: str) -> pd.DataFrame:
    if boxes is None:
        boxes = kl.Boxes(0)
    out = pd.DataFrame({"box_id": np.arange(1, boxes.size + 1, dtype=np.int64), "v": list(boxes.v), "w": list(boxes.w), "c": boxes.c.astype(np.int32), "n_samples": boxes.n.astype(float), "centroid": list(boxes.m)})
    if learner == "eiol":
        out["hist"] = [[{str(k): int(n) for k, n in h.items()} for h in row] for row in boxes.a]
    elif learner == "onehot":
        out["bits"] = [row.tolist() for row in boxes.a]
    elif learner == "freqcat":
        slots = lambda rows: [[None if x == EMPTY else int(x) for x in row] for row in rows]
        out["e"], out["f"] = slots(boxes.a), slots(boxes.b)
    return out


#: Groups of one task, about, where there are more of them than this many tasks.
SPREAD_TASKS, GROUPS_PER_TASK = 2_000, 16


def spread(df: DataFrame, keys: Sequence[str], groups: int | None = None) -> DataFrame:
    """Groups over tasks by their number (counted, if not told): adaptive execution goes by bytes and would run small but heavy groups in one task."""
    groups = df.select(*keys).distinct().count() if groups is None else groups
    return df.repartition(max(1, min(2 * groups, max(SPREAD_TASKS, groups // GROUPS_PER_TASK))), *keys)


def fit(samples: DataFrame, learner: str, by: Sequence[str] = (), initial: DataFrame | None = None, most_rows: int = MOST_ROWS, groups: int | None = None, **params) -> DataFrame:
    """Boxes of every group (one group if ``by`` is empty; ``groups``: how many there are, if known), numbered in order of creation.

    ``initial``: boxes (with the columns ``by``) from which each group's fit goes on."""
    keys = list(by)
    base = samples if keys else samples.withColumn("_one", F.lit(0))
    keys = keys or ["_one"]
    types = dict(base.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + BOX_FIELDS + CAT_FIELDS.get(learner, "")

    def run(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame | None = None) -> pd.DataFrame:
        if len(pdf) > most_rows:
            raise ValueError(f"{len(pdf)} samples in one fold, {most_rows} at most; fit in parts")
        order = [c for c in ("seq", "sid") if c in pdf]
        pdf = pdf.sort_values(order, kind="stable")
        fold = kl.make(learner, **params)
        fold.boxes = None if state is None else to_boxes(state, learner)
        out = boxes_frame(fold.fit(to_samples(pdf, learner)) if len(pdf) else fold.boxes, learner)
        for k, value in zip(reversed(keys), reversed(key)):
            out.insert(0, k, value)
        return out

    if initial is None:
        boxes = spread(base, keys, groups).groupBy(*keys).applyInPandas(lambda key, pdf: run(key, pdf), schema)
    else:
        state = initial if by else initial.withColumn("_one", F.lit(0))
        boxes = spread(base, keys, groups).groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(lambda key, pdf, s: run(key, pdf, s), schema)
    return boxes if by else boxes.drop("_one")


def fit_summary(samples: DataFrame, learner: str, by: Sequence[str], most_rows: int = MOST_ROWS, **params) -> DataFrame:
    """Per group: rows learnt, boxes made, passes over the rows, seconds taken."""
    keys = list(by)
    types = dict(samples.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_rows bigint, n_boxes bigint, n_passes int, seconds double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_rows:
            raise ValueError(f"{len(pdf)} samples in one fold, {most_rows} at most; fit in parts")
        pdf = pdf.sort_values([c for c in ("seq", "sid") if c in pdf], kind="stable")
        fold, began = kl.make(learner, **params), time.perf_counter()
        boxes = fold.fit(to_samples(pdf, learner))
        return pd.DataFrame([[*key, len(pdf), boxes.size, fold.passes, time.perf_counter() - began]], columns=[*keys, "n_rows", "n_boxes", "n_passes", "seconds"])

    return spread(samples, keys).groupBy(*keys).applyInPandas(run, schema)


def parts_for(samples: DataFrame, rows: int) -> int:
    return max(1, -(-samples.count() // rows))


def partitioned(samples: DataFrame, learner: str, rows: int = 5_000, **params) -> DataFrame:
    """Fit in parts of about ``rows`` samples, dealt in order with even shares of every class; boxes carry their ``partition_id``, numbers are unique over all."""
    split = prepare.dealt(samples, "y", parts_for(samples, rows))
    boxes = fit(split, learner, ["partition_id"], most_rows=max(MOST_ROWS, 4 * rows), **params)
    return boxes.withColumn("box_id", F.col("partition_id").cast("bigint") * (1 << 32) + F.col("box_id"))


def as_samples(boxes: DataFrame, *keep: str) -> DataFrame:
    """Boxes as interval samples for a further fit, with their weights and centroids, and the columns to keep."""
    return boxes.select(F.col("box_id").alias("sid"), F.col("box_id").alias("seq"), F.col("v").alias("xl"), F.col("w").alias("xu"), F.col("c").alias("y"), "n_samples", "centroid", *[c for c in ("level", "partition_id", "member_id", *keep) if c in boxes.columns])


SAMPLE_SCHEMA = T.StructType([T.StructField("sid", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("xl", T.ArrayType(T.DoubleType())), T.StructField("xu", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType())])
