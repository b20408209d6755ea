"""Data editing: samples that models fitted on other samples keep getting wrong are taken out."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfold.kernels import geometry as geo
from boxfold.kernels import learners as kl
from boxfold.lineage import cut
from boxfold.operators import dictionary
from boxfold.operators import fit as fitting


def _halves(samples: DataFrame, n_iters: int, learner: str, seed: int, params: dict, most_rows: int, by: str | None) -> DataFrame:
    """(sid, iter, right): in every iteration each half (of a part ``by``, or of all) is predicted by a model of the other; iterations and parts run side by side."""
    keys = [*([by] if by else []), "iter"]
    spread = samples.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_iters - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_rows:
            raise ValueError(f"{len(pdf)} samples in one fold, {most_rows} at most; edit in parts")
        pdf = pdf.sort_values(["seq", "sid"], kind="stable").reset_index(drop=True)
        order = np.random.default_rng([seed, *[int(x) for x in reversed(key)]]).permutation(len(pdf))
        right = np.ones(len(pdf), bool)
        sides = order[: len(pdf) // 2], order[len(pdf) // 2 :]
        for train, test in (sides, sides[::-1]):
            if len(train) and len(test):
                boxes = kl.make(learner, **params).fit(fitting.to_samples(pdf.iloc[train], learner))
                s = fitting.to_samples(pdf.iloc[test], learner).marked()
                right[test] = kl.predict(boxes, s, params.get("gamma", 1.0), learner) == s.y
        return pd.DataFrame({"sid": pdf["sid"], "iter": key[-1], "right": right})

    return fitting.spread(spread, keys).groupBy(*keys).applyInPandas(run, "sid bigint, iter int, right boolean")


def two_fold(samples: DataFrame, learner: str = "online", n_iters: int = 100, n_last_iters: int = 5, seed: int = 0, by: str | None = None, most_rows: int = fitting.MOST_ROWS, **params) -> DataFrame:
    """Samples never got wrong, in the iterations up to the one that completes ``n_last_iters`` clean ones; an iteration is clean if it is in all parts ``by`` (numbers)."""
    params = params or {"theta": 0.1}
    runs = cut(_halves(samples, n_iters, learner, seed, params, most_rows, by))  # read twice below, learnt once
    clean = runs.groupBy("iter").agg(F.min("right").alias("clean"))  # one row per iteration
    flags = [r["clean"] for r in clean.orderBy("iter").collect()]
    last, held = n_iters, 0
    for k, ok in enumerate(flags):
        held += ok
        if held >= n_last_iters:
            last = k + 1
            break
    wrong = runs.filter((F.col("iter") < last) & ~F.col("right")).select("sid").distinct()
    return samples.join(wrong, "sid", "left_anti")


def two_fold_probability(samples: DataFrame, learner: str = "online", n_iters: int = 100, min_remained_prob: float = 0.5, seed: int = 0, by: str | None = None, most_rows: int = fitting.MOST_ROWS, **params) -> DataFrame:
    """Samples got right in a share ``min_remained_prob`` of the iterations."""
    if not 0 <= min_remained_prob <= 1:
        raise ValueError("min_remained_prob must be in [0, 1]")
    runs = _halves(samples, n_iters, learner, seed, params or {"theta": 0.1}, most_rows, by)
    kept = runs.groupBy("sid").agg(F.avg(F.col("right").cast("double")).alias("p")).filter(F.col("p") >= min_remained_prob)
    return samples.join(kept.select("sid"), "sid", "left_semi")


def local_parts(samples: DataFrame, rows: int, rim: int, d: int) -> DataFrame:
    """Parts of ``rows`` neighbours in Z order of the unit square, each with ``rim`` rows before and after it: ``part``, and ``own`` for the rows that belong to it.

    ``samples`` are whole and scaled to [0, 1]; ``rim`` is at most ``rows``."""
    if not 0 <= rim <= rows:
        raise ValueError("rim must be in [0, rows]")
    z = F.lit(0).cast("bigint")
    for f in range(d):
        x = F.floor((F.get("xl", F.lit(f)) + F.get("xu", F.lit(f))) / 2 * 65535)
        for bit in range(min(16, 62 // d)):
            z = z + F.shiftleft(F.shiftright(x, 15 - bit).bitwiseAND(F.lit(1)), (min(16, 62 // d) - 1 - bit) * d + f)
    placed = dictionary.dense_ids(samples.withColumn("_z", z), ["_z", "sid"], "_place")
    part = lambda p: F.floor(p / rows).cast("bigint")
    reached = F.array_distinct(F.array(part(F.col("_place")), part(F.greatest(F.lit(0), F.col("_place") - rim)), part(F.col("_place") + rim)))
    copies = placed.withColumn("part", F.explode(reached)).withColumn("own", F.col("part") == part(F.col("_place")))
    return copies.drop("_z", "_place")


def leave_one_out(samples: DataFrame, learner: str = "online", k_neighbors: int = 5, n_iters: int = 100, n_last_iters: int = 5, seed: int = 0, by: str | None = None, own: str | None = None, most_rows: int = 500, **params) -> DataFrame:
    """Samples that the k boxes nearest to them, learnt without them, vote for.

    A sweep fits once per sample, so groups (``by``, or all as one) are small by contract: ``most_rows``.
    ``own``: rows of a group where it is false are learnt from but not judged there (``local_parts``)."""
    params = params or {"theta": 0.1}
    key = by or "_one"
    base = samples if by else samples.withColumn(key, F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_rows:
            raise ValueError(f"{len(pdf)} samples to leave out one by one, {most_rows} at most; edit in parts")
        rng, clean = np.random.default_rng(seed), 0
        pdf = pdf.sort_values(["seq", "sid"], kind="stable")
        for _ in range(n_iters):
            pdf = pdf.iloc[rng.permutation(len(pdf))]
            keep = np.ones(len(pdf), bool)
            for i in range(len(pdf)):
                if own and not pdf[own].iloc[i]:
                    continue
                keep[i] = False
                if not keep.any():
                    break
                boxes = kl.make(learner, **params).fit(fitting.to_samples(pdf[keep], learner))
                s = fitting.to_samples(pdf.iloc[[i]], learner).marked()
                near = kl.ranked(geo.gfmm(s.xl[0], s.xu[0], boxes.v, boxes.w, np.asarray(params.get("gamma", 1.0), float)))[:k_neighbors]
                votes = Counter(boxes.c[near].tolist())
                keep[i] = min(votes, key=lambda c: (-votes[c], c)) == s.y[0]
            pdf = pdf[keep]
            clean = clean + 1 if keep.all() else 0
            if clean >= n_last_iters or len(keep) <= 1:
                break
        return pdf.loc[pdf[own], ["sid"]] if own else pdf[["sid"]]

    if own:
        samples = samples.filter(own)
    return samples.join(fitting.spread(base, [key]).groupBy(key).applyInPandas(run, "sid bigint"), "sid", "left_semi")
