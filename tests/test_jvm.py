"""Kernels in the JVM tell what the learners and scoring tell."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfold.kernels import jvm
from boxfold.kernels import learners as kl
from boxfold.operators import ensemble, tune


def _rows(n, d, digits, seed=0):
    r = np.random.default_rng(seed)
    x = r.random((n, d)).round(digits)
    return x, np.where(r.random(n) < 0.2, r.integers(1, 4, n), 1 + (x.sum(axis=1) > d / 2)), r.integers(0, 3, n)


@pytest.mark.parametrize("n, d, digits, theta", [(1_500, 2, 2, 0.1), (1_500, 2, 6, 0.2), (800, 1, 3, 0.05), (800, 3, 2, 0.3), (300, 2, 1, 0.0), (1, 2, 2, 0.1), (60, 2, 3, 1.0)])
def test_points_are_learnt_and_told_in_the_jvm(spark, n, d, digits, theta):
    x, y, fold = _rows(n, d, digits)
    s = kl.Samples(x, x, y)
    jvm.ensure(spark)
    rows = struct.pack("<ii", n, d) + x.tobytes() + y.astype("<i4").tobytes() + fold.astype("<i4").tobytes()
    told = spark.createDataFrame([(bytearray(rows),)], "rows binary").select(F.call_function("boxfold_fitted", "rows", F.lit(theta)).alias("b"), F.call_function("boxfold_accuracies", "rows", F.lit(f"{theta},0.15"), F.lit(3)).alias("a")).first()
    boxes = kl.make("improved", theta=theta).fit(s)
    assert [(list(b["v"]), list(b["w"]), b["c"], b["n_samples"], list(b["centroid"])) for b in told["b"]] == list(zip(boxes.v.tolist(), boxes.w.tolist(), boxes.c.tolist(), boxes.n.tolist(), boxes.m.tolist()))
    for t, accuracy in zip((theta, 0.15), told["a"]):
        shares = []
        for held in range(3):
            train, test = s.take(fold != held), s.take(fold == held)
            if len(test):
                shares.append((kl.predict(kl.make("improved", theta=t).fit(train), test, learner="improved") == test.y).mean() if len(train) else 0.0)
        assert accuracy == np.mean(shares)


def test_whole_parts_need_no_worker(spark, monkeypatch):
    """Plain parts are tuned and learnt in the JVM, other ones (a missing bound) in Python, with the same boxes as without the JVM."""
    x, y, _ = _rows(400, 2, 2, 1)
    rows = [(m, i, i, p.tolist(), [None, 0.5] if m == 2 and i == 7 else p.tolist(), int(c)) for m in (1, 2) for i, (p, c) in enumerate(zip(x, y))]
    drawn = spark.createDataFrame(rows, "member_id int, sid bigint, seq bigint, xl array<double>, xu array<double>, y int")
    told = lambda: sorted((r["member_id"], r["box_id"], str(r)) for r in tune.tuned_members(drawn, "improved", [{"theta": 0.1}, {"theta": 0.2}], k=3, part_rows=150).collect())
    asked, unpacked = [], tune._each
    monkeypatch.setattr(tune, "_each", lambda packed, *how: asked.append(sorted(map(tuple, packed.groupBy("member_id", "plain").count().collect()))) or unpacked(packed, *how))
    both = told()
    assert asked[0] == [(1, True, 3), (2, False, 1), (2, True, 2)]
    monkeypatch.setattr(tune, "_in_jvm", lambda *a: False)
    assert told() == both and ensemble._k(400, 150) == 3


def test_tuned_members_vote_without_python_folds(spark, monkeypatch):
    """``vote_tuned_members`` has only whole points: no part of it is learnt or validated by a Python worker."""
    from boxfold.plans import catalog

    kinds, each = [], tune._each
    monkeypatch.setattr(tune, "_each", lambda packed, *how: kinds.append({r[0] for r in packed.select("plain").collect()}) or each(packed, *how))
    voted = catalog.QUERIES["vote_tuned_members"](spark, "/root/testdata/sf0.001")
    assert voted.count() and kinds == [{True}, {True}]
