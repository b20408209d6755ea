"""Ensembles over many rows: drawn without a sort of every copy, voted where the samples are, tuned inside their parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfold.kernels import learners as kl
from boxfold.kernels import scoring
from boxfold.operators import ensemble, fit, prepare, score, tune


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(3)
    x = r.random((600, 2)).round(2)
    rows = [(i, i, p.tolist(), p.tolist(), int(p.sum() > 1) + 1) for i, p in enumerate(np.vstack([x, x[:200]]))]
    return spark.createDataFrame(rows, "sid bigint, seq bigint, xl array<double>, xu array<double>, y int").cache()


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame([(0, [0]), (1, [0, 1]), (2, [1])], "member_id int, features array<int>")


def test_draws_are_the_least_ranks(samples, members, monkeypatch):
    monkeypatch.setattr(prepare, "BIN_ROWS", 16)
    copies = prepare.per_member(samples, members)
    keys = lambda df: sorted(map(tuple, df.select("member_id", "sid").collect()))
    by_rank = prepare._ranked(copies, ["member_id", "y"], "sid", 0).filter(F.col("_rank") <= F.floor(F.col("_size") * 0.3 + 0.5))
    assert keys(prepare.draw_stratified(copies, "sid", "y", 0.3)) == keys(by_rank)
    by_rank = prepare._ranked(copies, ["member_id"], "sid", 0).filter(F.col("_rank") <= F.floor(F.col("_size") * 0.3))
    assert keys(prepare.draw_rate(copies, "sid", 0.3)) == keys(by_rank)
    plan = prepare.draw_rate(copies, "sid", 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan  # whole bins pass by the sort


def test_votes_are_counted_in_place(samples, members, monkeypatch):
    boxes = ensemble.random_boxes(samples, members, "improved", 0.5, theta=0.1).cache()
    slow = sorted(map(tuple, ensemble.majority(ensemble.member_predictions(samples, boxes, 2, members)).collect()))
    most = boxes.groupBy("member_id").count().agg(F.max("count")).first()[0]
    monkeypatch.setattr(score, "BLOCK_CELLS", 4 * most)  # several passes
    assert sorted(map(tuple, ensemble.vote(samples, boxes, 2, members).select("sid", "y_pred").collect())) == slow


def test_equal_samples_are_asked_once(monkeypatch):
    seen, ask = [], scoring.winners
    monkeypatch.setattr(scoring, "winners", lambda m, xl, xu: seen.append(len(xl)) or ask(m, xl, xu))
    v = np.array([[0.0], [0.6]])
    model = scoring.Model(np.array([1, 2]), v, v + 0.2, np.array([1, 2]), np.ones(2), v + 0.1)
    x = np.array([[0.1], [0.7], [0.1], [-0.0], [0.0]])
    assert ensemble._once(model, x, x).tolist() == [1, 2, 1, 1, 1] and seen == [3]


def test_tuned_members_learn_their_parts_where_they_lie(spark, samples, members):
    """As worked out part by part by hand, with one row a part to read again."""
    import pandas as pd

    drawn = ensemble.draw(samples, members.select("member_id"), 0.5).cache()
    candidates = [{"theta": 0.4}, {"theta": 0.1}, {"theta": 0.01}]
    parts, shares, fits = ensemble.in_parts(drawn, 150).toPandas(), [], {}
    assert tune._packed(ensemble.in_parts(drawn, 150), ["member_id", "partition_id"], 3, 0, 1_000, 9).count() == 9
    for (m, p), pdf in parts.groupby(["member_id", "partition_id"]):
        pdf = pdf.sort_values("seq")
        s, fold = fit.to_samples(pdf, "improved"), tune._folds(pdf["sid"].to_numpy(), pdf["y"].to_numpy(), 3, 0)
        for y in (1, 2):
            n = np.bincount(fold[s.y == y], minlength=3)
            assert n.max() - n.min() <= 1
        for c, params in enumerate(candidates):
            right = [np.mean(kl.predict(kl.make("improved", **params).fit(s.take(fold != h)), s.take(fold == h), learner="improved") == s.y[fold == h]) for h in range(3)]
            shares.append((m, c, np.mean(right)))
            fits[m, p, c] = kl.make("improved", **params).fit(s)
    best = pd.DataFrame(shares, columns=["m", "c", "a"]).groupby(["m", "c"])["a"].mean().unstack().idxmax(axis=1)
    told = {(r["member_id"], r["box_id"]): (list(r["v"]), list(r["w"]), r["c"], r["n_samples"], list(r["centroid"])) for r in tune.tuned_members(drawn, "improved", candidates, k=3, part_rows=150).collect()}
    by_hand = {(m, p * ensemble.PART_IDS + j + 1): (b.v[j].tolist(), b.w[j].tolist(), b.c[j], b.n[j], b.m[j].tolist()) for (m, p, c), b in fits.items() if best[m] == c for j in range(b.size)}
    assert told == by_hand and len(set(best)) >= 1


def test_a_sample_in_a_rival_is_not_placed(monkeypatch):
    r = np.random.default_rng(5)
    x, y = r.random((1_500, 2)).round(3), r.integers(1, 3, 1_500)
    calls, place = [], kl.Learner._place
    monkeypatch.setattr(kl.Learner, "_place", lambda *a: calls.append(1) or place(*a))
    told = kl.make("improved", theta=0.2).fit(kl.Samples(x, x, y))
    barely = kl.make("improved", theta=0.2)
    barely.bounds_only = True
    same = barely.fit(kl.Samples(x, x, y))
    step = kl.make("improved", theta=0.2)
    step.begin(s := kl.Samples(x, x, y))
    for i in range(len(s)):
        step.learn(s, i)
    assert all((getattr(told, c) == getattr(step.boxes, c)).all() for c in "vwcnm") and all((getattr(told, c) == getattr(same, c)).all() for c in "vwc")
    assert len(calls) < 2 * told.size  # two fits, in each of which every new box used to take a search


def test_tuned_members_vote_in_one_row_a_sample_and_class(spark, monkeypatch):
    """``vote_tuned_members`` sends counts, not a vote per member."""
    from boxfold.plans import catalog

    seen, count = [], ensemble._count
    monkeypatch.setattr(ensemble, "_count", lambda *a: seen.append(count(*a)) or seen[-1])
    voted = catalog.QUERIES["vote_tuned_members"](spark, "/root/testdata/sf0.001")
    n = voted.count()
    assert n and sum(df.count() for df in seen) <= 3 * n  # classes; there are 20 members
