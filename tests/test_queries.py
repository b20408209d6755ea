"""Every query that has SQL gives the same rows in both engines."""

import pytest
from conftest import rows_of

from boxfold.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_twin(spark, sf, duck, name):
    ours = catalog.QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(catalog.SQL[name]).fetchdf()
    assert rows_of(ours) == rows_of(theirs)
    assert len(ours)


@pytest.mark.parametrize("name", ["fit_agglo_sm", "fit_online_gfmm_passes", "fit_eiol", "fit_onehot", "fit_freqcat", "fit_granular", "fit_granular_pruned", "fit_merged", "tune_members", "merge_tuned_members"])
def test_model_queries_give_boxes(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows
    if "v" in rows[0].asDict():
        assert all(len(r["v"]) == len(r["w"]) == 2 for r in rows)


@pytest.mark.parametrize("name", ["vote_tuned_members", "tune_random_boxes", "fit_random_boxes"])
def test_votes_of_members(spark, sf, name):
    """Every whole sample gets one class, most of them their own."""
    from boxfold.plans import inputs

    s = inputs.whole_samples(spark, sf)
    both = catalog.QUERIES[name](spark, sf).join(s, "sid").selectExpr("count(*) n", "avg(int(y = y_pred)) a").first()
    assert both["n"] == s.count() and both["a"] > 0.6


@pytest.mark.parametrize("name", ["tune_random_search", "tune_ensemble", "tune_mixed"])
def test_searches_score_every_candidate(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert len(rows) > 1 and all(0 < r["accuracy"] <= 1 and r["folds"] > 0 for r in rows)


@pytest.mark.parametrize("name, fitted", [("fit_bagging_vote", "bag"), ("fit_random_boxes", "random_boxes"), ("fit_model_merge", "bag")])
def test_members_learn_half_of_the_rows(spark, monkeypatch, name, fitted):
    """Also of more rows than 2,000, of which a fixed number used to be drawn."""
    from boxfold.operators import ensemble

    seen, run = [], getattr(ensemble, fitted)
    monkeypatch.setattr(ensemble, fitted, lambda s, m, learner, share=None, **how: seen.append(share) or run(s.limit(50), m, learner, share, **how))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert seen == [0.5]


def test_fold_queries_cover_all_rows(spark, sf):
    voted = catalog.QUERIES["fit_bagging_vote"](spark, sf)
    from boxfold.plans import inputs

    assert voted.select("sid").distinct().count() == inputs.whole_samples(spark, sf).count()
