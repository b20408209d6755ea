import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfold.kernels import geometry as geo
from boxfold.kernels import learners as kl
from boxfold.operators import dictionary, edit, ensemble, fit, granular, prepare, prune, score, tune
from boxfold.sources import files

SAMPLES = "sid bigint, seq bigint, xl array<double>, xu array<double>, y int"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 2)).round(3)
    y = np.where(x[:, 0] + x[:, 1] > 1, 2, 1)
    rows = [(i, i, p, p, int(c)) for i, (p, c) in enumerate(zip(x.tolist(), y))]
    df = spark.createDataFrame(rows, SAMPLES).cache()
    return x, y, df


@pytest.fixture(scope="module")
def model(data):
    from boxfold.lineage import cut

    return cut(fit.fit(data[2], "improved", theta=0.2))


def test_fit_is_the_kernel(data, model):
    x, y, _ = data
    want = kl.make("improved", theta=0.2).fit(kl.Samples(x, x, y))
    got = model.orderBy("box_id").collect()
    assert [list(r["v"]) for r in got] == want.v.tolist() and [r["n_samples"] for r in got] == want.n.tolist()


def test_fit_refuses_large_folds(data):
    with pytest.raises(Exception, match="at most"):
        fit.fit(data[2], "improved", most_rows=10).collect()


def test_partitions_and_order_do_not_matter(data, model):
    other = fit.fit(data[2].repartition(7, F.rand(1)), "improved", theta=0.2)
    key = lambda r: (r["box_id"], list(r["v"]), list(r["w"]))
    assert sorted(map(key, other.collect())) == sorted(map(key, model.collect()))


def test_predict_is_the_kernel_in_one_block_and_in_many(spark, data, model, monkeypatch):
    x, y, df = data
    boxes = kl.make("improved", theta=0.2).fit(kl.Samples(x, x, y))
    want = kl.predict(boxes, kl.Samples(x, x, y)).tolist()
    one = [r["y_pred"] for r in score.predict(df, model, 2).orderBy("sid").collect()]
    monkeypatch.setattr(score, "BLOCK_CELLS", boxes.size)
    many = [r["y_pred"] for r in score.predict(df, model, 2).orderBy("sid").collect()]
    assert one == want == many
    assert "Exchange" not in score.predict(df.limit(3), model.limit(1), 2)._jdf.queryExecution().logical().toString()


def test_predict_edge_cases(spark, model):
    rows = [(1, 1, [None, 0.2], [None, 0.2], 1), (2, 2, None, None, 1), (3, 3, [5.0, float("nan")], [5.0, float("nan")], 1), (1, 1, [None, 0.2], [None, 0.2], 1)]
    df = spark.createDataFrame(rows, SAMPLES)
    assert sorted(r["sid"] for r in score.predict(df, model, 2).collect()) == [1, 1, 3]
    assert score.predict(df.limit(0), model, 2).count() == 0
    with pytest.raises(ValueError, match="without boxes"):
        score.predict(df, model.limit(0), 2)


def test_probabilities_add_up(data, model):
    p = score.class_probabilities(score.class_memberships(data[2], model, 2))
    assert {round(r["s"], 9) for r in p.groupBy("sid").agg(F.sum("proba").alias("s")).collect()} == {1.0}


def test_prune_drops_bad_boxes(spark, data, model):
    wrong = model.withColumn("c", F.when(F.col("box_id") == 1, 3 - F.col("c")).otherwise(F.col("c")))
    kept = {r["box_id"] for r in prune.prune(data[2], wrong, 2, 0.5).collect()}
    assert 1 not in kept and kept
    full = {r["box_id"] for r in prune.prune(data[2], wrong, 2, 0.5, keep_empty=True).collect()}
    assert 1 not in full


def test_neighbours_lose_no_meeting_pair(spark):
    rng = np.random.default_rng(1)
    v = rng.random((80, 2)).round(2)
    w = (v + rng.random((80, 2)) * 0.3).round(2)
    df = spark.createDataFrame([(i, v[i].tolist(), w[i].tolist(), int(rng.integers(1, 3))) for i in range(80)], "box_id bigint, v array<double>, w array<double>, c int")
    got = {(r["a_id"], r["b_id"]) for r in prune.neighbours(df, 2, 0.07).collect()}
    meets = {(i, j) for i in range(80) for j in range(80) if i != j and geo.meets(v[i], w[i], v[j : j + 1], w[j : j + 1])[0]}
    assert meets <= got and len(got) == prune.neighbours(df, 2, 0.07).count()


def test_samples_of_rows(data, spark):
    members = spark.createDataFrame([(0,), (1,)], "member_id int")
    copies = prepare.per_member(data[2], members)
    sizes = {(r["member_id"], r["y"]): r["count"] for r in data[2].groupBy("y").count().withColumn("member_id", F.lit(0)).collect()}
    strat = prepare.draw_stratified(copies, "sid", "y", 0.4).groupBy("member_id", "y").count().collect()
    assert all(r["count"] == int(0.4 * sizes[0, r["y"]] + 0.5) for r in strat) and len(strat) == 4
    balanced = prepare.draw_balanced(copies, "sid", "y", 0.4).groupBy("member_id", "y").count().collect()
    assert {r["count"] for r in balanced} == {60}
    assert {r["count"] for r in prepare.draw_rate(copies, "sid", 0.5).groupBy("member_id").count().collect()} == {150}
    boot = prepare.draw_rate(copies, "sid", 0.5, bootstrap=True).agg(F.sum("n_samples")).first()[0]
    assert 220 < boot < 380
    folds = prepare.stratified_folds(data[2], "sid", "y", 4).groupBy("y", "fold").count().collect()
    assert len(folds) == 8 and max(r["count"] for r in folds) - min(r["count"] for r in folds if r["y"] == folds[0]["y"]) < 20


def test_dictionary(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "y"), (None, "x")], "p string, q string")
    words = dictionary.build(df, ["p", "q"])
    assert sorted(map(tuple, words.collect())) == [(0, "a", 0), (0, "b", 1), (1, "x", 0), (1, "y", 1)]
    coded = dictionary.encode(df, ["p", "q"], words, missing=100000)
    assert sorted(map(tuple, coded.collect())) == [(0, 100000), (1, 0), (1, 1), (100000, 0)]
    new = spark.createDataFrame([("z", "x")], "p string, q string")
    assert tuple(dictionary.encode(new, ["p", "q"], words).first()) == (None, 0)
    assert tuple(dictionary.one_hot(new, ["p", "q"], words).first()) == (0, 1)
    with pytest.raises(Exception, match="unseen value"):
        dictionary.encode(new, ["p", "q"], words, unseen="error").collect()


def test_ensembles_and_tuning(spark, data):
    members = spark.createDataFrame([(0,), (1,), (2,)], "member_id int")
    boxes = ensemble.bag(data[2], members, "improved", 0.5, theta=0.2).cache()
    votes = ensemble.majority(ensemble.member_predictions(data[2], boxes, 2))
    assert score.accuracy(votes.join(data[2], "sid")).first()[0] > 0.85
    merged = ensemble.merge_members(boxes, theta=0.3, min_simil=0.5)
    assert 0 < merged.count() <= boxes.count()
    picked = ensemble.draw_features(members, 5, "sqrt").collect()
    assert all(len(r["features"]) == 2 and list(r["features"]) == sorted(r["features"]) for r in picked)
    params, best = tune.search_and_fit(data[2], "improved", [{"theta": 0.9}, {"theta": 0.2}], k=3)
    assert params in ({"theta": 0.2}, {"theta": 0.9}) and best.count()
    assert len(tune.sample_grid({"a": [1, 2], "b": [3, 4]}, 3)) == 3


def test_members_learn_their_share_in_parts(spark, data):
    members = spark.createDataFrame([(0,), (1,)], "member_id int")
    drawn = ensemble.draw(data[2], members, 0.5).cache()
    parts = ensemble.in_parts(drawn, 40).groupBy("member_id", "partition_id", "y").count().collect()
    assert sum(r["count"] for r in parts) == drawn.count() == 2 * 150 and len({r["partition_id"] for r in parts}) == 4
    for m, y in {(r["member_id"], r["y"]) for r in parts}:
        sizes = [r["count"] for r in parts if (r["member_id"], r["y"]) == (m, y)]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    key = lambda r: (r["member_id"], r["box_id"], list(r["v"]), list(r["w"]), r["c"])
    whole, one = (sorted(map(key, ensemble.bag(data[2], members, "improved", 0.5, part_rows=n, theta=0.2).collect())) for n in (None, 1_000))
    assert whole == one
    several = [key(r)[:2] for r in ensemble.bag(data[2], members, "improved", 0.5, part_rows=40, theta=0.2).collect()]
    assert len(set(several)) == len(several) > len(whole)
    tuned = tune.tuned_members(drawn, "improved", [{"theta": 0.9}, {"theta": 0.2}], k=3, part_rows=60)
    assert {r["member_id"] for r in tuned.collect()} == {0, 1}


def test_editing_takes_out_noise(spark, data):
    x, y, df = data
    noisy = df.withColumn("y", F.when(F.col("sid") == 5, 3 - F.col("y")).otherwise(F.col("y")))
    kept = {r["sid"] for r in edit.two_fold_probability(noisy, "improved", n_iters=3, theta=0.3).collect()}
    assert 5 not in kept and len(kept) > 200
    assert edit.two_fold(noisy, "improved", n_iters=2, n_last_iters=1, theta=0.3).count() < 300
    few = df.filter("sid < 30")
    assert 0 < edit.leave_one_out(few, "improved", n_iters=2, n_last_iters=1, theta=0.3).count() <= 30


def test_two_fold_edits_more_rows_than_one_fold_holds(data):
    noisy = data[2].withColumn("y", F.when(F.col("sid") == 5, 3 - F.col("y")).otherwise(F.col("y")))
    parts = prepare.stratified_folds(noisy, "sid", "y", 2, name="part")
    for run, how in ((edit.two_fold, {"n_last_iters": 1}), (edit.two_fold_probability, {})):
        kept = {r["sid"] for r in run(parts, "improved", n_iters=3, by="part", most_rows=160, theta=0.3, **how).collect()}
        assert 5 not in kept and len(kept) > 150


def test_leave_one_out_keeps_a_rare_class(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.random((200, 2)) * 0.7, 0.95 + r.random((8, 2)) * 0.04])
    rows = [(i, i, p.tolist(), p.tolist(), 1 if i < 200 else 3) for i, p in enumerate(x)]
    s = spark.createDataFrame(rows, "sid bigint, seq bigint, xl array<double>, xu array<double>, y int")
    parts = edit.local_parts(s, 20, 10, 2).cache()
    assert parts.filter("own").count() == parts.filter("own").select("sid").distinct().count() == 208
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] <= 40
    kept = [q["sid"] for q in edit.leave_one_out(parts, "improved", by="part", own="own", n_iters=1, theta=0.001).collect()]
    assert len(set(kept)) == len(kept) and {i for i in kept if i >= 200} == set(range(200, 208))


def test_parts_of_a_fit_share_a_rare_class(spark):
    s = spark.createDataFrame([(i, i, [i / 400, 0.5], [i / 400, 0.5], 3 if i < 8 else 1) for i in range(400)], "sid bigint, seq bigint, xl array<double>, xu array<double>, y int")
    boxes = fit.partitioned(s, "improved", 50, theta=0.001)
    rare = boxes.filter("c = 3").groupBy("partition_id").agg(F.sum("n_samples").alias("n")).collect()
    assert sorted((r["partition_id"], r["n"]) for r in rare) == [(k, 1.0) for k in range(8)]


def test_granular_levels(data):
    boxes = granular.fit(data[2], (0.1, 0.3), n_partitions=2).cache()
    counts = {r["level"]: r["count"] for r in boxes.groupBy("level").count().collect()}
    assert counts[1] <= counts[0]
    assert granular.predict(data[2], boxes, 2).count() == granular.predict(data[2], boxes, 2, level=1).count() == 300
    assert granular.memberships(data[2], boxes, 2).count() == 600
    assert granular.level_of([0.1, 0.3]) == {0.1: 0, 0.3: 1}


def test_models_on_disk(spark, data, model, tmp_path):
    files.store_model(model, str(tmp_path / "m"), "first", {"theta": 0.2})
    files.store_model(model, str(tmp_path / "m"), "second", {"theta": 0.3})
    boxes, params = files.load_model(spark, str(tmp_path / "m"), "first")
    assert params == {"theta": 0.2} and boxes.count() == model.count()
    assert files.load_models(spark, str(tmp_path / "m")).groupBy("model_id").count().count() == 2
    files.parallel_coordinates(score.explain(data[2].limit(2), model, 2), str(tmp_path / "page.html"))
    assert "<polyline" in (tmp_path / "page.html").read_text()


def test_csv_source(spark, tmp_path):
    (tmp_path / "x.csv").write_text("0.1,0.2,1\n0.3,,2\n0.5,0.6,\n")
    rows = files.read_numeric(spark, str(tmp_path / "x.csv"), 2).orderBy("seq").collect()
    assert [r["y"] for r in rows] == [1, 2, -1] and rows[1]["xl"] == [0.3, None]
