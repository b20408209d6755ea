import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfold.kernels import learners as kl
from boxfold.kernels import scoring
from boxfold.kernels.geometry import EMPTY, meets
from boxfold.operators import fit, granular, prune, score

V, W = np.array([[0.2, 0.2], [0.45, 0.3]]), np.array([[0.45, 0.5], [0.6, 0.6]])
X = np.array([[0.4, 0.3], [0.1, 0.2]])


def model(kind, c=(1, 2), n=(1.0, 1.0), v=V, w=W, **cats):
    k = len(v)
    return scoring.Model(np.arange(1, k + 1), v, w, np.array(c), np.array(n), (v + w) / 2, kind, **cats)


def bits(*features):
    return [sum(1 << k for k, on in enumerate(f) if on) for f in features]


def test_onehot_goldens():
    m = model("onehot", bits=np.array([bits((0, 1), (1, 1, 1)), bits((1, 1), (0, 1, 1))]))
    x = np.array([bits((1, 0), (1, 0, 1))])
    assert np.allclose(scoring.numeric_tile(m, X[:1], X[:1]), [[1, 0.95]])
    assert np.allclose(scoring.category_tile(m, x), [[0.5, 1]])
    assert np.allclose(scoring.tile_membership(m, X[:1], X[:1], x), [[0.75, 0.975]])
    assert np.allclose(scoring.tile_membership(m, np.zeros((1, 0)), np.zeros((1, 0)), x), [[0.5, 1]])


def test_histogram_goldens():
    hist = [[{"1": 5, "2": 2, "3": 1}, {"1": 3, "2": 4, "3": 1}], [{"1": 2, "2": 6, "3": 8}, {"1": 4, "2": 7, "3": 5}]]
    m = model("eiol", hist=hist, alpha=0.6)
    x = np.array([["3", "1"], ["1", "2"]], object)
    assert np.allclose(scoring.category_tile(m, x), [[0.25, 0.375], [0.5625, 0.28125]])
    assert np.allclose(scoring.tile_membership(m, X, X, x), [[0.7, 0.72], [0.765, 0.5025]])
    assert np.allclose(scoring.category_tile(m, np.array([["unseen", "1"]], object)), [[3 / 8 / 2, 4 / 16 / 2]])


def test_slots_by_hand():
    gap = [{(1, 1): 0.0, (1, 2): 0.4, (1, 3): 1.0, (2, 3): 0.7, (2, 2): 0.0, (3, 3): 0.0}]
    m = model("freqcat", slots=(np.array([[1], [2]]), np.array([[2], [EMPTY]])), distance=gap)
    got = scoring.category_tile(m, np.array([[1], [3], [9]]))
    # value 1: slot 1 fits wholly, so the other counts as fitting; value 3: least of both; an unknown value is at distance 0
    assert np.allclose(got, [[1.0, 0.6], [0.0, 0.3], [1.0, 1.0]])


@pytest.mark.parametrize("kind", ["gfmm", "onehot", "freqcat", "eiol"])
def test_blocks_and_passes_change_nothing(spark, monkeypatch, kind):
    rng = np.random.default_rng(1)
    boxes, samples = [], []
    for k in range(60):
        v = rng.random(2).round(2)
        boxes.append((k + 1, v.tolist(), (v + rng.random(2).round(2) * 0.3).tolist(), int(rng.integers(1, 4)), float(rng.integers(1, 4)), [1, 2], [2, None], [int(rng.integers(1, 8)), 3], [{"a": 2, "b": int(rng.integers(1, 5))}]))
    boxes.append((70, None, None, 1, 1.0, None, None, None, None))
    for k in range(200):
        x = rng.random(2).round(2).tolist()
        cat = {"onehot": ["1", "2"], "freqcat": ["1", "3"], "eiol": ["a"], "gfmm": ["x"]}[kind]
        samples.append((k, x, x, 1, cat))
    samples += [(900, [None, 0.5], [None, 0.5], 1, [None] * len(cat)), (901, None, None, 1, None)]
    b = spark.createDataFrame(boxes, "box_id bigint, v array<double>, w array<double>, c int, n_samples double, e array<int>, f array<int>, bits array<bigint>, hist array<map<string,bigint>>")
    s = spark.createDataFrame(samples, "sid bigint, xl array<double>, xu array<double>, y int, cat array<string>")
    how = {"kind": kind} | ({"distance": [{(1, 2): 0.5, (1, 3): 0.2}, {(2, 3): 0.3}]} if kind == "freqcat" else {})
    rows = lambda df: sorted(map(tuple, df.collect()))
    asked = [lambda: score.predict(s, b, 2, **how), lambda: score.attribute(s, b, 2, **how), lambda: score.class_memberships(s, b, 2, **how), lambda: score.predict(s, b, 2, rule="centroid", **how)]
    want = [rows(f()) for f in asked]
    assert len(want[0]) == 201
    monkeypatch.setattr(score, "BLOCK_CELLS", 200)
    for most in (100, 2):
        monkeypatch.setattr(score, "PASS_BLOCKS", most)
        assert [rows(f()) for f in asked] == want


def test_one_block_is_asked_for(spark, monkeypatch):
    b = spark.createDataFrame([(k, [0.1, 0.1], [0.2, 0.2], 1) for k in range(9)], "box_id bigint, v array<double>, w array<double>, c int")
    monkeypatch.setattr(score, "BLOCK_CELLS", 10)
    with pytest.raises(ValueError, match="one block"):
        score.one_block(b, 2)
    monkeypatch.setattr(score, "MOST_BLOCKS", 2)
    with pytest.raises(ValueError, match="coarsen"):
        score.n_blocks(b, 2)


def test_likeliest_box():
    v = np.array([[0.1, 0.1]] * 4)
    m = model("gfmm", c=(2, 1, 1, 2), n=(3.0, 2.0, 2.0, 1.0), v=v, w=v + 0.2)
    b = np.array([[0.9, 0.9, 0.9, 0.1], [1.0, 1.0, 1.0, 1.0], [0.5, 0.2, 0.1, 0.1]])
    at = scoring.most_likely(m, b)
    assert m.c[at[0]] == 1 and at[1] == 3 and at[2] == 0  # more samples; certain box of one sample; a single best box


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(2)
    centres = rng.random((40, 2))
    rows = [(k, k, x.tolist(), x.tolist(), int(1 + c % 3)) for k, (c, x) in enumerate((c, np.clip(centres[c] + rng.normal(0, 0.04, 2), 0, 1)) for c in rng.integers(0, 40, 1500))]
    s = spark.createDataFrame(rows, "sid bigint, seq bigint, xl array<double>, xu array<double>, y int")
    return s, fit.partitioned(s, "improved", 200, theta=0.1).cache()


def arrays(boxes):
    rows = boxes.collect()
    return np.array([r["v"] for r in rows]), np.array([r["w"] for r in rows]), np.array([r["c"] for r in rows])


@pytest.mark.parametrize("fold_boxes", [100_000, 60])
def test_merged_parts_do_not_meet(spark, parts, monkeypatch, fold_boxes):
    monkeypatch.setattr(granular, "FOLD_BOXES", fold_boxes)
    s, boxes = parts
    v, w, c = arrays(granular.merge_parts(boxes, 0.1))
    assert len(v) < boxes.count()
    assert (w - v).max() <= 0.1 + 1e-9
    for k in range(len(v)):
        other = c != c[k]
        assert not meets(v[k], w[k], v[other], w[other]).any()
    merged = granular.merge_parts(boxes, 0.1)
    assert score.accuracy(score.predict(s, merged, 2).join(s, "sid")).first()[0] > 0.6


def test_contained_boxes_leave_their_weight(spark, parts, monkeypatch):
    _, boxes = parts
    plain = boxes.select("box_id", "v", "w", "c", "n_samples", "centroid")
    monkeypatch.setattr(granular, "FOLD_BOXES", 60)
    kept = granular.remove_contained(plain)
    assert kept.agg(F.sum("n_samples")).first()[0] == plain.agg(F.sum("n_samples")).first()[0]
    assert prune.containment_pairs(kept, 2).count() == 0 and kept.count() < plain.count()


def test_prune_a_partitioned_model(spark, parts):
    s, boxes = parts
    kept = prune.prune(s, boxes, 2)
    assert 0 < kept.count() <= boxes.count() and boxes.agg(F.max("box_id")).first()[0] > 1 << 31
    levels = granular.fit(s, (0.1, 0.2), n_partitions=3, validation=s, d=2)
    assert levels.select("level").distinct().count() == 2


def test_dealt_parts_are_even(spark, parts):
    from boxfold.operators import prepare

    s, _ = parts
    n = {(r["y"], r["p"]): r["count"] for r in prepare.dealt(s, "y", 7, name="p").groupBy("y", "p").count().collect()}
    for y in {y for y, _ in n}:
        sizes = [n.get((y, p), 0) for p in range(7)]
        assert max(sizes) - min(sizes) <= 1
    empty = prepare.dealt(s.limit(0), "y", 3)
    assert empty.count() == 0 and "partition_id" in empty.columns


def test_kinds_follow_learners():
    assert [kl.kind_of(x) for x in ("fmnn", "inf", "eiol", "agglomerative2")] == ["fmnn", "free", "eiol", "gfmm"] and kl.rule_of("rfmnn") == "corners"


@pytest.mark.parametrize("kind", ["gfmm", "free", "fmnn", "onehot", "freqcat"])
@pytest.mark.parametrize("gamma", [1.0, [4.0, 0.5]])
def test_looking_near_first_changes_nothing(kind, gamma, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.random((300, 2)).round(2)
    w = v + (rng.random((300, 2)) * 0.1).round(2)
    v[:5, 0], w[:5, 0] = 1.001, -0.001
    cats = {"onehot": {"bits": rng.integers(0, 8, (300, 2))}, "freqcat": {"slots": (rng.integers(0, 3, (300, 2)), rng.integers(0, 3, (300, 2))), "distance": [{(a, b): abs(a - b) / 3 for a in range(3) for b in range(a, 3)}] * 2}}.get(kind, {})
    x = np.concatenate([rng.random((700, 2)).round(2), rng.normal(0, 20, (40, 2))])
    lo, hi = x.copy(), x + (rng.random(x.shape) * 0.05).round(2)
    if kind != "fmnn":
        lo[:30, 1], hi[:30, 1] = 1.001, -0.001
    cat = rng.integers(0, 3, x.shape)
    for rule in ("manhattan", "centroid", "probability"):
        m = model(kind, c=rng.integers(1, 4, 300), n=rng.integers(1, 5, 300).astype(float), v=v, w=w, rule=rule, gamma=gamma, **cats)
        told = []
        for cells in (10**9, 0):
            monkeypatch.setattr(scoring, "ALL_CELLS", cells)
            e = scoring.evidence_of(m, lo, hi, cat, True)
            told.append([scoring.winners(m, lo, hi, cat), scoring.speakers(m, lo, hi, cat), *(e[:5] if rule == "probability" else e)])
        assert all(np.array_equal(a, b) for a, b in zip(*told))


def test_contained_boxes_of_any_width_are_found_side_by_side(spark, monkeypatch):
    """Without grids, whose cells of four edges held all boxes; equal boxes are one, and the farthest holder takes the weight."""
    rows = [(1, [0.0, 0.0], [0.9, 0.9], 1, 2.0, [0.4, 0.4]), (2, [0.1, 0.1], [0.8, 0.8], 1, 1.0, [0.2, 0.2]), (3, [0.05, 0.05], [0.99, 0.99], 1, 1.0, [0.9, 0.9]),
            (4, [0.5, 0.5], [0.5, 0.5], 1, 3.0, [0.5, 0.5]), (5, [0.5, 0.5], [0.5, 0.5], 2, 1.0, [0.5, 0.5]), (6, [0.5, 0.5], [0.5, 0.5], 2, 4.0, [0.5, 0.5])]
    b = spark.createDataFrame(rows, "box_id bigint, v array<double>, w array<double>, c int, n_samples double, centroid array<double>")
    monkeypatch.setattr(granular, "FOLD_BOXES", 3)
    monkeypatch.setattr(granular, "_grid", None)
    kept = sorted((r["box_id"], r["n_samples"], [round(x, 9) for x in r["centroid"]]) for r in granular.remove_contained(b).collect())
    assert kept == [(1, 2.0, [0.4, 0.4]), (3, 5.0, [0.52, 0.52]), (6, 5.0, [0.5, 0.5])]


def test_samples_of_a_task_are_asked_together(spark, monkeypatch):
    """Whatever the batches, neighbourhoods are made of all rows of a task, and nothing is lost."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + n), pa.int64())], names=["sid"]) for k, n in ((0, 3), (3, 0), (3, 4), (7, 1))]
    assert [b.num_rows for b in score.gathered(iter(batches))] == [8] and not list(score.gathered(iter(batches[1:2])))
    monkeypatch.setattr(score, "GATHERED", 5)
    assert [b["sid"].to_pylist() for b in score.gathered(iter(batches))] == [list(range(7)), [7]]


def test_held_samples_meet_few_boxes(monkeypatch):
    """A sample in a box is told by the boxes that its neighbourhood meets, not by all within a fixed distance."""
    rng = np.random.default_rng(4)
    v = rng.random((4000, 2))
    m = model("gfmm", c=rng.integers(1, 4, 4000), n=np.ones(4000), v=v, w=v + 0.005)
    x = v[:2000] + 0.002
    sizes, run = [], scoring.tile_membership
    monkeypatch.setattr(scoring, "tile_membership", lambda some, *a: sizes.append(len(some.c) * len(a[0])) or run(some, *a))
    monkeypatch.setattr(scoring, "ALL_CELLS", 0)
    scoring.winners(m, x, x)
    assert sum(sizes) < 2000 * 700
