"""Known values of the kernels, in numpy and as Column expressions, and invariants of the learners."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxfold.functions import contract, distance, membership, overlap
from boxfold.kernels import geometry as geo
from boxfold.kernels import learners as kl

X = [[0.4, 0.3], [0.1, 0.2]]
V, W = [[0.2, 0.2], [0.45, 0.3]], [[0.45, 0.5], [0.6, 0.6]]
A = ([0.2, 0.2], [0.5, 0.6])
#: box, meets A, fmnn case of A against it, and of it against A.
OTHERS = [
    (([0.6, 0.3], [0.7, 0.8]), False, None, None), (([0.3, 0.3], [0.7, 0.8]), True, (1, 0), (2, 0)), (([0.35, 0.3], [0.4, 0.4]), True, (32, 0), (41, 0)),
    (([0.3, 0.3], [0.35, 0.4]), True, (31, 0), (42, 0)), (([0.5, 0.1], [0.5, 0.8]), True, None, (41, 0)), (([0.5, 0.6], [0.7, 0.8]), True, None, None), (A, True, (1, 0), (1, 0)),
]


def lits(xs):
    return [F.lit(float(x)) for x in xs]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x,gfmm,fmnn", [(X[0], [1, 0.95], [1, 0.9875]), (X[1], [0.9, 0.65], [0.975, 0.8875])])
def test_memberships(spark, x, gfmm, fmnn):
    a = np.array(x)
    assert geo.gfmm(a, a, np.array(V), np.array(W)).tolist() == pytest.approx(gfmm)
    assert geo.fmnn(a, np.array(V), np.array(W)).tolist() == pytest.approx(fmnn)
    for v, w, g, f in zip(V, W, gfmm, fmnn):
        assert value(spark, membership.gfmm(lits(x), lits(x), lits(v), lits(w))) == pytest.approx(g)
        assert value(spark, membership.fmnn(lits(x), lits(v), lits(w))) == pytest.approx(f)


def test_asymmetric_and_mixed(spark):
    for way, expected in (("max", [1, 0.95]), ("min", [0.8, 0.7])):
        got = [value(spark, membership.asymmetric(lits(X[0]), lits(X[0]), lits(v), lits(w), way=way)) for v, w in zip(V, W)]
        assert got == pytest.approx(expected)
    hist0 = F.create_map(*[F.lit(x) for x in ("1", 5, "2", 2, "3", 1)])
    hist1 = F.create_map(*[F.lit(x) for x in ("1", 3, "2", 4, "3", 1)])
    hists = [h.cast("map<string,bigint>") for h in (hist0, hist1)]
    assert value(spark, membership.histogram_fit([F.lit("3"), F.lit("1")], hists)) == pytest.approx(0.25)
    assert value(spark, membership.histogram_fit([F.lit("1"), F.lit("2")], hists)) == pytest.approx(0.5625)
    assert value(spark, membership.mixed(F.lit(1.0), F.lit(0.25), 0.6)) == pytest.approx(0.7)
    bits = [F.lit(b).cast("bigint") for b in (2, 5)]
    assert value(spark, membership.shares_bits(bits, [F.lit(1).cast("bigint"), F.lit(7).cast("bigint")])) == 0.5


def test_distances(spark):
    assert value(spark, distance.manhattan(lits([0.2, 0.1]), lits([0.5, 0.6]))) == pytest.approx(0.8)
    assert value(spark, distance.to_both_corners(lits([0.2, 0.1]), lits([0.4, 0.5]), lits([0.8, 0.7]))) == pytest.approx(0.45)
    assert value(spark, distance.to_both_corners(lits([0.1, 0.25]), lits([0.3, 0.4]), lits([0.5, 0.6]))) == pytest.approx(0.275)
    assert value(spark, distance.pair_code(F.lit(10), F.lit(20))) == value(spark, distance.pair_code(F.lit(20), F.lit(10))) == 220
    missing = lits([geo.MISSING_LOW, geo.MISSING_LOW]), lits([geo.MISSING_HIGH, geo.MISSING_HIGH])
    assert value(spark, distance.manhattan_present(*missing, lits([0, 0]), lits([1, 1]))) == distance.NO_DISTANCE


@pytest.mark.parametrize("other,meets,case,back", OTHERS)
def test_overlap_cases(spark, other, meets, case, back):
    a, b = [tuple(np.array(s, float) for s in box) for box in (A, other)]
    assert bool(geo.meets(*a, b[0][None], b[1][None])[0]) == meets
    assert geo.fmnn_case(a, b) == case and geo.fmnn_case(b, a) == back
    row = spark.range(1).select(overlap.overlaps(*map(lits, (*a, *b))).alias("m"), overlap.fmnn_case(*map(lits, (*a, *b))).alias("c"), contract.gfmm_case(*map(lits, (*a, *b))).alias("g"), overlap.efmnn_case(*map(lits, (*a, *b)), lits(a[1])).alias("e")).first()
    pair = lambda s: s and (s["case"], s["dim"])
    assert row["m"] == meets and pair(row["c"]) == case
    assert pair(row["g"]) == geo.gfmm_case(a, b) and pair(row["e"]) == geo.efmnn_case(a, b, a[1])


def test_contraction_known():
    a, b = [np.array(x, float) for x in A], [np.array([0.3, 0.3]), np.array([0.7, 0.8])]
    geo.part_gfmm(a, b, alpha=1e-4)
    assert a[1].tolist() == pytest.approx([0.4, 0.6]) and b[0].tolist() == pytest.approx([0.4001, 0.3])


corner = st.lists(st.integers(0, 8).map(lambda x: x / 8), min_size=2, max_size=2)
box = st.tuples(corner, corner).map(lambda p: (np.minimum(*map(np.array, p)).astype(float), np.maximum(*map(np.array, p)).astype(float)))


@settings(max_examples=150, deadline=None)
@given(box, box)
def test_parting_ends_area_overlap(a, b):
    v, w, v2, w2 = *(x.copy() for x in a), *(x.copy() for x in b)
    geo.part_gfmm((v, w), (v2, w2))
    if (np.minimum(a[1], b[1]) > np.maximum(a[0], b[0])).all():
        assert not (np.minimum(w, w2) > np.maximum(v, v2) + 1e-12).all()


def random_samples(n, seed, labels=(1, 2), missing=False):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2)).round(3)
    if missing:
        x[rng.random(x.shape) < 0.05] = np.nan
    return kl.Samples(x, x.copy(), rng.choice(labels, n))


def naive_improved(s, theta, gamma=1.0):
    """The improved online learner in plain lists."""
    boxes = []
    ramp = lambda z: min(1.0, max(0.0, z * gamma))
    member = lambda x, v, w: min(min(1 - ramp(a - c), 1 - ramp(b - a)) for a, b, c in zip(x, v, w))
    for x, y in zip(s.xl.tolist(), s.y.tolist()):
        own = [(member(x, v, w), k) for k, (v, w, c, n) in enumerate(boxes) if c == y]
        own.sort()
        own.reverse()
        if own and own[0][0] == 1:
            boxes[own[0][1]][3] += 1
            continue
        for m, k in own:
            if m < 1 - gamma * theta:
                continue
            v = [min(a, b) for a, b in zip(boxes[k][0], x)]
            w = [max(a, b) for a, b in zip(boxes[k][1], x)]
            fits = all(b - a <= theta for a, b in zip(v, w))
            meets = any(c != y and all(max(a, e) - min(b, f) <= 0 for a, b, e, f in zip(v, w, v2, w2)) for v2, w2, c, n in boxes)
            if fits and not meets:
                boxes[k][0], boxes[k][1] = v, w
                boxes[k][3] += 1
                break
        else:
            boxes.append([list(x), list(x), y, 1])
    return boxes


@pytest.mark.parametrize("seed", range(4))
def test_improved_equals_naive(seed):
    s = random_samples(150, seed)
    got = kl.make("improved", theta=0.2).fit(s)
    want = naive_improved(s, 0.2)
    assert got.size == len(want)
    assert got.v.tolist() == [b[0] for b in want] and got.w.tolist() == [b[1] for b in want]
    assert got.c.tolist() == [b[2] for b in want] and got.n.tolist() == [b[3] for b in want]


@pytest.mark.parametrize("name", ["fmnn", "efmnn", "knefmnn", "rfmnn", "online", "improved", "inf", "agglomerative", "agglomerative2"])
@pytest.mark.parametrize("seed", [0, 1])
def test_learner_invariants(name, seed):
    s = random_samples(60 if "agglo" in name else 120, seed)
    extra = {"min_simil": 0.5} if "agglo" in name else {}
    boxes = kl.make(name, theta=0.3, **extra).fit(s)
    assert set(boxes.c) == set(s.y)
    if name in ("efmnn", "knefmnn", "online", "improved", "agglomerative", "agglomerative2"):
        assert (boxes.w - boxes.v <= 0.3 + 1e-12).all()
    if name in ("improved", "agglomerative", "agglomerative2"):
        assert boxes.n.sum() == len(s)
        for x, y in zip(s.xl, s.y):
            own = boxes.c == y
            assert (geo.gfmm(x, x, boxes.v[own], boxes.w[own]) == 1).any()
    if "agglo" in name:
        for j in range(boxes.size):
            other = boxes.c != boxes.c[j]
            assert not geo.meets(boxes.v[j], boxes.w[j], boxes.v[other], boxes.w[other]).any()


def test_continued_fit_is_one_fit():
    s = random_samples(100, 5)
    whole = kl.make("improved", theta=0.2).fit(s)
    first = kl.make("improved", theta=0.2)
    first.fit(kl.Samples(s.xl[:40], s.xu[:40], s.y[:40]))
    rest = first.fit(kl.Samples(s.xl[40:], s.xu[40:], s.y[40:]))
    assert rest.v.tolist() == whole.v.tolist() and rest.n.tolist() == whole.n.tolist()


def test_unlabelled_and_missing():
    s = random_samples(100, 7, labels=(-1, 1, 2), missing=True)
    for name in ("online", "improved", "inf"):
        boxes = kl.make(name, theta=0.3).fit(s)
        assert boxes.size and set(boxes.c) <= {-1, 1, 2}
    only = kl.make("online", theta=0.3).fit(random_samples(50, 8, labels=(-1,)))
    assert set(only.c) == {-1}


def test_mixed_learners():
    rng = np.random.default_rng(3)
    x = rng.random((60, 1)).round(2)
    cat = rng.integers(0, 4, (60, 2))
    y = rng.choice([1, 2], 60)
    hist = kl.make("eiol", theta=0.4, delta=0.6).fit(kl.Samples(x, x, y, cat=cat.astype(str).astype(object)))
    assert hist.n.sum() == 60 and sum(sum(h[0].values()) for h in hist.a) == 60
    bits = kl.make("onehot", theta=0.4, theta_min=0.4).fit(kl.Samples(x, x, y, cat=1 << cat))
    assert (bits.a > 0).all()
    gaps = [{(a, b): abs(a - b) / 3 for a in range(4) for b in range(a, 4)} for _ in range(2)]
    slots = kl.make("freqcat", theta=0.4, theta_min=0.4, eta=0.5, distance=gaps).fit(kl.Samples(x, x, y, cat=cat))
    assert ((slots.b == geo.EMPTY) | (slots.b < 4)).all()


def test_entropy_growth(spark):
    h = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,bigint>")
    got = value(spark, distance.entropy_growth(h({"a": 2, "b": 1}), h({"a": 2})))
    assert got == pytest.approx(kl.entropy(kl.Counter(a=2, b=1)))


def test_remove_contained():
    boxes = kl.Boxes(2)
    boxes.add([0, 0], [1, 1], 1, 3)
    boxes.add([0.2, 0.2], [0.4, 0.4], 1, 2)
    boxes.add([0.2, 0.2], [0.4, 0.4], 2, 1)
    assert kl.remove_contained(boxes).tolist() == [0, 2]
    assert boxes.n[0] == 5


def _boxes_equal(a, b):
    return a.size == b.size and all(np.array_equal(getattr(a, k), getattr(b, k)) for k in "vwcnm")


@pytest.mark.parametrize("seed", range(8))
def test_compared_fit_is_the_fold(seed):
    """Chunks, points looked up and the nearest rivals first give the boxes, weights and centroids of the fold sample by sample."""
    rng = np.random.default_rng(seed)
    n, d = 700, 1 + seed % 3
    x = rng.random((n, d)).round(2)
    s = kl.Samples(x, x if seed % 2 else (x + rng.random((n, d)) * 0.05).round(2), rng.integers(1, 4, n), rng.integers(1, 4, n).astype(float))
    how = dict(theta=0.25, gamma=[4.0, 0.5, 1.0][:d] if seed % 3 else 1.0)
    fast, fold = kl.make("improved", **how), kl.make("improved", **how)
    for _ in range(2):  # the second fit goes on from the first
        fast.learn = None
        assert _boxes_equal(fast.fit(s), kl.Learner.fit(fold, s))


@pytest.mark.parametrize("theta", [0.3, -1.0])
def test_coarsening_looks_near_only(theta):
    rng = np.random.default_rng(3)
    x = rng.random((300, 2)).round(2)
    s = kl.Samples(x, x + (rng.random((300, 2)) * 0.1).round(2), rng.integers(1, 4, 300), np.ones(300))

    class Whole(kl.Coarsen):
        def begin(self, s):
            super().begin(s)
            self.plain = False

    near, called = kl.make("coarsen", theta=theta), []
    near.candidates = lambda y: called.append(y)
    assert _boxes_equal(near.fit(s), Whole(theta=theta).fit(s)) and not called


@pytest.mark.parametrize("gamma", [1.0, [4.0, 0.5]])
def test_levels_of_one_pass_are_compared(gamma):
    """The first level of granular learning: one pass in which boxes only grow, without a look at every box for every sample."""
    rng = np.random.default_rng(5)
    x = rng.random((600, 2)).round(2)
    s = kl.Samples(x, x, rng.integers(1, 4, 600))
    how = dict(theta=0.2, theta_min=0.2, alpha=0.5, contract=False, gamma=gamma)
    fast, fold = kl.make("online", **how), kl.make("online", **how)
    fast.learn, fold.comparable = None, lambda s: False
    assert _boxes_equal(fast.fit(s), fold.fit(s)) and fast.passes == fold.passes
