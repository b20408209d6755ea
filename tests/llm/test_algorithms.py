import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfold.llm import cluster, pack, sample, terms


@pytest.fixture(scope="module")
def codes(spark):
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.05 else i // 2, rng.choice(["b", "b", "b", "a", "", " b", None, f"t{rng.randrange(400)}"]), rng.choice([0, 1, None, rng.randrange(50)]), i) for i in range(3000)]
    rows += [(1, "b", 0, 7)] * 900  # one record holds a hot share
    return rows, spark.createDataFrame(rows, "sid bigint, c0 string, c15 int, n int")


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_terms_against_counter(codes, monkeypatch, broadcast):
    rows, df = codes
    monkeypatch.setattr(terms, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(terms, "RANGE", 16)
    got = {(r["field"], r["code"]): (r["occurrences"], r["records"], r["mark"]) for r in terms.term_frequencies(df, ["c0", "c15"], "sid", common_share=0.3).collect()}
    occ, held = Counter(), {}
    for sid, a, b, _ in rows:
        for f, v in (("c0", a), ("c15", None if b is None else str(b))):
            if v is not None:
                occ[f, v] += 1
                held.setdefault((f, v), set()).update([] if sid is None else [sid])
    n = len({r[0] for r in rows} - {None})
    want = {k: (occ[k], len(s), "rare" if len(s) <= 5 else "common" if len(s) > 0.3 * n else None) for k, s in held.items()}
    assert got == want


def test_terms_of_nothing(codes):
    assert terms.term_frequencies(codes[1].limit(0), ["c0"], "sid").count() == 0
    assert terms.term_frequencies(codes[1].withColumn("c0", F.lit(None).cast("string")), ["c0"], "sid").count() == 0


def test_allocate():
    assert sample.allocate([0.5, 0.5], [0, 0], [100, 100], 7) == [4, 3]
    assert sample.allocate([0.5, 0.5], [0, 0], [2, 100], 10) == [2, 8]
    assert sample.allocate([0.98, 0.02], [0, 5], [100, 100], 50) == [45, 5]
    assert sample.allocate([0.98, 0.02], [0, 5], [100, 3], 50) == [47, 3]
    assert sample.allocate([0.3, 0.3, 0.4], [0, 0, 0], [0, 0, 0], 9) == [0, 0, 0]
    rng = random.Random(2)
    for _ in range(500):
        k = rng.randrange(1, 6)
        w = [rng.random() for _ in range(k)]
        shares = [round(x / sum(w), 4) for x in w]
        have, floors, size = [rng.randrange(40) for _ in range(k)], [rng.choice([0, 0, 3]) for _ in range(k)], rng.randrange(60)
        q = sample.allocate(shares, floors, have, size)
        assert all(min(f, h) <= x <= h for x, f, h in zip(q, floors, have))
        if sum(min(f, h) for f, h in zip(floors, have)) <= size:
            assert sum(q) <= size


@pytest.mark.parametrize("edge_rows, broadcast", [(4096, 10_000), (7, 0)])
def test_draw_takes_the_smallest_keys(spark, monkeypatch, edge_rows, broadcast):
    monkeypatch.setattr(sample, "EDGE_ROWS", edge_rows)
    monkeypatch.setattr(sample, "BROADCAST_TARGETS", broadcast)
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.02 else rng.randrange(3000), rng.choice(["a", "a", "a", "b", "c", None])) for _ in range(6000)]
    first = {}
    rows = [r for r in rows if first.setdefault(r[0], r[1]) == r[1]]
    df = spark.createDataFrame(rows, "sid bigint, c string")
    targets = spark.createDataFrame([(1, "c", "a", 0.5, 0, 200), (1, "c", "b", 0.5, 0, 200), (2, "c", "a", 0.9, 0, 100), (2, "c", "z", 0.1, 2, 100), (3, "c", "a", 0.99, 0, 50), (3, "c", "b", 0.01, 20, 50)], "target_id int, field string, category string, target_share double, min_rows int, sample_size int")
    found = sample.candidates(df, "sid", ["c"])
    plan = sample.plan_quotas(sample.category_counts(found), targets)
    quota = {(r["target_id"], r["category"]): r["quota"] for r in plan.collect()}
    drawn = sample.draw(found, plan)
    told = sample.report(plan, drawn).collect()
    assert {(r["target_id"], r["category"]): (r["drawn"], r["shortfall"], r["cause"]) for r in told if r["shortfall"]} == {(2, "z"): (0, 10, "available"), (3, "a"): (30, 20, "size")}
    assert [(r["target_id"], r["category"]) for r in sample.shortfalls(sample.report(plan, drawn)).collect()] == [(2, "z")]
    by = {}
    for r in drawn.collect():
        by.setdefault((r["target_id"], r["category"]), set()).add(r["record"])
    assert {k: len(v) for k, v in by.items()} == {k: q for k, q in quota.items() if q}
    for t, c in by:
        keys = df.filter((F.col("c") == c) & F.col("sid").isNotNull()).select("sid").distinct().select(F.expr(f"shiftrightunsigned(xxhash64(sid, {t}, 0), 1)").alias("key"), "sid").collect()
        assert by[t, c] == {r["sid"] for r in sorted(keys)[: quota[t, c]]}
    nothing = sample.candidates(df.limit(0), "sid", ["c"])
    assert sample.draw(nothing, plan).count() == 0
    assert sample.shortfalls(sample.report(sample.plan_quotas(sample.category_counts(nothing), targets), drawn.limit(0))).count() == 6


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_packing_is_whole_and_tight(capacity):
    rng = np.random.default_rng(capacity)
    for sizes in (rng.integers(1, capacity + 1, 500), np.minimum(capacity, rng.pareto(1.2, 800).astype(int) + 1)):
        home, window, tier = pack.pack_sizes(sizes, capacity)
        used = np.bincount(home, sizes)
        assert used.max() <= capacity and len(home) == len(sizes) and (used > 0).all()
        assert len(used) <= -(-11 * sizes.sum() // (9 * capacity)) + 1
        # a window holds no more than its tier's context size, is in one container, and a text is in no window of a shorter tier than its own
        assert (np.bincount(window, sizes, len(tier)) <= capacity >> tier).all()
        assert all(len(set(home[window == k])) == 1 for k in range(len(tier)))
        own = np.array([min(pack.TIERS, (capacity // int(s)).bit_length() - 1) for s in sizes])
        assert (tier[window] <= own).all()
        step = pack.deal_steps(used.astype(np.int64), 4)
        assert np.bincount(step).max() <= 4


def test_gaps_of_long_windows_are_filled_from_shorter_tiers():
    sizes = np.array([60, 33, 30, 20, 7, 3, 40])
    home, window, tier = pack.pack_sizes(sizes, 100)
    assert tier[window[0]] == 0 and home[6] == home[0] == window[0]  # 60 + 40 fill one window of 100
    assert len(np.unique(home)) == 2 and set(tier[window[1:]]) >= {1}


def test_numbers_are_unique_over_shards_and_turns(spark, monkeypatch):
    monkeypatch.setattr(pack, "PACK_ROWS", 20)
    sizes = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 90 + 1).alias("size"))
    pieces = pack.pack_documents(sizes, [(1, 100), (2, 300)], per_step=4, shard_rows=200)
    steps = pieces.groupBy("spec_id", "step").agg(F.countDistinct("container").alias("n")).agg(F.max("n")).first()[0]
    assert steps <= 4
    assert pieces.groupBy("spec_id", "container").agg(F.countDistinct("step").alias("n"), F.sum("length").alias("u"), F.first("capacity").alias("c")).filter("n > 1 OR u > c").count() == 0


def test_pieces_cover_every_text(spark):
    docs = [(1, 1), (2, 250), (3, 100), (4, 101), (5, 40), (5, 40), (None, 7)]
    pieces = pack.pack_documents(spark.createDataFrame(docs, "doc_id bigint, size bigint"), [(1, 100), (2, 300)]).collect()
    for spec, capacity in ((1, 100), (2, 300)):
        own = [p for p in pieces if p["spec_id"] == spec]
        total = Counter()
        for p in own:
            total[p["doc_id"]] += p["length"]
        assert total == Counter({1: 1, 2: 250, 3: 100, 4: 101, 5: 80, None: 7})
        box = Counter()
        for p in own:
            box[p["container"]] += p["length"]
        assert max(box.values()) <= capacity
        assert {p["doc_id"] for p in own if p["n_pieces"] > 1} == {d for d, s in docs if s > capacity}
        assert all(p["n_pieces"] == -(-dict(docs)[p["doc_id"]] // capacity) for p in own)
    assert pack.pack_documents(spark.createDataFrame([], "doc_id bigint, size bigint"), [(1, 100)]).count() == 0
    with pytest.raises(ValueError):
        pack.pack_documents(spark.createDataFrame(docs, "doc_id bigint, size bigint"), [(1, 0)])
    with pytest.raises(ValueError):
        pack.stated_specs(spark.range(5).selectExpr("int(id) spec_id", "10 capacity"), most=4)
    sizes = spark.createDataFrame([("é",), ("",), (None,)], "text string").select(pack.byt5_size(F.col("text")).alias("s")).collect()
    assert [r["s"] for r in sizes] == [3, 1, None]


def test_long_shards_pack_in_turns(spark, monkeypatch):
    monkeypatch.setattr(pack, "PACK_ROWS", 50)
    sizes = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 90 + 1).alias("size"))
    pieces = pack.pack_documents(sizes, [(1, 100)], shard_rows=1000)
    assert pieces.groupBy("container").agg(F.sum("length").alias("u")).agg(F.max("u")).first()[0] <= 100
    assert pieces.select("doc_id").distinct().count() == 1000
    assert pack.packing_report(pieces).first()["fill"] > 0.9


def blobs(seed, step=0.12, sizes=(1, 2, 5, 40)):
    rng = np.random.default_rng(seed)
    rows, sid, truth = [], 0, {}
    for k in range(60):
        centre, label = np.array([k % 8, k // 8]) * step + rng.random(2) * step / 4, int(rng.integers(1, 3))
        n = int(rng.choice(sizes))
        pts = (centre + rng.random((n, 2)) * 0.0035).round(5)
        for p in pts:
            rows.append((sid, float(p[0]), float(p[1]), label))
            sid += 1
    return rows


def components(rows, reach=0.0045):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[3] == b[3] and abs(a[1] - b[1]) <= reach and abs(a[2] - b[2]) <= reach:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(rows[find(i)][0], rows[i][0]) for i in range(len(rows)) if find(i) != i}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_against_brute_force(spark, seed):
    rows = blobs(seed)
    dirty = rows + rows[:10] + [(9001, None, 0.5, 1), (9002, float("nan"), 0.5, 1), (9003, 0.5, 0.5, -1), (9004, 0.5, 0.5, None), (None, 0.5, 0.5, 1)]
    df = spark.createDataFrame(dirty, "sid bigint, c0 double, c1 double, c2 int")
    points = cluster.labelled_points(df)
    found = cluster.cluster_records(points).cache()
    assert {tuple(r) for r in cluster.members(found).collect()} == components(rows)
    told = cluster.describe(found).collect()
    assert sum(r["size"] for r in told) == len(rows) and all(1 <= len(r["typical"]) <= 3 for r in told)
    density = {r["record"]: (r["first"], r["density"]) for r in found.collect()}
    for r in told:
        own = sorted(((-x, k) for k, (f, x) in density.items() if f == r["first"]))
        assert r["typical"] == [k for _, k in own[:3]]
    assert tuple(cluster.audit(cluster.cluster_cells(points)).first()) == (len(told), 0, 0)


def test_the_mixture_decides(monkeypatch):
    """With one component, or components at random places, other clusters come out."""
    rng, reach = np.random.default_rng(3), 0.0045
    x = np.concatenate([np.array([k % 3, k // 3]) * 0.02 + 0.003 + rng.random((30, 2)) * 0.0035 for k in range(9)])
    truth = np.repeat(np.arange(9), 30)
    cells, own = np.unique(np.floor(x / (reach / cluster.FINE)).astype(np.int64), axis=0, return_inverse=True)
    weight = np.bincount(own).astype(float)
    mid = np.column_stack([np.bincount(own, x[:, j]) / weight for j in (0, 1)])
    inner = np.empty((len(mid), 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            inner[:, i, j] = np.bincount(own, x[:, i] * x[:, j]) / weight - mid[:, i] * mid[:, j]
    project = np.diag(1 / x.std(0))

    def rows():
        zero = np.zeros(len(mid), np.int64)
        made = cluster.fit_cells(zero, np.zeros((len(mid), 2), np.int64), cells, weight, mid, inner, reach, x.mean(0), project, project @ np.diag([(reach / 8) ** 2] * 2) @ project.T)
        part = made["p"][own]
        first = {p: k for k, p in reversed(list(enumerate(part)))}
        return {(first[p], k) for k, p in enumerate(part) if first[p] != k}

    want = {(t * 30, t * 30 + k) for t in range(9) for k in range(1, 30)}
    assert rows() == want and len(truth) == len(x)
    choose = cluster.Mixtures.choose

    def one(self, seeds, home, turn):
        return choose(self, seeds[turn == 0], home[turn == 0], turn[turn == 0])

    def elsewhere(self, seeds, home, turn):
        return choose(self, seeds + rng.normal(0, 1, seeds.shape), home, turn)

    for ruined in (one, elsewhere):
        monkeypatch.setattr(cluster.Mixtures, "choose", ruined)
        assert len(rows() & want) < 0.9 * len(want)


def test_audit_tells_what_does_not_fit(spark):
    """A chain far wider than the reach is no clean cluster."""
    rows = [(i, 0.2 + i * 0.002, 0.5, 1) for i in range(120)] + [(500, 0.9, 0.9, 1), (501, 0.9, 0.9, 2)]
    df = spark.createDataFrame(rows, "sid bigint, c0 double, c1 double, c2 int")
    points = cluster.labelled_points(df)
    told = cluster.audit(cluster.cluster_cells(points)).first()
    assert told["wide"] + told["near"] > 0
    assert cluster.cluster_records(points).count() == len(rows)


def test_mixtures_of_many_blocks_equal_those_of_one():
    rng = np.random.default_rng(5)
    blocks = [(rng.normal(0, 1, (n, 2)), rng.integers(1, 5, n).astype(float)) for n in (3, 40, 1, 17)]
    ridge = np.eye(2) * 1e-3

    def run(parts):
        block = np.repeat(np.arange(len(parts)), [len(z) for z, _ in parts])
        z, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        m = cluster.Mixtures(block, z, w, np.zeros((len(z), 2, 2)), ridge)
        at = np.concatenate([np.flatnonzero(block == b)[:5] for b in range(len(parts))])
        turn = np.arange(len(at)) - np.searchsorted(block[at], block[at], "left")
        made = m.choose(z[at], block[at], turn)
        return [made[2][made[0] == b] + m.centre[b] for b in range(len(parts))]

    for whole, single in zip(run(blocks), [run([b])[0] for b in blocks]):
        assert whole.shape == single.shape and np.allclose(whole, single)


def test_no_points(spark):
    df = spark.createDataFrame([], "sid bigint, c0 double, c1 double, c2 int")
    found = cluster.cluster_records(cluster.labelled_points(df))
    assert found.count() == 0 and cluster.describe(found).count() == 0
