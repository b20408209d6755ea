"""Queries of preparation, scoring, pruning, sampling, ensembles, fitting, editing, search and streaming."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfold.lineage import cut
from boxfold.operators import dictionary, edit, ensemble, granular, prepare, prune, score, tune
from boxfold.operators import fit as fitting
from boxfold.plans import inputs
from boxfold.plans.inputs import HI, LO, L, U, V, W, table, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODEL = "onln_gfmm"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Preparation -------------------------------------------------------------------------------------------------------

_NUM = ["c1", "c2", "c7", "c10", "c13", "c14"]
_scaled = ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 9) AS {c}" for c in _NUM)
_real = ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in _NUM)


@query(f"SELECT sid, seq, {_scaled} FROM (SELECT sid, seq, {_real} FROM japanese_credit)")
def prep_minmax(spark, d):
    scaled = prepare.scale_unit(table(spark, d, "japanese_credit").select("sid", "seq", *_NUM), _NUM)
    return scaled.select("sid", "seq", *[F.round(c, 9).alias(c) for c in _NUM])


@query(with_(inputs.POINTS) + "SELECT sid, l0, l1, u0, u1, y FROM s")
def prep_missing_zero_one(spark, d):
    (l0, l1), (u0, u1) = inputs.bounds()
    return inputs.points(spark, d).select("sid", l0.alias("l0"), l1.alias("l1"), u0.alias("u0"), u1.alias("u1"), "y")


@query("SELECT bool_or(c0 IS NULL OR isnan(c0) OR c1 IS NULL OR isnan(c1)) AS has_missing FROM syn_num_test")
def prep_has_missing(spark, d):
    return prepare.has_missing(table(spark, d, "syn_num_test"), ["c0", "c1"])


@query("SELECT sid, seq, coalesce(c2, -1) AS y FROM syn_num_test")
def prep_labels(spark, d):
    return table(spark, d, "syn_num_test").select("sid", "seq", prepare.label(F.col("c2")).alias("y"))


@query(with_(inputs.CODES) + "SELECT sid, coalesce(k0, 100000)::INT AS k0, coalesce(k1, 100000)::INT AS k1 FROM coded")
def prep_ordinal_encode(spark, d):
    return inputs.coded_records(spark, d).select("sid", F.coalesce("k0", F.lit(100000)).alias("k0"), F.coalesce("k1", F.lit(100000)).alias("k1"))


@query(with_(inputs.CODES) + "SELECT sid, CASE WHEN k0 IS NULL THEN 0 ELSE 1::BIGINT << k0 END AS b0, CASE WHEN k1 IS NULL THEN 0 ELSE 1::BIGINT << k1 END AS b1 FROM coded")
def prep_onehot_bits(spark, d):
    t = table(spark, d, "japanese_credit").groupBy("sid").agg(F.first("c4").alias("c4"), F.first("c6").alias("c6"))
    words = dictionary.build(table(spark, d, "japanese_credit").select("c4", "c6"), ["c4", "c6"])
    return dictionary.one_hot(t, ["c4", "c6"], words).select("sid", F.col("c4").alias("b0"), F.col("c6").alias("b1"))


@query(with_(inputs.CODES, """
v AS (SELECT 0 AS feature, k0 AS a, y FROM coded WHERE k0 IS NOT NULL UNION ALL SELECT 1, k1, y FROM coded WHERE k1 IS NOT NULL),
n AS (SELECT feature, a, y, count(*) AS n FROM v GROUP BY 1, 2, 3),
q AS (SELECT feature, a, y, n / sum(n) OVER (PARTITION BY feature, a) AS p FROM n),
k AS (SELECT DISTINCT feature, a FROM q),
g AS (SELECT x.feature, x.a, z.a AS b, sqrt(sum(pow(coalesce(qa.p, 0) - coalesce(qb.p, 0), 2))) AS d
      FROM k x JOIN k z ON x.feature = z.feature AND x.a <= z.a CROSS JOIN (SELECT DISTINCT y FROM v) c
      LEFT JOIN q qa ON qa.feature = x.feature AND qa.a = x.a AND qa.y = c.y LEFT JOIN q qb ON qb.feature = x.feature AND qb.a = z.a AND qb.y = c.y GROUP BY 1, 2, 3)""")
    + "SELECT feature, a::INT AS a, b::INT AS b, round(CASE WHEN (SELECT count(*) FROM k WHERE k.feature = g.feature) <= 2 THEN CASE WHEN a = b THEN 0.0 ELSE 1.0 END ELSE d / max(d) OVER (PARTITION BY feature) END, 9) AS dist FROM g")
def prep_category_distance(spark, d):
    return prepare.category_distances(inputs.coded_records(spark, d), ["k0", "k1"], "y").select("feature", "a", "b", F.round("dist", 9).alias("dist"))


_GRID = f"g AS (SELECT y AS c, g0, g1, min(x0) AS v0, min(x1) AS v1, max(x0) AS w0, max(x1) AS w1, count(*) AS n FROM (SELECT y, x0, x1, floor(x0 * 4) AS g0, floor(x1 * 4) AS g1 FROM (SELECT y, least(1.0, greatest(0.0, x0)) AS x0, least(1.0, greatest(0.0, x1)) AS x1 FROM p WHERE y > 0 AND x0 IS NOT NULL AND x1 IS NOT NULL)) GROUP BY 1, 2, 3)"


def grid_boxes(spark: SparkSession, d: str, cells: int = 4) -> DataFrame:
    """Boxes without training: extents of each class in each cell of a grid of the unit square, values outside it set on its border."""
    p = inputs.whole_samples(spark, d).select("y", F.col("xl")[0].alias("x0"), F.col("xl")[1].alias("x1"))
    cell = [F.floor(F.col(f"x{j}") * cells).alias(f"g{j}") for j in (0, 1)]
    return p.select("y", "x0", "x1", *cell).groupBy(F.col("y").alias("c"), "g0", "g1").agg(*[f(f"x{j}").alias(f"{n}{j}") for n, f in (("v", F.min), ("w", F.max)) for j in (0, 1)], F.count(F.lit(1)).alias("n"))


@query(with_(inputs.POINTS, _GRID) + "SELECT c, g0::BIGINT AS g0, g1::BIGINT AS g1, v0, v1, w0, w1, n FROM g")
def boxes_from_grid(spark, d):
    return grid_boxes(spark, d)


def grid_model(spark: SparkSession, d: str, cells: int = 4) -> DataFrame:
    g = grid_boxes(spark, d, cells)
    return g.select((F.col("c") * 10_000 + F.col("g0") * 100 + F.col("g1")).cast("bigint").alias("box_id"), F.array("v0", "v1").alias("v"), F.array("w0", "w1").alias("w"), "c", F.col("n").cast("double").alias("n_samples"))


# Scoring -----------------------------------------------------------------------------------------------------------


def _winner_sql(source: str, member: str, dist: str, model: str = MODEL, more: str = "") -> str:
    """Class of the box of greatest membership, between classes by distance, then box_id."""
    return with_(inputs.POINTS, f"""
m AS (SELECT sid, box_id, c, n, {member} AS m, {dist} AS dist FROM {source} JOIN b ON b.model_id = '{model}'),
t AS (SELECT *, max(m) OVER (PARTITION BY sid) AS top FROM m),
k AS (SELECT *, min(c) OVER (PARTITION BY sid) <> max(c) OVER (PARTITION BY sid) AS torn FROM t WHERE m = top),
o AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY CASE WHEN torn THEN dist ELSE 0 END{more}, box_id) AS place FROM k)""")


_L1 = inputs.manhattan_present(L, U, V, W)
_PREDICTED = "SELECT sid, c AS y_pred, box_id, round(top, 9) AS membership FROM o WHERE place = 1"


def _rounded(predicted: DataFrame) -> DataFrame:
    return predicted.select("sid", "y_pred", "box_id", F.round("membership", 9).alias("membership"))


@query(_winner_sql("s", inputs.gfmm(L, U, LO, HI), _L1) + _PREDICTED)
def predict_manhattan(spark, d):
    return _rounded(score.predict(inputs.samples(spark, d), inputs.boxes(spark, d, MODEL), 2))


@query(_winner_sql("s", inputs.gfmm(L, U, LO, HI, [4.0, 2.0]), _L1) + _PREDICTED)
def predict_gamma_vector(spark, d):
    return _rounded(score.predict(inputs.samples(spark, d), inputs.boxes(spark, d, MODEL), 2, gamma=[4.0, 2.0]))


@query(_winner_sql("s", inputs.free_range(L, U, LO, HI), _L1) + _PREDICTED)
def predict_free_range(spark, d):
    return _rounded(score.predict(inputs.samples(spark, d), inputs.boxes(spark, d, MODEL), 2, kind="free"))


_POINT = "(SELECT * FROM s WHERE x0 IS NOT NULL AND x1 IS NOT NULL)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return inputs.samples(spark, d).filter(F.col("xl")[0].isNotNull() & F.col("xl")[1].isNotNull())


@query(_winner_sql(_POINT, inputs.fmnn(["x0", "x1"], V, W), _L1) + _PREDICTED)
def predict_fmnn(spark, d):
    return _rounded(score.predict(_points(spark, d), inputs.boxes(spark, d, MODEL), 2, kind="fmnn"))


@query(_winner_sql(_POINT, inputs.fmnn(["x0", "x1"], V, W), "(abs(x0 - v0) + abs(x0 - w0) + (abs(x1 - v1) + abs(x1 - w1))) / 4") + _PREDICTED)
def predict_rfmnn(spark, d):
    return _rounded(score.predict(_points(spark, d), inputs.boxes(spark, d, MODEL), 2, kind="fmnn", rule="corners"))


_MID = ["(l0 + u0) / 2", "(l1 + u1) / 2"]
_CENTRE = ["coalesce(m0, (v0 + w0) / 2)", "coalesce(m1, (v1 + w1) / 2)"]


@query(_winner_sql("s", inputs.gfmm(L, U, LO, HI), f"sqrt(({_CENTRE[0]} - {_MID[0]}) * ({_CENTRE[0]} - {_MID[0]}) + ({_CENTRE[1]} - {_MID[1]}) * ({_CENTRE[1]} - {_MID[1]}))", "multi_gran", ", CASE WHEN torn THEN -coalesce(n, 1) ELSE 0 END") + _PREDICTED)
def predict_centroid(spark, d):
    return _rounded(score.predict(inputs.samples(spark, d), inputs.boxes(spark, d, "multi_gran"), 2, rule="centroid"))


_CHOSEN = ", ".join(str(random.Random(0).choice(range(n)) + 1) for n in range(1, 151))


@query(with_(inputs.POINTS, f"""
m AS (SELECT sid, box_id, c, coalesce(n, 1) AS n, {inputs.gfmm(L, U, LO, HI)} AS m FROM s JOIN b ON b.model_id = 'iol_gfmm'),
k AS (SELECT * FROM (SELECT *, max(m) OVER (PARTITION BY sid) AS top FROM m) WHERE m = top),
g AS (SELECT sid, top, count(DISTINCT c) AS classes, count(*) FILTER (n = 1) AS singles, list(c ORDER BY box_id) FILTER (n = 1) AS single_c, min(c) AS one_c FROM k GROUP BY 1, 2),
w AS (SELECT sid, c, sum(m * n) AS mass, sum(n) AS n, row_number() OVER (PARTITION BY sid ORDER BY sum(m * n) DESC, sum(n) DESC, c) AS place FROM k GROUP BY 1, 2)""")
    + f"SELECT sid, CASE WHEN classes = 1 THEN one_c WHEN top = 1 AND singles > 0 THEN single_c[([{_CHOSEN}])[singles]] ELSE w.c END AS y_pred FROM g JOIN w USING (sid) WHERE place = 1")
def predict_probability(spark, d):
    return score.predict_probability(inputs.samples(spark, d), inputs.boxes(spark, d, "iol_gfmm"), 2)


_PER_CLASS = with_(inputs.POINTS, f"m AS (SELECT sid, box_id, c, {inputs.gfmm(L, U, LO, HI)} AS m FROM s JOIN b ON b.model_id = '{MODEL}'), k AS (SELECT sid, c, max(m) AS m, arg_max(box_id, (m, -box_id)) AS box_id FROM m GROUP BY 1, 2)")


@query(_PER_CLASS + "SELECT sid, c, round(m, 9) AS membership, box_id FROM k")
def membership_per_class(spark, d):
    return score.class_memberships(inputs.samples(spark, d), inputs.boxes(spark, d, MODEL), 2).select("sid", "c", F.round("membership", 9).alias("membership"), "box_id")


@query(_PER_CLASS + "SELECT sid, c, round(CASE WHEN sum(m) OVER (PARTITION BY sid) = 0 THEN m ELSE m / sum(m) OVER (PARTITION BY sid) END, 6) AS proba FROM k")
def predict_proba_gfmm(spark, d):
    return score.class_probabilities(score.class_memberships(inputs.samples(spark, d), inputs.boxes(spark, d, MODEL), 2)).select("sid", "c", F.round("proba", 6).alias("proba"))


@query(_winner_sql("s", inputs.gfmm(L, U, LO, HI), _L1) + "SELECT q.sid, o.c AS y_pred, q.c, round(q.m, 9) AS membership, b.v0, b.w0 FROM (SELECT sid, c, max(m) AS m, arg_max(box_id, (m, -box_id)) AS box_id FROM m GROUP BY 1, 2) q JOIN o ON o.sid = q.sid AND place = 1 JOIN b ON b.box_id = q.box_id")
def explain_samples(spark, d):
    e = score.explain(inputs.samples(spark, d), inputs.boxes(spark, d, MODEL), 2)
    return e.select("sid", "y_pred", "c", F.round("membership", 9).alias("membership"), F.get("v", F.lit(0)).alias("v0"), F.get("w", F.lit(0)).alias("w0"))


@query(with_(inputs.POINTS, f"""
g AS (SELECT i * 100 + j AS sid, i / 99.0::DOUBLE AS x0, j / 99.0::DOUBLE AS x1 FROM range(100) a(i), range(100) z(j)),
m AS (SELECT sid, box_id, c, {inputs.gfmm(['x0', 'x1'], ['x0', 'x1'], LO, HI)} AS m, {inputs.manhattan_present(['x0', 'x1'], ['x0', 'x1'], V, W)} AS dist FROM g JOIN b ON model_id = '{MODEL}'),
t AS (SELECT *, max(m) OVER (PARTITION BY sid) AS top FROM m),
k AS (SELECT *, min(c) OVER (PARTITION BY sid) <> max(c) OVER (PARTITION BY sid) AS torn FROM t WHERE m = top)""") + "SELECT sid, arg_min(c, (CASE WHEN torn THEN dist ELSE 0 END, box_id)) AS y_pred FROM k GROUP BY 1")
def boundary_grid_predict(spark, d):
    """Classes over a regular 100 x 100 grid of the unit square."""
    i = spark.range(10_000)
    x = F.array(F.floor(F.col("id") / 100) / 99.0, (F.col("id") % 100) / 99.0)
    return score.predict(i.select(F.col("id").alias("sid"), x.alias("xl"), x.alias("xu")), inputs.boxes(spark, d, MODEL), 2).select("sid", "y_pred")


# Pruning and box relations -----------------------------------------------------------------------------------------

_ATTRIBUTED = _winner_sql("(SELECT * FROM s WHERE y > 0)", inputs.gfmm(L, U, LO, HI), _L1).replace("CASE WHEN torn THEN dist ELSE 0 END", "CASE WHEN several THEN dist ELSE 0 END").replace("AS torn FROM t", "AS torn, count(*) OVER (PARTITION BY sid) > 1 AS several FROM t").rstrip()
_CONFUSION = _ATTRIBUTED + """,
h AS (SELECT box_id, count(*) FILTER (o.c = s.y) AS r, count(*) FILTER (o.c <> s.y) AS x FROM o JOIN s USING (sid) WHERE place = 1 GROUP BY 1),
f AS (SELECT b.box_id, b.c, coalesce(r, 0) AS r, coalesce(x, 0) AS x FROM b LEFT JOIN h USING (box_id) WHERE model_id = 'onln_gfmm')
"""


@query(_CONFUSION + "SELECT box_id, r AS \"right\", x AS wrong FROM f")
def box_confusion(spark, d):
    return prune.box_confusion(inputs.labelled(spark, d), inputs.boxes(spark, d, MODEL), 2)


@query(_CONFUSION + "SELECT box_id FROM f WHERE r + x = 0 OR r / (r + x) >= 0.5")
def prune_keep_empty(spark, d):
    return prune.prune(inputs.labelled(spark, d), inputs.boxes(spark, d, MODEL), 2, keep_empty=True).select("box_id")


_INSIDE = f"i AS (SELECT a_id, b_id FROM ab WHERE ca = cb AND {inputs.gfmm(['a0', 'a1'], ['b0', 'b1'], ['c0', 'c1'], ['d0', 'd1'])} = 1 AND (NOT {inputs.gfmm(['c0', 'c1'], ['d0', 'd1'], ['a0', 'a1'], ['b0', 'b1'])} = 1 OR b_id < a_id))"


@query(with_(inputs.POINTS, _INSIDE) + "SELECT model_id, box_id FROM b WHERE box_id NOT IN (SELECT a_id FROM i)")
def uncontained_boxes(spark, d):
    return prune.uncontained(inputs.boxes(spark, d), 2, keys=["model_id"]).select("model_id", "box_id")


@query(with_(inputs.POINTS) + f"SELECT DISTINCT a_id AS box_id FROM ab WHERE (ca <> cb OR ca = -1) AND {inputs.gfmm(['b0', 'b1'], ['a0', 'a1'], ['c0', 'c1'], ['d0', 'd1'])} = 1")
def overlap_one_many(spark, d):
    """Boxes that meet any box of another class."""
    return prune.overlap_pairs(inputs.boxes(spark, d), 2, keys=["model_id"]).select(F.col("a_id").alias("box_id")).distinct()


# Ensembles ---------------------------------------------------------------------------------------------------------

_VOTES = with_(inputs.POINTS, f"""
m AS (SELECT sid, level, box_id, c, {inputs.gfmm(L, U, LO, HI)} AS m, {_L1} AS dist FROM s JOIN b ON b.model_id = '{MODEL}'),
t AS (SELECT *, max(m) OVER (PARTITION BY sid, level) AS top FROM m),
k AS (SELECT *, min(c) OVER (PARTITION BY sid, level) <> max(c) OVER (PARTITION BY sid, level) AS torn FROM t WHERE m = top),
o AS (SELECT sid, level, arg_min(c, (CASE WHEN torn THEN dist ELSE 0 END, box_id)) AS c FROM k GROUP BY 1, 2)""")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """The levels of a model as members of an ensemble."""
    return inputs.boxes(spark, d, MODEL).withColumn("member_id", F.col("level"))


@query(_VOTES + "SELECT sid, arg_max(c, (n, -c)) AS y_pred FROM (SELECT sid, c, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1")
def vote_majority(spark, d):
    return ensemble.majority(ensemble.member_predictions(inputs.samples(spark, d), _members(spark, d), 2))


@query(with_(inputs.POINTS, f"m AS (SELECT sid, level, c, max({inputs.gfmm(L, U, LO, HI)}) AS m FROM s JOIN b ON b.model_id = '{MODEL}' GROUP BY 1, 2, 3)") + f"SELECT sid, c, round(sum(m) / (SELECT count(DISTINCT level) FROM b WHERE model_id = '{MODEL}'), 9) AS membership FROM m GROUP BY 1, 2")
def mean_membership(spark, d):
    return ensemble.mean_memberships(inputs.samples(spark, d), _members(spark, d), 2).select("sid", "c", F.round("membership", 9).alias("membership"))


@query(_VOTES.replace(f"b.model_id = '{MODEL}'", "b.model_id = 'multi_gran'").replace(_L1, f"sqrt(({_CENTRE[0]} - {_MID[0]}) * ({_CENTRE[0]} - {_MID[0]}) + ({_CENTRE[1]} - {_MID[1]}) * ({_CENTRE[1]} - {_MID[1]}))").replace("box_id, c, least(", "box_id, c, coalesce(n, 1) AS n, least(").replace("CASE WHEN torn THEN dist ELSE 0 END, box_id", "CASE WHEN torn THEN dist ELSE 0 END, CASE WHEN torn THEN -n ELSE 0 END, box_id")
       + "SELECT sid, arg_max(c, (n, -c)) AS y_pred FROM (SELECT sid, c, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1")
def granular_level_vote(spark, d):
    return granular.predict(inputs.samples(spark, d), inputs.boxes(spark, d, "multi_gran"), 2)


@query("SELECT model_id, level, count(*) AS n_boxes FROM hyperbox GROUP BY 1, 2")
def count_boxes(spark, d):
    return ensemble.n_boxes(table(spark, d, "hyperbox"), ["model_id", "level"])


_FEATURES = [f"c{j}" for j in range(15)]


@query("SELECT j.sid, m.member_id, list_transform(m.features, lambda f: ([" + ", ".join(f"CAST({c} AS VARCHAR)" if c in ("c0", "c3", "c4", "c5", "c6", "c8", "c9", "c11", "c12") else f"CAST({c} IS NULL AS VARCHAR)" for c in _FEATURES) + "])[f + 1]) AS picked FROM (SELECT DISTINCT sid, " + ", ".join(_FEATURES) + " FROM japanese_credit) j, ensemble_member m")
def member_projection(spark, d):
    """Every record once per member, with the member's features only (texts, and whether numbers are missing)."""
    texts = ("c0", "c3", "c4", "c5", "c6", "c8", "c9", "c11", "c12")
    t = table(spark, d, "japanese_credit").groupBy("sid").agg(*[F.first(c).alias(c) for c in _FEATURES])
    values = F.array(*[F.col(c) if c in texts else F.col(c).isNull().cast("string") for c in _FEATURES])
    members = table(spark, d, "ensemble_member").select("member_id", "features")
    copies = prepare.per_member(t.select("sid", values.alias("x")), members)
    return copies.join(F.broadcast(members), "member_id").select("sid", "member_id", F.transform("features", lambda f: F.get("x", f)).alias("picked"))


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return inputs.labelled(spark, d), table(spark, d, "ensemble_member")


_MEMBERS = "m AS (SELECT member_id FROM ensemble_member), k AS (SELECT y, count(*) AS n FROM s WHERE y > 0 GROUP BY 1)"


def _sizes(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("member_id", "y").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sid").alias("records"))


@query(with_(inputs.POINTS, _MEMBERS) + "SELECT member_id, y, n, n AS records FROM (SELECT member_id, y, least((SELECT min(n) FROM k), floor((SELECT sum(n) FROM k) * 0.5 / (SELECT count(*) FROM k)))::BIGINT AS n FROM m, k) WHERE n > 0")
def sample_balanced(spark, d):
    """Rows and records drawn per member and class."""
    s, m = _drawn(spark, d)
    return _sizes(prepare.draw_balanced(prepare.per_member(s, m), "sid", "y", 0.5))


@query(with_(inputs.POINTS, _MEMBERS) + "SELECT member_id, y, n, n AS records FROM (SELECT member_id, y, floor(n * 0.5 + 0.5)::BIGINT AS n FROM m, k) WHERE n > 0")
def sample_stratified(spark, d):
    s, m = _drawn(spark, d)
    return _sizes(prepare.draw_stratified(prepare.per_member(s, m), "sid", "y", 0.5))


@query(with_(inputs.POINTS, _MEMBERS) + "SELECT member_id, n, n AS records FROM m, (SELECT floor(sum(n) * 0.5)::BIGINT AS n FROM k)")
def sample_rows(spark, d):
    s, m = _drawn(spark, d)
    return prepare.draw_rate(prepare.per_member(s, m), "sid", 0.5).groupBy("member_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sid").alias("records"))


@query()
def sample_bootstrap(spark, d):
    s, m = _drawn(spark, d)
    return prepare.draw_rate(prepare.per_member(s, m), "sid", 0.5, bootstrap=True).select("member_id", "sid", "n_samples")


@query(with_(inputs.POINTS) + "SELECT y, fold, n FROM (SELECT y, fold::INT AS fold, (count(*) - fold + 4) // 5 AS n FROM s, range(5) f(fold) WHERE y > 0 GROUP BY y, fold) WHERE n > 0")
def stratified_fold_sizes(spark, d):
    """Rows of each class in each of five folds."""
    return prepare.stratified_folds(inputs.labelled(spark, d), "sid", "y", 5).groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))


# Fitting mixed models: in parts of bounded size over whole tables ----------------------------------------------------


@query()
def fit_freqcat(spark, d):
    s = inputs.mixed_training(spark, d, "freqcat")
    gaps: list[dict] = [{}, {}]
    for r in prepare.category_distances(s.select("y", F.col("cat")[0].alias("k0"), F.col("cat")[1].alias("k1")), ["k0", "k1"], "y").limit(1_000_001).collect():  # pairs of codes of two features
        gaps[r["feature"]][r["a"], r["b"]] = r["dist"]
    if sum(map(len, gaps)) > 1_000_000:
        raise ValueError("more than 1,000,000 pairs of codes; give rare values one name first")
    return fitting.partitioned(s, "freqcat", 500, theta=0.3, theta_min=0.3, eta=0.6, distance=gaps)


def _bag_members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cut(inputs.whole_samples(spark, d)), table(spark, d, "ensemble_member")


#: Share of the rows that every member learns, whatever their number.
MAX_SAMPLES = 0.5


@query()
def fit_bagging_vote(spark, d):
    s, m = _bag_members(spark, d)
    boxes = cut(ensemble.bag(s, m, "improved", MAX_SAMPLES, part_rows=ensemble.PART_ROWS, theta=0.1))
    return ensemble.majority(ensemble.member_predictions(s, boxes, 2))


@query()
def fit_random_boxes(spark, d):
    s, m = _bag_members(spark, d)
    m = cut(ensemble.draw_features(m.select("member_id"), 2, None, balanced=True))
    boxes = cut(ensemble.random_boxes(s, m, "improved", MAX_SAMPLES, part_rows=ensemble.PART_ROWS, theta=0.1))
    return ensemble.vote(s, boxes, 2, m)


@query()
def fit_model_merge(spark, d):
    s, m = _bag_members(spark, d)
    boxes = cut(ensemble.bag(s, m, "improved", MAX_SAMPLES, bootstrap=True, part_rows=ensemble.PART_ROWS, theta=0.2))
    return granular.merge_members(boxes, "improved", 0.2)


def _tuning_parts(spark: SparkSession, d: str) -> DataFrame:
    s = inputs.whole_samples(spark, d)
    return s.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(fitting.parts_for(s, 1_500))).cast("int"))


@query()
def tune_random_search(spark, d):
    space = {"theta": [0.05, 0.1, 0.2, 0.3], "gamma": [1.0, 2.0]}
    scores = tune.cross_validate(_tuning_parts(spark, d), "improved", tune.sample_grid(space, 5), k=3, by=["part"])
    return scores.groupBy("candidate").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.sum("folds").alias("folds"))


_CANDIDATES = [{"theta": 0.1}, {"theta": 0.2}]


def _tuned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, m = _bag_members(spark, d)
    drawn = ensemble.draw(s, m, MAX_SAMPLES)
    return s, tune.tuned_members(drawn, "improved", _CANDIDATES, k=3, part_rows=ensemble.PART_ROWS)


@query()
def tune_members(spark, d):
    return _tuned(spark, d)[1]


@query()
def vote_tuned_members(spark, d):
    """Majority of members that each use their own best parameters."""
    s, boxes = _tuned(spark, d)
    return ensemble.vote(s, cut(boxes), 2)


@query()
def merge_tuned_members(spark, d):
    """One model over the boxes of tuned members."""
    return granular.merge_members(cut(_tuned(spark, d)[1]), "improved", 0.2)


@query()
def tune_random_boxes(spark, d):
    """Majority of tuned members that each have their own features."""
    s, m = _bag_members(spark, d)
    m = cut(ensemble.draw_features(m.select("member_id"), 2, None, balanced=True))
    boxes = cut(tune.tuned_random_boxes(s, m, "improved", _CANDIDATES, MAX_SAMPLES, k=3, part_rows=ensemble.PART_ROWS))
    return ensemble.vote(s, boxes, 2, m)


@query()
def tune_ensemble(spark, d):
    """Search over an ensemble's parameters and its members' own, in parts over the whole table."""
    space = {"n_estimators": [3, 5], "max_samples": [0.5], "base_estimator__theta": [0.1, 0.2]}
    scores = tune.cross_validate_ensemble(_tuning_parts(spark, d), "improved", tune.grid(space), k=3, by=["part"])
    return scores.groupBy("candidate").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.sum("folds").alias("folds"))


@query()
def tune_mixed(spark, d):
    """Search over a mixed learner's parameters, in parts over the whole table."""
    s = cut(inputs.mixed_training(spark, d, "eiol"))
    s = s.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(fitting.parts_for(s, 500))).cast("int"))
    scores = tune.cross_validate(s, "eiol", [{"theta": 0.3, "delta": 0.4}, {"theta": 0.5, "delta": 0.8, "alpha": 0.7}], k=2, by=["part"])
    return scores.groupBy("candidate").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.sum("folds").alias("folds"))


@query()
def fit_merged(spark, d):
    """Models of parts, made one."""
    return granular.merge_parts(cut(fitting.partitioned(inputs.whole_samples(spark, d), "improved", 1_000, theta=0.1)), 0.1)


@query()
def fit_granular_pruned(spark, d):
    """Levels learnt from first boxes that validation samples have pruned."""
    s = cut(inputs.whole_samples(spark, d))
    return granular.fit(s, (0.1, 0.2), n_partitions=fitting.parts_for(s, 4_000), validation=s, d=2)


#: Rows of one part of two-fold editing, about; up to so many rows are one part.
EDIT_ROWS = 50_000


#: Rows of one part of leave-one-out editing, and rows on either side of it that are learnt from only.
LEFT_OUT_ROWS, LEFT_OUT_RIM = 60, 30


def _edit_parts(spark: SparkSession, d: str) -> list[DataFrame]:
    """All rows, dealt class by class to parts."""
    s = cut(inputs.whole_samples(spark, d))
    return [prepare.stratified_folds(s, "sid", "y", fitting.parts_for(s, EDIT_ROWS), name="part")]


@query()
def edit_two_fold(spark, d):
    (s,) = _edit_parts(spark, d)
    return edit.two_fold(s, "improved", n_iters=3, n_last_iters=2, by="part", theta=0.1).select("sid", "y")


@query()
def edit_two_fold_prob(spark, d):
    (s,) = _edit_parts(spark, d)
    return edit.two_fold_probability(s, "improved", n_iters=3, min_remained_prob=0.5, by="part", theta=0.1).select("sid", "y")


@query()
def edit_leave_one_out(spark, d):
    s = cut(edit.local_parts(inputs.whole_samples(spark, d), LEFT_OUT_ROWS, LEFT_OUT_RIM, 2))
    return edit.leave_one_out(s, "improved", by="part", own="own", n_iters=1, theta=0.1).select("sid", "y")
