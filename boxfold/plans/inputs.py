"""Samples and boxes of the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfold.functions.membership import elements
from boxfold.operators import dictionary, prepare, prune

#: The model that the scalar operators are asked about.
RECORD_MODEL = "onln_gfmm"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """(sid, seq, x0, x1, y): distinct records, NaN missing, unlabelled -1; seq of the first delivery."""
    t = table(spark, d, "syn_num_test")
    x = {f"x{j}": F.when(~F.isnan(f"c{j}"), F.col(f"c{j}")) for j in (0, 1)}
    return t.select("sid", "seq", *[e.alias(k) for k, e in x.items()], F.coalesce("c2", F.lit(-1)).alias("y")).groupBy("sid").agg(F.min("seq").alias("seq"), F.first("x0").alias("x0"), F.first("x1").alias("x1"), F.first("y").alias("y"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """As the operators take them: sid, seq, xl, xu, y."""
    p = points(spark, d)
    return p.select("sid", "seq", F.array("x0", "x1").alias("xl"), F.array("x0", "x1").alias("xu"), "y")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).filter("y > 0")


def whole_samples(spark: SparkSession, d: str) -> DataFrame:
    """Labelled samples without missing features, scaled to the unit square."""
    p = points(spark, d).filter("y > 0 AND x0 IS NOT NULL AND x1 IS NOT NULL")
    p = p.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in ("x0", "x1")})
    return p.select("sid", "seq", F.array("x0", "x1").alias("xl"), F.array("x0", "x1").alias("xu"), "y")


def boxes(spark: SparkSession, d: str, model: str | None = None) -> DataFrame:
    b = table(spark, d, "hyperbox").withColumn("c", F.coalesce("c", F.lit(-1)))
    return b if model is None else b.filter(F.col("model_id") == model)


def bounds() -> tuple[list[Column], list[Column]]:
    """Marked lower and upper bounds of x0, x1."""
    pairs = [prepare.mark_missing(F.col(f"x{j}"), F.col(f"x{j}")) for j in (0, 1)]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def corners(v: str = "v", w: str = "w") -> tuple[list[Column], list[Column]]:
    return elements(v, 2), elements(w, 2)


def record_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Every record with every box of the model, level by level."""
    b = boxes(spark, d, RECORD_MODEL).select("level", "box_id", "v", "w", "c", "n_samples", "centroid")
    levels = F.array(*[F.lit(k) for k in prepare.stated(b, "level")])
    return points(spark, d).withColumn("level", F.explode(levels)).join(F.broadcast(b), "level")  # one stated model


def box_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of whole boxes of one model that share a cell, hence all that meet: model_id, a_…, b_…."""
    return prune.neighbours(boxes(spark, d), 2, None, ["model_id"])


def coded_records(spark: SparkSession, d: str) -> DataFrame:
    """(sid, k0, k1, c0, y): distinct credit records with c4 and c6 as codes."""
    t = table(spark, d, "japanese_credit").groupBy("sid").agg(*[F.first(c).alias(c) for c in ("c4", "c6", "c0", "c15")])
    words = dictionary.build(table(spark, d, "japanese_credit").select("c4", "c6"), ["c4", "c6"])
    coded = dictionary.encode(t, ["c4", "c6"], words)
    return coded.select("sid", F.col("c4").alias("k0"), F.col("c6").alias("k1"), "c0", F.coalesce("c15", F.lit(-1)).alias("y"))


def mixed_records(spark: SparkSession, d: str) -> DataFrame:
    """(sid, x0, x1, k0, k1, c0, y): distinct credit records with c2 and c7 scaled, c4 and c6 as codes."""
    t = table(spark, d, "japanese_credit")
    t = prepare.scale_unit(t.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("c2", "c7", "c4", "c6", "c0", "c15")]), ["c2", "c7"])
    words = dictionary.build(table(spark, d, "japanese_credit").select("c4", "c6"), ["c4", "c6"])
    return dictionary.encode(t, ["c4", "c6"], words).select("sid", F.col("c2").alias("x0"), F.col("c7").alias("x1"), F.col("c4").alias("k0"), F.col("c6").alias("k1"), "c0", F.coalesce("c15", F.lit(-1)).alias("y"))


def record_mixed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Every credit record with every box of the mixed model, member by member."""
    b = boxes(spark, d, "mixed_bag").select("member_id", "box_id", "v", "w", "e", "f", "bits", "hist", "n_samples")
    return prepare.per_member(mixed_records(spark, d), b).join(F.broadcast(b), "member_id")  # one stated model


def mixed_samples(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """(sid, xl, xu, y, cat): ``mixed_records`` as samples, with c0 (values), or c4 and c6 (bits or codes)."""
    bit = lambda k: F.coalesce(F.expr(f"shiftleft(1L, {k})"), F.lit(0).cast("bigint"))
    cat = {"eiol": F.array("c0"), "onehot": F.array(bit("k0"), bit("k1")), "freqcat": F.array("k0", "k1")}[kind]
    x = F.array("x0", "x1")
    return mixed_records(spark, d).select("sid", x.alias("xl"), x.alias("xu"), "y", cat.alias("cat"))


def mixed_training(spark: SparkSession, d: str, learner: str) -> DataFrame:
    """(sid, seq, xl, xu, y, cat): credit records with c2 and c7 scaled and c4, c6 as the learner takes them (values, bits or codes)."""
    t = table(spark, d, "japanese_credit").groupBy("sid").agg(F.min("seq").alias("seq"), *[F.first(c).alias(c) for c in ("c2", "c7", "c4", "c6", "c15")])
    t = prepare.scale_unit(t, ["c2", "c7"])
    if learner != "eiol":
        words = dictionary.build(table(spark, d, "japanese_credit").select("c4", "c6"), ["c4", "c6"])
        t = (dictionary.one_hot if learner == "onehot" else dictionary.encode)(t, ["c4", "c6"], words)
    x = F.array("c2", "c7")
    return t.select("sid", "seq", x.alias("xl"), x.alias("xu"), F.coalesce("c15", F.lit(-1)).alias("y"), F.array("c4", "c6").alias("cat"))


def gaps(spark: SparkSession, d: str, features: int = 2, most: int = 1_000_000) -> list[dict]:
    """The stated table of category distances, per feature {(a, b): distance}."""
    rows = table(spark, d, "cat_dist").filter("a IS NOT NULL AND b IS NOT NULL AND dist IS NOT NULL").select("feature", "a", "b", "dist").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} category distances")
    out: list[dict] = [{} for _ in range(features)]
    for r in rows:
        if r["feature"] < features:
            out[r["feature"]][min(r["a"], r["b"]), max(r["a"], r["b"])] = r["dist"]
    return out


# SQL ---------------------------------------------------------------------------------------------------------------

POINTS = """
p AS (SELECT DISTINCT sid, CASE WHEN NOT isnan(c0) THEN c0 END AS x0, CASE WHEN NOT isnan(c1) THEN c1 END AS x1, coalesce(c2, -1) AS y FROM syn_num_test),
s AS (SELECT *, coalesce(x0, 1.001::DOUBLE) AS l0, coalesce(x1, 1.001::DOUBLE) AS l1, coalesce(x0, -0.001::DOUBLE) AS u0, coalesce(x1, -0.001::DOUBLE) AS u1 FROM p),
b AS (SELECT model_id, box_id, v[1] AS v0, v[2] AS v1, w[1] AS w0, w[2] AS w1, least(v[1], w[1]) AS lo0, least(v[2], w[2]) AS lo1, greatest(v[1], w[1]) AS hi0, greatest(v[2], w[2]) AS hi1,
             coalesce(c, -1) AS c, n_samples AS n, centroid[1] AS m0, centroid[2] AS m1, level, partition_id FROM hyperbox),
sb AS (SELECT * FROM s JOIN b ON b.model_id = 'onln_gfmm'),
ab AS (SELECT a.model_id, a.box_id AS a_id, b.box_id AS b_id, a.v0 AS a0, a.v1 AS a1, a.w0 AS b0, a.w1 AS b1, b.v0 AS c0, b.v1 AS c1, b.w0 AS d0, b.w1 AS d1, a.c AS ca, b.c AS cb, a.n AS na, b.n AS nb
       FROM b AS a JOIN b ON a.model_id = b.model_id AND a.box_id <> b.box_id
       WHERE a.v0 <= a.w0 AND a.v1 <= a.w1 AND b.v0 <= b.w0 AND b.v1 <= b.w1)
"""

CODES = """
r AS (SELECT DISTINCT sid, c2, c7, c4, c6, c0, coalesce(c15, -1) AS y FROM japanese_credit),
g2 AS (SELECT min(c2) AS lo, CASE WHEN max(c2) > min(c2) THEN max(c2) - min(c2) ELSE 1 END AS span FROM r WHERE NOT isnan(c2)),
g7 AS (SELECT min(c7) AS lo, CASE WHEN max(c7) > min(c7) THEN max(c7) - min(c7) ELSE 1 END AS span FROM r WHERE NOT isnan(c7)),
d4 AS (SELECT c4, dense_rank() OVER (ORDER BY c4) - 1 AS k0 FROM (SELECT DISTINCT c4 FROM japanese_credit WHERE c4 IS NOT NULL)),
d6 AS (SELECT c6, dense_rank() OVER (ORDER BY c6) - 1 AS k1 FROM (SELECT DISTINCT c6 FROM japanese_credit WHERE c6 IS NOT NULL)),
coded AS (SELECT sid, k0, k1, c0, y, CASE WHEN NOT isnan(c2) THEN (c2 - g2.lo) / g2.span END AS x0, CASE WHEN NOT isnan(c7) THEN (c7 - g7.lo) / g7.span END AS x1 FROM r LEFT JOIN d4 USING (c4) LEFT JOIN d6 USING (c6) CROSS JOIN g2 CROSS JOIN g7),
mb AS (SELECT * EXCLUDE (c), coalesce(c, -1) AS c, coalesce(n_samples, 1) AS n, v[1] AS v0, v[2] AS v1, w[1] AS w0, w[2] AS w1, least(v[1], w[1]) AS lo0, least(v[2], w[2]) AS lo1, greatest(v[1], w[1]) AS hi0, greatest(v[2], w[2]) AS hi1 FROM hyperbox WHERE model_id = 'mixed_bag'),
rb AS (SELECT *, coalesce(x0, 1.001::DOUBLE) AS l0, coalesce(x1, 1.001::DOUBLE) AS l1, coalesce(x0, -0.001::DOUBLE) AS u0, coalesce(x1, -0.001::DOUBLE) AS u1 FROM coded CROSS JOIN mb)
"""


def ramp(z: str, g: float = 1.0) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({z}) * {g}::DOUBLE))"


def gfmm(xl: list[str], xu: list[str], v: list[str], w: list[str], g: list[float] | float = 1.0) -> str:
    gains = g if isinstance(g, list) else [g] * len(v)
    return "least(" + ", ".join(f"1.0::DOUBLE - {ramp(z, k)}" for a, b, c, e, k in zip(xl, xu, v, w, gains) for z in (f"{b} - {e}", f"{c} - {a}")) + ")"


def free_range(xl: list[str], xu: list[str], v: list[str], w: list[str], g: float = 1.0) -> str:
    return "least(" + ", ".join(f"1.0::DOUBLE - {ramp(f'({z}) / ({e} - {c} + 1.0::DOUBLE)', 1.0 / g)}" for a, b, c, e in zip(xl, xu, v, w) for z in (f"{b} - {e}", f"{c} - {a}")) + ")"


def fmnn(x: list[str], v: list[str], w: list[str], g: float = 1.0) -> str:
    side = lambda z: f"greatest(0.0::DOUBLE, 1.0::DOUBLE - greatest(0.0::DOUBLE, {g}::DOUBLE * least(1.0::DOUBLE, {z})))"
    return "(" + " + ".join(f"({side(f'{a} - {e}')} + {side(f'{c} - {a}')})" for a, c, e in zip(x, v, w)) + f") / {2.0 * len(v)}::DOUBLE"


def manhattan_present(xl: list[str], xu: list[str], v: list[str], w: list[str]) -> str:
    there = [f"({a} <> 1.001 AND {b} <> -0.001 AND {c} <> 1.001 AND {e} <> -0.001)" for a, b, c, e in zip(xl, xu, v, w)]
    parts = [f"CASE WHEN {t} THEN abs(({a} + {b}) / 2 - ({c} + {e}) / 2) ELSE 0 END" for t, a, b, c, e in zip(there, xl, xu, v, w)]
    return f"CASE WHEN {' OR '.join(there)} THEN {' + '.join(parts)} ELSE 2147483647.0::DOUBLE END"


L, U = ["l0", "l1"], ["u0", "u1"]
V, W = ["v0", "v1"], ["w0", "w1"]
LO, HI = ["lo0", "lo1"], ["hi0", "hi1"]
A1, B1, A2, B2 = ["a0", "a1"], ["b0", "b1"], ["c0", "c1"], ["d0", "d1"]


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"
