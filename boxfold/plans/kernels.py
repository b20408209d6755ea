"""Queries of the scalar operators: memberships, distances, overlaps, contractions - over records with all boxes of a model, and pairs of boxes.

Over records they tell, of all boxes, the greatest and the least value, their sum in units of 1e-7, and the same weighted by the boxes' ids,
so that a value at the wrong box shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfold.functions import contract, distance, membership, overlap
from boxfold.operators import prepare, prune, score
from boxfold.plans import inputs
from boxfold.plans.inputs import A1, A2, B1, B2, HI, LO, L, U, V, W, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GAINS = [1.5, 0.5]


def _told(rows: DataFrame, value: Column, by: tuple[str, ...] = ("sid",)) -> DataFrame:
    values = rows.select(*by, "box_id", value.alias("value")).filter("value IS NOT NULL")
    values = values.withColumn("m", F.when(F.col("value") < distance.NO_DISTANCE, F.floor(F.col("value") * 1e7 + 0.5)))
    return values.groupBy(*by).agg(F.round(F.max("value"), 9).alias("most"), F.round(F.min("value"), 9).alias("least"), F.sum("m").alias("units"), F.sum(F.col("m") * F.col("box_id")).alias("by_box"))


def _told_sql(value: str, source: str, where: str | None = None, by: str = "sid", names: str = "sid") -> str:
    inner = f"SELECT {names}, box_id, {value} AS value FROM {source}" + (f" WHERE {where}" if where else "")
    return (f"SELECT {by}, round(max(value), 9) AS most, round(min(value), 9) AS least, sum(m)::BIGINT AS units, sum(m * box_id)::BIGINT AS by_box FROM "
            f"(SELECT *, CASE WHEN value < {distance.NO_DISTANCE} THEN floor(value * 1e7 + 0.5)::BIGINT END AS m FROM ({inner}) WHERE value IS NOT NULL) GROUP BY {by}")


def _on_records(name: str, value: Callable[[], Column], sql: str, where: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = inputs.record_boxes(spark, d)
        return _told(rows.filter(where) if where else rows, value())

    QUERIES[name] = run
    SQL[name] = with_(inputs.POINTS) + _told_sql(sql, "sb", where)


def _corners() -> tuple:
    v, w = inputs.corners()
    return (*inputs.bounds(), v, w, *membership.ordered(v, w))


BOTH = "x0 IS NOT NULL AND x1 IS NOT NULL"
X = lambda: [F.col("x0"), F.col("x1")]


def _records() -> None:
    def on(name: str, f: Callable[..., Column], sql: str, where: str | None = None) -> None:
        _on_records(name, lambda: f(*_corners()), sql, where)

    on("membership_gfmm", lambda l, u, v, w, lo, hi: membership.gfmm(l, u, lo, hi), inputs.gfmm(L, U, LO, HI))
    on("membership_gamma_vector", lambda l, u, v, w, lo, hi: membership.gfmm(l, u, lo, hi, GAINS), inputs.gfmm(L, U, LO, HI, GAINS))
    on("membership_fmnn", lambda l, u, v, w, lo, hi: membership.fmnn(X(), v, w, 2.0), inputs.fmnn(["x0", "x1"], V, W, 2.0), BOTH)
    on("membership_free_range", lambda l, u, v, w, lo, hi: membership.free_range(l, u, lo, hi, 0.5), inputs.free_range(L, U, LO, HI, 0.5))
    asym = f"{inputs.gfmm(L, U, LO, HI)}, {inputs.gfmm(LO, HI, L, U)}"
    on("asymmetric_max", lambda l, u, v, w, lo, hi: membership.asymmetric(l, u, lo, hi), f"greatest({asym})")
    on("asymmetric_min", lambda l, u, v, w, lo, hi: membership.asymmetric(l, u, lo, hi, way="min"), f"least({asym})")
    on("ramp_value", lambda l, u, v, w, lo, hi: membership.ramp(X()[0] - w[0], 2.0), inputs.ramp("x0 - w0", 2.0), BOTH)
    on("capped_slope", lambda l, u, v, w, lo, hi: membership.capped_slope(X()[0] - w[0], 2.0), "2.0 * least(1.0::DOUBLE, x0 - w0)", BOTH)
    on("manhattan_dist", lambda l, u, v, w, lo, hi: distance.manhattan(X(), distance.midpoint(v, w)), "abs(x0 - (v0 + w0) / 2) + abs(x1 - (v1 + w1) / 2)", BOTH)
    on("manhattan_missing_dist", lambda l, u, v, w, lo, hi: distance.manhattan_present(l, u, v, w), inputs.manhattan_present(L, U, V, W))
    on("rfmnn_dist", lambda l, u, v, w, lo, hi: distance.to_both_corners(X(), v, w), "(abs(x0 - v0) + abs(x0 - w0) + (abs(x1 - v1) + abs(x1 - w1))) / 4", BOTH)
    on("centroid_dist", lambda l, u, v, w, lo, hi: distance.euclidean(X(), membership.elements("centroid", 2)), "sqrt((x0 - m0) * (x0 - m0) + (x1 - m1) * (x1 - m1))", BOTH)


def missing_free_range(spark: SparkSession, d: str) -> DataFrame:
    """Missing bounds marked in a free range, and the distance over what is present."""
    bounds = [_free(j) for j in (0, 1)]
    xl, xu = [b[0] for b in bounds], [b[1] for b in bounds]
    v, w = inputs.corners()
    value = distance.manhattan_present(xl, xu, v, w, distance.FREE_LOW, distance.FREE_HIGH)
    return _told(inputs.record_boxes(spark, d).withColumns({"low": xl[0], "high": xu[0]}), value, ("sid", "low", "high"))


def _free(j: int) -> tuple[Column, Column]:
    from boxfold.operators.prepare import mark_missing

    return mark_missing(F.col(f"x{j}"), F.col(f"x{j}"), free=True)


SQL["missing_free_range"] = with_(inputs.POINTS) + _told_sql(
    "CASE WHEN x0 IS NULL AND x1 IS NULL THEN 2147483647.0::DOUBLE ELSE coalesce(abs(x0 - (v0 + w0) / 2), 0) + coalesce(abs(x1 - (v1 + w1) / 2), 0) END", "sb",
    by="sid, low, high", names="sid, coalesce(x0, 1e9) AS low, coalesce(x0, -1e9) AS high")
QUERIES["missing_free_range"] = missing_free_range


def pair_hash(spark: SparkSession, d: str) -> DataFrame:
    """Of every record's codes with all boxes: the least, the greatest and how many differ."""
    codes = inputs.record_boxes(spark, d).select("sid", distance.pair_code(F.col("sid"), F.col("box_id")).alias("code"))
    return codes.groupBy("sid").agg(F.min("code").alias("least"), F.max("code").alias("greatest"), F.countDistinct("code").alias("n"))


QUERIES["pair_hash"] = pair_hash
SQL["pair_hash"] = with_(inputs.POINTS) + "SELECT sid, min(code) AS least, max(code) AS greatest, count(DISTINCT code) AS n FROM (SELECT sid, greatest(sid, box_id) * (greatest(sid, box_id) + 1) // 2 + least(sid, box_id) AS code FROM sb) GROUP BY 1"


# Pairs of boxes ----------------------------------------------------------------------------------------------------


def _sides() -> tuple:
    return (*inputs.corners("a_v", "a_w"), *inputs.corners("b_v", "b_w"))


def _on_pairs(name: str, columns: Callable[..., list[Column]], sql: str, where: Callable[..., Column] | None = None, sql_where: str = "", found: Callable[..., Column] | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = inputs.box_pairs(spark, d)
        if found:  # generated, not projected: so that the optimiser can't copy the case into every use
            rows = rows.select("*", F.explode(F.array(found(*_sides()))).alias("found"))
        rows = rows.filter(where(*_sides())) if where else rows
        return rows.select("a_id", "b_id", *columns(*_sides()))

    QUERIES[name] = run
    SQL[name] = with_(inputs.POINTS) + f"SELECT a_id, b_id, {sql} FROM ab" + (f" WHERE {sql_where}" if sql_where else "")


_MEET = f"{inputs.gfmm(B1, A1, A2, B2)} = 1"
_IN = f"{inputs.gfmm(A1, B1, A2, B2)} = 1"


def fmnn_case_sql(dims: int = 2) -> tuple[str, str]:
    """SQL of the case and feature; a row per feature is ranked by amount."""
    rows, oks = [], []
    for j in range(dims):
        a, b, c, e = A1[j], B1[j], A2[j], B2[j]
        case = (f"CASE WHEN {b} <= {e} AND {a} <= {c} AND {b} > {c} THEN 1 WHEN {b} > {e} AND {a} > {c} AND {e} > {a} THEN 2 "
                f"WHEN {b} > {e} AND {a} <= {c} THEN CASE WHEN {e} - {a} < {b} - {c} THEN 31 ELSE 32 END WHEN {b} <= {e} AND {a} > {c} THEN CASE WHEN {e} - {a} < {b} - {c} THEN 41 ELSE 42 END END")
        rows.append((case, f"CASE {case} WHEN 1 THEN {b} - {c} WHEN 2 THEN {e} - {a} ELSE least({e} - {a}, {b} - {c}) END", j))
        oks.append(f"({case}) IS NOT NULL")
    return _choose(rows, " AND ".join(oks))


def _choose(rows: list[tuple[str, str, int]], ok: str) -> tuple[str, str]:
    (c0, m0, _), (c1, m1, _) = rows
    second = f"(({c0}) IS NULL OR ({m1}) < ({m0})) AND ({c1}) IS NOT NULL AND ({m1}) < 2"
    first = f"({c0}) IS NOT NULL AND ({m0}) < 2"
    case = f"CASE WHEN {ok} THEN CASE WHEN {second} THEN {c1} WHEN {first} THEN {c0} END END"
    dim = f"CASE WHEN {ok} THEN CASE WHEN {second} THEN 1 WHEN {first} THEN 0 END END"
    return case, dim


def efmnn_case_sql(sample: tuple[str, str] = tuple(B1)) -> tuple[str, str]:
    """``sample``: the sample at hand, which decides between equal boxes."""
    rows, oks = [], []
    for j in range(2):
        a, b, c, e = A1[j], B1[j], A2[j], B2[j]
        near = f"{e} - {a} < {b} - {c}"
        case = (f"CASE WHEN {a} = {c} AND {b} = {e} THEN CASE WHEN {b} = {sample[j]} THEN 91 ELSE 92 END "
                f"WHEN {a} = {c} AND {b} < {e} AND {b} > {c} THEN 3 WHEN {b} = {e} AND {a} < {c} AND {b} > {c} THEN 4 WHEN {a} = {c} AND {b} > {e} AND {e} > {a} THEN 5 WHEN {b} = {e} AND {a} > {c} AND {e} > {a} THEN 6 "
                f"WHEN {a} < {c} AND {b} < {e} AND {b} > {c} THEN 1 WHEN {a} > {c} AND {b} > {e} AND {e} > {a} THEN 2 "
                f"WHEN {a} <= {c} AND {b} > {e} THEN CASE WHEN {near} THEN 71 ELSE 72 END WHEN {a} > {c} AND {b} <= {e} THEN CASE WHEN {near} THEN 81 ELSE 82 END END")
        rows.append((case, f"CASE WHEN {case} = 1 THEN {b} - {c} WHEN {case} IN (2, 91, 92) THEN {e} - {a} ELSE least({e} - {a}, {b} - {c}) END", j))
        oks.append(f"({case}) IS NOT NULL")
    return _choose(rows, " AND ".join(oks))


def gfmm_case_sql() -> tuple[str, str]:
    rows, touch = [], []
    for j in range(2):
        a, b, c, e = A1[j], B1[j], A2[j], B2[j]
        case = (f"CASE WHEN {a} <= {c} AND {c} < {b} AND {b} <= {e} THEN 1 WHEN {c} <= {a} AND {a} < {e} AND {e} <= {b} THEN 2 "
                f"WHEN {a} < {c} AND {e} < {b} THEN CASE WHEN {e} - {a} <= {b} - {c} THEN 31 ELSE 32 END WHEN {c} < {a} AND {b} < {e} THEN CASE WHEN {e} - {a} <= {b} - {c} THEN 41 ELSE 42 END END")
        rows.append((case, f"CASE {case} WHEN 1 THEN {b} - {c} WHEN 2 THEN {e} - {a} ELSE least({e} - {a}, {b} - {c}) END", j))
        touch.append(f"CASE WHEN ({case}) IS NULL THEN CASE WHEN {a} <= {b} AND {b} = {c} AND {c} < {e} THEN 5 WHEN {a} < {b} AND {b} = {c} AND {c} <= {e} THEN 6 "
                     f"WHEN {c} <= {e} AND {e} = {a} AND {a} < {b} THEN 7 WHEN {c} < {e} AND {e} = {a} AND {a} <= {b} THEN 8 END END")
    case, dim = _choose(rows, "true")
    return f"coalesce({touch[0]}, {touch[1]}, {case})", f"CASE WHEN ({touch[0]}) IS NOT NULL THEN 0 WHEN ({touch[1]}) IS NOT NULL THEN 1 ELSE {dim} END"


#: Which cases change which corner, and to what ({a} low, {b} high of the first box; {c}, {d} of the tested).
GFMM_STEP = {
    "v1": [("2", "({d} + {a}) / 2 + 1e-5"), ("31", "{d} + 1e-5"), ("7", "least({a} + 1e-5, {b})")], "w1": [("1", "({b} + {c}) / 2"), ("32", "{c} - 1e-5"), ("6", "greatest({b} - 1e-5, {a})")],
    "v2": [("1", "({b} + {c}) / 2 + 1e-5"), ("42", "{b} + 1e-5"), ("5", "least({c} + 1e-5, {d})")], "w2": [("2", "({d} + {a}) / 2"), ("41", "{a} - 1e-5"), ("8", "greatest({d} - 1e-5, {c})")],
}
FMNN_STEP = {
    "v1": [("2, 92", "({d} + {a}) / 2"), ("31, 5, 71", "{d} + 1e-5")], "w1": [("1, 91", "({c} + {b}) / 2"), ("32, 4, 72", "{c} - 1e-5")],
    "v2": [("1, 91", "({c} + {b}) / 2 + 1e-5"), ("42, 3, 82", "{b} + 1e-5")], "w2": [("2, 92", "({d} + {a}) / 2 - 1e-5"), ("41, 6, 81", "{a} - 1e-5")],
}


def corner_sql(changes: dict[str, list[tuple[str, str]]]) -> dict[str, str]:
    """Corners v1_0 … w2_1 after a step, from a0 … d1, cs and dim."""
    out = {}
    for corner, names in (("v1", A1), ("w1", B1), ("v2", A2), ("w2", B2)):
        for j in range(2):
            sub = lambda t: t.replace("{a}", A1[j]).replace("{b}", B1[j]).replace("{c}", A2[j]).replace("{d}", B2[j])  # noqa: B023, E731
            whens = " ".join(f"WHEN dim = {j} AND cs IN ({cases}) THEN {sub(value)}" for cases, value in changes[corner])
            out[f"{corner}_{j}"] = f"CASE {whens} ELSE {names[j]} END"
    return out


def _parted_sql(changes: dict[str, list[tuple[str, str]]], source: str, extra: str = "") -> str:
    out = [f"round({value}, 6) AS {name}" for name, value in corner_sql(changes).items()]
    return with_(inputs.POINTS, source) + f"SELECT a_id, b_id, {', '.join(out)} FROM k{extra}"


def _parted_columns(parted: Column) -> list[Column]:
    return [F.round(F.get(parted[c], F.lit(j)), 6).alias(f"{c}_{j}") for c in ("v1", "w1", "v2", "w2") for j in (0, 1)]


def _similarity(name: str, how: dict, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """All pairs of boxes of one model that are similar at all."""
        return prune.similar_pairs(inputs.boxes(spark, d), 2, keys=["model_id"], **how).select("a_id", "b_id", F.round("similarity", 9).alias("value"))

    QUERIES[name] = run
    SQL[name] = with_(inputs.POINTS) + f"SELECT a_id, b_id, round({sql}, 9) AS value FROM ab WHERE {sql} > 0"


def _pairs() -> None:
    for name, how, sql in (("mid", {}, f"greatest({inputs.gfmm(A1, B1, A2, B2)}, {inputs.gfmm(A2, B2, A1, B1)})"), ("short", {"measure": "short"}, inputs.gfmm(B1, A1, A2, B2)), ("long", {"measure": "long"}, inputs.gfmm(A1, B1, B2, A2))):
        _similarity(f"similarity_pairs_{name}", how, sql)
    rival = "(ca <> cb OR ca = -1)"
    apart = lambda *s: ((F.col("a_c") != F.col("b_c")) | (F.col("a_c") == -1)) & overlap.overlaps(*s)
    _on_pairs("overlap_pairs", lambda *s: [F.col("a_c").alias("a_class"), F.col("b_c").alias("b_class")], "ca AS a_class, cb AS b_class", apart, f"{rival} AND {_MEET}")
    meets = "(least(b0, d0) >= greatest(a0, c0) AND least(b1, d1) >= greatest(a1, c1))"
    _on_pairs("overlap_free_range", lambda *s: [F.col("a_c").alias("a_class"), F.col("b_c").alias("b_class")], "ca AS a_class, cb AS b_class", lambda *s: overlap.overlaps_free(*s), meets)
    width = ["least(d0 - a0, b0 - c0)", "least(d1 - a1, b1 - c1)"]
    zero = f"({width[0]} = 0 AND {width[1]} = 0)"
    first = f"CASE WHEN {zero} OR {width[0]} <> 0 THEN {width[0]} ELSE 1e308 END <= CASE WHEN {zero} OR {width[1]} <> 0 THEN {width[1]} ELSE 1e308 END"
    _on_pairs("overlap_rfmnn_dim", lambda *s: [overlap.least_overlap_dim(*s).alias("dim")], f"CASE WHEN {first} THEN 0 ELSE 1 END AS dim", lambda *s: overlap.least_overlap_dim(*s).isNotNull(), meets)
    case, dim = fmnn_case_sql()
    found = lambda *s: overlap.fmnn_case(*s)
    _on_pairs("overlap_case_fmnn", lambda *s: [F.col("found.case").alias("case_no"), F.col("found.dim").alias("dim")], f"{case} AS case_no, {dim} AS dim", lambda *s: F.col("found").isNotNull(), f"({case}) IS NOT NULL", found=found)
    e_case, e_dim = efmnn_case_sql()
    e_found = lambda *s: overlap.efmnn_case(*s, s[1])  # noqa: E731  the sample is the upper corner
    _on_pairs("overlap_case_efmnn", lambda *s: [F.col("found.case").alias("case_no"), F.col("found.dim").alias("dim")], f"{e_case} AS case_no, {e_dim} AS dim", lambda *s: F.col("found").isNotNull(), f"({e_case}) IS NOT NULL", found=e_found)
    same = "ca = cb"
    _on_pairs("containment_pairs", lambda *s: [F.col("a_c").alias("c")], "ca AS c", lambda *s: (F.col("a_c") == F.col("b_c")) & overlap.contains(*s), f"{same} AND {_IN}")

    g_case, g_dim = gfmm_case_sql()
    _on_pairs("contract_gfmm", lambda *s: _parted_columns(contract.part_gfmm(s[0], s[1], F.col("a_c"), s[2], s[3], F.col("b_c"), F.col("found"))), "0", apart, found=contract.gfmm_case)
    SQL["contract_gfmm"] = _parted_sql(GFMM_STEP, f"k AS (SELECT *, {g_case} AS cs, {g_dim} AS dim FROM ab WHERE {rival} AND {_MEET})")
    _on_pairs("contract_fmnn", lambda *s: _parted_columns(contract.part_by_case(*s, F.col("found.case"), F.col("found.dim"))), "0", lambda *s: F.col("found").isNotNull(), found=found)
    SQL["contract_fmnn"] = _parted_sql(FMNN_STEP, f"k AS (SELECT *, {case} AS cs, {dim} AS dim FROM ab)", " WHERE cs IS NOT NULL")
    _on_pairs("contract_efmnn", lambda *s: _parted_columns(contract.part_by_case(*s, F.col("found.case"), F.col("found.dim"))), "0", lambda *s: F.col("found").isNotNull(), found=e_found)
    SQL["contract_efmnn"] = _parted_sql(FMNN_STEP, f"k AS (SELECT *, {e_case} AS cs, {e_dim} AS dim FROM ab)", " WHERE cs IS NOT NULL")


#: Scale of the boxes in ``contract_free_range``: overlaps may then be wider than 2.
FREE_SCALE = 50.0


def contract_free_range(spark: SparkSession, d: str) -> DataFrame:
    """Rivals of any range that overlap, parted."""
    scaled = lambda c: F.transform(c, lambda x: x * FREE_SCALE)
    b = inputs.boxes(spark, d).withColumns({"v": scaled("v"), "w": scaled("w")})
    rows = prune.neighbours(b, 2, None, ["model_id"])
    s = _sides()
    rows = rows.select("*", F.explode(F.array(contract.gfmm_case(*s, float("inf")))).alias("found"))
    rows = rows.filter(((F.col("a_c") != F.col("b_c")) | (F.col("a_c") == -1)) & overlap.overlaps_free(*s))
    return rows.select("a_id", "b_id", *_parted_columns(contract.part_gfmm(s[0], s[1], F.col("a_c"), s[2], s[3], F.col("b_c"), F.col("found"))))


def _free_sql() -> str:
    case, dim = (x.replace("< 2)", "< 1e308)").replace("< 2 ", "< 1e308 ") for x in gfmm_case_sql())
    wide = ", ".join(f"{c} * {FREE_SCALE} AS {c}" for c in (*A1, *B1, *A2, *B2))
    meet = "least(b0, d0) >= greatest(a0, c0) AND least(b1, d1) >= greatest(a1, c1)"
    return _parted_sql(GFMM_STEP, f"f AS (SELECT a_id, b_id, ca, cb, {wide} FROM ab), k AS (SELECT *, {case} AS cs, {dim} AS dim FROM f WHERE (ca <> cb OR ca = -1) AND {meet})")


QUERIES["contract_free_range"] = contract_free_range
SQL["contract_free_range"] = _free_sql()


def split_rfmnn(spark: SparkSession, d: str) -> DataFrame:
    """Parents split around the children that meet them, of another class: one or two rows each."""
    rows = inputs.box_pairs(spark, d).filter("a_c <> b_c")
    s = _sides()
    rows = rows.withColumn("dim", overlap.least_overlap_dim(*s)).filter("dim IS NOT NULL")
    rows = rows.select("a_id", "b_id", F.posexplode(contract.split_around(*s, F.col("dim"))).alias("piece", "box"))
    return rows.select("a_id", "b_id", "piece", *[F.round(F.get(F.col("box")[c], F.lit(j)), 6).alias(f"{c}{j}") for c in ("v", "w") for j in (0, 1)])


def _split_sql() -> str:
    meets = "(least(b0, d0) >= greatest(a0, c0) AND least(b1, d1) >= greatest(a1, c1))"
    width = ["least(d0 - a0, b0 - c0)", "least(d1 - a1, b1 - c1)"]
    zero = f"({width[0]} = 0 AND {width[1]} = 0)"
    first = f"CASE WHEN {zero} OR {width[0]} <> 0 THEN {width[0]} ELSE 1e308 END <= CASE WHEN {zero} OR {width[1]} <> 0 THEN {width[1]} ELSE 1e308 END"
    k = f"k AS (SELECT *, CASE WHEN {first} THEN 0 ELSE 1 END AS dim FROM ab WHERE ca <> cb AND {meets}), t AS (SELECT *, CASE WHEN dim = 0 THEN a0 < c0 AND d0 < b0 ELSE a1 < c1 AND d1 < b1 END AS inner_box FROM k)"
    low = "SELECT a_id, b_id, 0 AS piece, round(a0, 6) AS v0, round(a1, 6) AS v1, round(CASE WHEN inner_box AND dim = 0 THEN c0 - 0.001 ELSE b0 END, 6) AS w0, round(CASE WHEN inner_box AND dim = 1 THEN c1 - 0.001 ELSE b1 END, 6) AS w1 FROM t"
    high = "SELECT a_id, b_id, 1, round(CASE WHEN dim = 0 THEN d0 + 0.001 ELSE a0 END, 6), round(CASE WHEN dim = 1 THEN d1 + 0.001 ELSE a1 END, 6), round(b0, 6), round(b1, 6) FROM t WHERE inner_box"
    return with_(inputs.POINTS, k) + f"{low} UNION ALL {high}"


QUERIES["split_rfmnn"] = split_rfmnn
SQL["split_rfmnn"] = _split_sql()


# Categorical features ----------------------------------------------------------------------------------------------


def _on_mixed(name: str, value: Callable[[], Column], sql: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _told(inputs.record_mixed_boxes(spark, d).filter(where), value())

    QUERIES[name] = run
    SQL[name] = with_(inputs.CODES) + _told_sql(sql, "rb", where)


def _bits() -> list[Column]:
    return [F.expr(f"shiftleft(1L, k{j})") for j in (0, 1)]


_SHARED = "((CASE WHEN (1::BIGINT << k0) & bits[1] <> 0 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN (1::BIGINT << k1) & bits[2] <> 0 THEN 1.0::DOUBLE ELSE 0 END)) / 2"
_TOTAL = "list_sum(map_values(hist[1]))::DOUBLE"
_HIST = f"coalesce(hist[1][c0], 0)::DOUBLE / {_TOTAL}"


_NUMBER = inputs.gfmm(L, U, LO, HI)


def entropy_increase(spark: SparkSession, d: str) -> DataFrame:
    """Growth of each box's entropy by a record's value: worked out once per value and box, then told to the records."""
    records = inputs.mixed_records(spark, d).select("sid", "c0").filter("c0 IS NOT NULL")
    b = inputs.boxes(spark, d, "mixed_bag").filter("hist IS NOT NULL").select("member_id", "box_id", "hist")
    rows = prepare.per_member(records.select("c0").distinct(), b).join(F.broadcast(b), "member_id")  # one stated model
    now = F.get("hist", F.lit(0))
    grown = F.map_zip_with(now, F.create_map(F.col("c0"), F.lit(1).cast("bigint")), lambda k, a, x: F.coalesce(a, F.lit(0)) + F.coalesce(x, F.lit(0)))
    return records.join(_told(rows, distance.entropy_growth(grown, now), ("c0",)), "c0").drop("c0")


QUERIES["entropy_increase"] = entropy_increase


def _categories() -> None:
    coded = "k0 IS NOT NULL AND k1 IS NOT NULL AND bits IS NOT NULL"
    _on_mixed("membership_bits", lambda: membership.shares_bits(_bits(), membership.elements("bits", 2)), _SHARED, coded)
    counted = "hist IS NOT NULL AND c0 IS NOT NULL"
    _on_mixed("membership_histogram", lambda: membership.histogram_fit([F.col("c0")], membership.elements("hist", 1)), _HIST, counted)
    number = lambda: membership.gfmm(*inputs.bounds(), *membership.ordered(*inputs.corners()))
    shared = lambda: membership.shares_bits(_bits(), membership.elements("bits", 2))
    _on_mixed("membership_mixed", lambda: membership.mixed(number(), membership.histogram_fit([F.col("c0")], membership.elements("hist", 1)), 0.6), f"0.6::DOUBLE * {_NUMBER} + 0.4::DOUBLE * ({_HIST})", counted)
    _on_mixed("membership_onehot", lambda: membership.onehot(number(), shared()), f"({_NUMBER} + ({_SHARED})) / 2", coded)
    _on_mixed("membership_onehot_numeric", lambda: membership.onehot(number(), None), _NUMBER, coded)
    _on_mixed("membership_onehot_categorical", lambda: membership.onehot(None, shared()), _SHARED, coded)
    two = lambda: [F.create_map(F.col("c0"), F.lit(2).cast("bigint"), F.lit("z"), F.col("box_id")), F.create_map(F.col("c0"), F.lit(3).cast("bigint"))]  # noqa: E731  shares are of the first feature's total
    _on_mixed("membership_histogram_two", lambda: membership.histogram_fit([F.col("c0"), F.col("c0")], two()), "(2::DOUBLE / (2 + box_id) + 3::DOUBLE / (2 + box_id)) / 2", counted + " AND c0 <> 'z'")
    _on_mixed("bit_features", lambda: membership.bit_features(membership.elements("bits", 2)).cast("double"), "(CASE WHEN bits[1] <> 0 THEN 1 ELSE 0 END + CASE WHEN bits[2] <> 0 THEN 1 ELSE 0 END)::DOUBLE", coded)
    bits = lambda counts: f"list_sum(list_transform({counts}, lambda x: CASE WHEN x > 0 THEN -(x / list_sum({counts})::DOUBLE) * log2(x / list_sum({counts})::DOUBLE) ELSE 0 END))"
    now = "map_values(hist[1])"
    after = f"(CASE WHEN list_contains(map_keys(hist[1]), c0) THEN list_transform(map_entries(hist[1]), lambda t: CASE WHEN t.key = c0 THEN t.value + 1 ELSE t.value END) ELSE list_append({now}, 1) END)"
    SQL["entropy_increase"] = with_(inputs.CODES, f"g AS (SELECT sid, box_id, {now} AS old, {after} AS new FROM rb WHERE {counted})") + _told_sql(f"{bits('new')} - list_sum(old)::DOUBLE / list_sum(new)::DOUBLE * ({bits('old')})", "g")


def membership_freqcat(spark: SparkSession, d: str) -> DataFrame:
    """Two-slot membership by the distance table; a record's code and a slot look their distance up in it."""
    rows = inputs.record_mixed_boxes(spark, d).filter("k0 IS NOT NULL AND k1 IS NOT NULL AND e IS NOT NULL AND f IS NOT NULL")
    gaps = inputs.table(spark, d, "cat_dist")
    found = {}
    for j in (0, 1):
        for slot in ("e", "f"):
            name = f"gap_{slot}{j}"
            code = F.get(slot, F.lit(j))
            look = gaps.filter(F.col("feature") == j).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("dist").alias(name))
            rows = rows.join(look, (F.least(f"k{j}", code) == F.col("_a")) & (F.greatest(f"k{j}", code) == F.col("_b")) & code.isNotNull(), "left").drop("_a", "_b")
            found[slot, j] = F.col(name)
    value = membership.slot_fit([found["e", 0], found["e", 1]], [found["f", 0], found["f", 1]], membership.elements("e", 2), membership.elements("f", 2))
    return _told(rows, value)


def membership_freqcat_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The lesser of the numeric and the two-slot membership, by the scoring kernel: per record the greatest over all boxes."""
    told = score.predict(inputs.mixed_samples(spark, d, "freqcat"), inputs.boxes(spark, d, "mixed_bag"), 2, kind="freqcat", distance=inputs.gaps(spark, d))
    return told.select("sid", F.round("membership", 9).alias("value"))


def freqcat_sql() -> tuple[str, str]:
    """Two-slot membership and its source, records with all boxes and the distances they look up."""
    joins, fits = "", []
    for j in (0, 1):
        for s in ("e", "f"):
            joins += f" LEFT JOIN cat_dist AS {s}{j} ON {s}{j}.feature = {j} AND {s}[{j + 1}] IS NOT NULL AND {s}{j}.a = least(k{j}, {s}[{j + 1}]) AND {s}{j}.b = greatest(k{j}, {s}[{j + 1}])"
        lo, hi = (f"(1 - coalesce({s}{j}.dist, 0))" for s in ("e", "f"))
        high = f"(CASE WHEN {lo} = 1 AND e[{j + 1}] IS NOT NULL THEN 1.0::DOUBLE ELSE {hi} END)"
        low = f"(CASE WHEN {high} = 1 AND f[{j + 1}] IS NOT NULL THEN 1.0::DOUBLE ELSE {lo} END)"
        fits.append(f"least({low}, {high})")
    return f"least({fits[0]}, {fits[1]})", f"rb{joins}"


_FREQCAT, _FREQCAT_ROWS = freqcat_sql()
QUERIES |= {"membership_freqcat": membership_freqcat, "membership_freqcat_mixed": membership_freqcat_mixed}
SQL["membership_freqcat"] = with_(inputs.CODES) + _told_sql(_FREQCAT, _FREQCAT_ROWS, "k0 IS NOT NULL AND k1 IS NOT NULL AND e IS NOT NULL AND f IS NOT NULL")
SQL["membership_freqcat_mixed"] = with_(inputs.CODES) + f"SELECT sid, round(max(least({_NUMBER}, {_FREQCAT})), 9) AS value FROM {_FREQCAT_ROWS} WHERE e IS NOT NULL AND f IS NOT NULL GROUP BY 1"


#: How far boxes may miss each other by their numbers in ``overlap_mixed``; few of the table's meet outright.
TOLERANCE = 0.3


def _mixed_pairs(spark: SparkSession, d: str, shared: Column, need: str) -> DataFrame:
    """Pairs of boxes of one member that share one of the values ``shared`` (of the first category), each once per order."""
    b = inputs.boxes(spark, d, "mixed_bag").filter(f"member_id IS NOT NULL AND {need}").withColumn("shared", F.explode(shared))
    side = lambda p: b.select("member_id", "shared", *[F.col(c).alias(f"{p}_{c}") for c in ("box_id", "v", "w", "e", "f", "n_samples")], F.get("hist", F.lit(0)).alias(f"{p}_hist"))
    a, z = side("a"), side("b")
    met = a.join(z.withColumnRenamed("shared", "same"), (a["member_id"] == z["member_id"]) & F.col("shared").eqNullSafe(F.col("same"))).filter("a_box_id <> b_box_id")
    return met


def overlap_categorical(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of boxes that overlap in every category."""
    rows = _mixed_pairs(spark, d, F.array_distinct(F.array(F.get("e", F.lit(0)), F.get("f", F.lit(0)))), "e IS NOT NULL AND f IS NOT NULL")
    two = membership.elements
    return rows.filter(overlap.categorical_overlap(two("a_e", 2), two("a_f", 2), two("b_e", 2), two("b_f", 2))).select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id")).distinct()


def overlap_categorical_any(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that overlap any other box of their member in every category."""
    return overlap_categorical(spark, d).select(F.col("a_id").alias("box_id")).distinct()


def overlap_histogram(spark: SparkSession, d: str, numeric: bool = False) -> DataFrame:
    """Pairs of boxes that in every category share a value of equal frequency."""
    rows = _mixed_pairs(spark, d, F.map_keys(F.get("hist", F.lit(0))), "hist IS NOT NULL AND n_samples > 0")
    rows = rows.filter(overlap.histogram_overlap([F.col("a_hist")], F.col("a_n_samples"), [F.col("b_hist")], F.col("b_n_samples")))
    if numeric:
        wide = lambda c, by: F.transform(c, lambda x: x + F.lit(by))
        rows = rows.withColumns({"a_v": wide("a_v", -TOLERANCE), "a_w": wide("a_w", TOLERANCE)}).filter(overlap.overlaps(*_sides()))
    return rows.select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id")).distinct()


def overlap_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Boxes overlap by their numbers, with a tolerance, and in every category share a value of equal frequency."""
    return overlap_histogram(spark, d, True)


def _cat_sql() -> str:
    tests = []
    for j in (1, 2):
        a, b, c, e = f"a.e[{j}]", f"a.f[{j}]", f"b.e[{j}]", f"b.f[{j}]"
        shared = " OR ".join(f"{x} IS NOT DISTINCT FROM {y}" for x in (a, b) for y in (c, e))
        tests.append(f"({shared}) AND NOT ({a} IS DISTINCT FROM {c} AND {b} IS NULL AND {e} IS NULL)")
    return f"SELECT a.box_id AS a_id, b.box_id AS b_id FROM hyperbox a JOIN hyperbox b ON a.model_id = 'mixed_bag' AND b.model_id = 'mixed_bag' AND a.member_id = b.member_id AND a.box_id <> b.box_id WHERE a.e IS NOT NULL AND a.f IS NOT NULL AND b.e IS NOT NULL AND b.f IS NOT NULL AND {tests[0]} AND {tests[1]}"


QUERIES |= {"overlap_categorical": overlap_categorical, "overlap_categorical_any": overlap_categorical_any, "overlap_mixed_hist": overlap_histogram, "overlap_mixed": overlap_mixed}
SQL["overlap_categorical"] = _cat_sql()
SQL["overlap_categorical_any"] = f"SELECT DISTINCT a_id AS box_id FROM ({_cat_sql()})"
_SHARE = "len(list_filter(map_keys(a.hist[1]), lambda k: coalesce(a.hist[1][k]::DOUBLE / a.n_samples = b.hist[1][k]::DOUBLE / b.n_samples, false))) > 0"
_MIXED_MEET = f"a.v[1] - {TOLERANCE} <= a.w[1] + {TOLERANCE} AND a.v[2] - {TOLERANCE} <= a.w[2] + {TOLERANCE} AND b.v[1] <= b.w[1] AND b.v[2] <= b.w[2] AND " + inputs.gfmm([f"(a.w[{j}] + {TOLERANCE})" for j in (1, 2)], [f"(a.v[{j}] - {TOLERANCE})" for j in (1, 2)], ["b.v[1]", "b.v[2]"], ["b.w[1]", "b.w[2]"]) + " = 1"
SQL["overlap_mixed_hist"], SQL["overlap_mixed"] = [f"""SELECT a.box_id AS a_id, b.box_id AS b_id
FROM hyperbox a JOIN hyperbox b ON a.model_id = 'mixed_bag' AND b.model_id = 'mixed_bag' AND a.member_id = b.member_id AND a.box_id <> b.box_id WHERE a.hist IS NOT NULL AND b.hist IS NOT NULL AND a.n_samples > 0 AND b.n_samples > 0 AND {meets}""" for meets in (_SHARE, f"({_SHARE} AND {_MIXED_MEET})")]


def replace_slots(spark: SparkSession, d: str) -> DataFrame:
    """One slot of a chosen feature replaced, in all boxes: sums of the slots afterwards."""
    rows = inputs.record_mixed_boxes(spark, d).filter("k0 IS NOT NULL AND e IS NOT NULL AND f IS NOT NULL")
    new = contract.replace_slots(membership.elements("e", 2), membership.elements("f", 2), F.lit(0), F.col("k0"), F.lit(None).cast("int"))
    return rows.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get(new[c], F.lit(j))).alias(f"{c}{j}") for c in ("e", "f") for j in (0, 1)])


QUERIES["replace_slots"] = replace_slots
SQL["replace_slots"] = with_(inputs.CODES) + "SELECT sid, count(*) AS n, sum(k0)::BIGINT AS e0, sum(e[2])::BIGINT AS e1, sum(f[1])::BIGINT AS f0, sum(f[2])::BIGINT AS f1 FROM rb WHERE k0 IS NOT NULL AND e IS NOT NULL AND f IS NOT NULL GROUP BY 1"

_records()
_pairs()
_categories()
