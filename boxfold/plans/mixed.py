"""Queries of mixed models, of pruning by every rule, and of members: scoring in the kernel, the same in SQL."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfold.lineage import cut
from boxfold.operators import granular, prune, score
from boxfold.plans import inputs, kernels
from boxfold.plans.inputs import HI, LO, L, U, V, W, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NUMBER, _L1 = inputs.gfmm(L, U, LO, HI), inputs.manhattan_present(L, U, V, W)
_SHARED = "((CASE WHEN coalesce((1::BIGINT << k0) & bits[1], 0) <> 0 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN coalesce((1::BIGINT << k1) & bits[2], 0) <> 0 THEN 1.0::DOUBLE ELSE 0 END)) / 2"
_HIST = "coalesce(hist[1][coalesce(c0, '100000')], 0)::DOUBLE / list_sum(map_values(hist[1]))::DOUBLE"
_SLOTS, _SLOT_ROWS = kernels.freqcat_sql()

#: Of each kind: membership, rows it is worked out over, which boxes have what it needs, and how the operators are called.
KINDS = {
    "onehot": (f"({_NUMBER} + {_SHARED}) / 2", "rb", "bits IS NOT NULL"),
    "eiol": (f"0.6::DOUBLE * {_NUMBER} + 0.4::DOUBLE * ({_HIST})", "rb", "hist IS NOT NULL"),
    "freqcat": (f"least({_NUMBER}, {_SLOTS})", _SLOT_ROWS, "e IS NOT NULL AND f IS NOT NULL"),
}


def how(spark: SparkSession, d: str, kind: str) -> dict:
    return {"kind": kind} | ({"alpha": 0.6} if kind == "eiol" else {"distance": inputs.gaps(spark, d)} if kind == "freqcat" else {})


def _asked(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame]:
    return inputs.mixed_samples(spark, d, kind), inputs.boxes(spark, d, "mixed_bag")


def _memberships(kind: str) -> str:
    """Common tables up to m(sid, y, member, box_id, c, n, m, dist)."""
    member, rows, need = KINDS[kind]
    return with_(inputs.CODES, f"m AS (SELECT sid, y, 0 AS member, box_id, c, n, {member} AS m, {_L1} AS dist FROM {rows} WHERE {need})")


def numeric(source: str, member: str, dist: str, model: str = "onln_gfmm", by: str = "0") -> str:
    """The same for numeric models; ``by``: the column that tells members apart."""
    return with_(inputs.POINTS, f"m AS (SELECT sid, y, {by} AS member, box_id, c, coalesce(n, 1) AS n, {member} AS m, {dist} AS dist FROM {source} JOIN b ON b.model_id = '{model}')")


def winner(name: str, source: str = "m", more: str = "") -> str:
    """Common table ``name``(sid, member, c, box_id, top): the class that is predicted, and its box."""
    return f"""{name} AS (SELECT sid, member, c, box_id, top FROM (
  SELECT *, row_number() OVER (PARTITION BY sid, member ORDER BY CASE WHEN torn THEN dist ELSE 0 END{more}, box_id) AS place FROM (
    SELECT *, min(c) OVER (PARTITION BY sid, member) <> max(c) OVER (PARTITION BY sid, member) AS torn FROM (SELECT *, max(m) OVER (PARTITION BY sid, member) AS top FROM {source}) WHERE m = top)) WHERE place = 1)"""


_CHOSEN = "[" + ", ".join(str(random.Random(0).choice(range(n)) + 1) for n in range(1, 201)) + "]"


def likeliest(name: str, source: str = "m") -> str:
    """The same by the weight of samples: a certain box of one sample, else the class with more samples; of equals a chosen box."""
    return f"""{name} AS (SELECT sid, member, CASE WHEN k.top = 1 AND singles > 0 THEN single_c[({_CHOSEN})[singles]] ELSE c END AS c,
  CASE WHEN n_tied = 1 THEN tied[1] WHEN k.top = 1 AND singles > 0 THEN single[({_CHOSEN})[singles]] ELSE own[({_CHOSEN})[len(own)]] END AS box_id, k.top FROM (
  SELECT sid, member, top, count(*) AS n_tied, list(box_id) AS tied, count(*) FILTER (n = 1) AS singles, list(box_id ORDER BY box_id) FILTER (n = 1) AS single, list(c ORDER BY box_id) FILTER (n = 1) AS single_c
  FROM (SELECT *, max(m) OVER (PARTITION BY sid, member) AS top FROM {source}) WHERE m = top GROUP BY 1, 2, 3) k JOIN (
  SELECT sid, member, c, list(box_id ORDER BY box_id) AS own, row_number() OVER (PARTITION BY sid, member ORDER BY sum(n) DESC, c) AS place
  FROM (SELECT *, max(m) OVER (PARTITION BY sid, member) AS top FROM {source}) WHERE m = top GROUP BY 1, 2, 3) w USING (sid, member) WHERE place = 1)"""


def _predictions() -> None:
    for kind in KINDS:
        def predict(spark, d, kind=kind, rule="manhattan"):
            return score.predict(*_asked(spark, d, kind), 2, rule=rule, **how(spark, d, kind)).select("sid", "y_pred", "box_id", F.round("membership", 9).alias("membership"))

        def classes(spark, d, kind=kind):
            return score.class_memberships(*_asked(spark, d, kind), 2, **how(spark, d, kind)).select("sid", "c", F.round("membership", 9).alias("membership"), "box_id")

        def proba(spark, d, kind=kind):
            return score.class_probabilities(score.class_memberships(*_asked(spark, d, kind), 2, **how(spark, d, kind))).select("sid", "c", F.round("proba", 6).alias("proba"))

        def explain(spark, d, kind=kind):
            side = score.NEEDS[kind][0]
            held = F.size(F.get(side, F.lit(0))).cast("bigint") if kind == "eiol" else F.get(side, F.lit(0)).cast("bigint")
            return score.explain(*_asked(spark, d, kind), 2, **how(spark, d, kind)).select("sid", "y_pred", "c", F.round("membership", 9).alias("membership"), F.get("v", F.lit(0)).alias("v0"), F.get("w", F.lit(1)).alias("w1"), held.alias("held"))

        told = "SELECT sid, c AS y_pred, box_id, round(top, 9) AS membership FROM o"
        per = "k AS (SELECT sid, c, max(m) AS m, arg_max(box_id, (m, -box_id)) AS box_id FROM m GROUP BY 1, 2)"
        held = {"eiol": "len(map_keys(hist[1]))", "onehot": "bits[1]", "freqcat": "e[1]::BIGINT"}[kind]
        m = _memberships(kind)
        QUERIES[f"predict_{kind}"], SQL[f"predict_{kind}"] = predict, m + ", " + winner("o") + told
        QUERIES[f"predict_{kind}_probability"], SQL[f"predict_{kind}_probability"] = (lambda spark, d, p=predict: p(spark, d, rule="probability").select("sid", "y_pred")), m + ", " + likeliest("o") + "SELECT sid, c AS y_pred FROM o"
        QUERIES[f"membership_per_class_{kind}"], SQL[f"membership_per_class_{kind}"] = classes, m + ", " + per + " SELECT sid, c, round(m, 9) AS membership, box_id FROM k"
        QUERIES[f"predict_proba_{kind}"], SQL[f"predict_proba_{kind}"] = proba, m + ", " + per + " SELECT sid, c, round(CASE WHEN sum(m) OVER (PARTITION BY sid) = 0 THEN m ELSE m / sum(m) OVER (PARTITION BY sid) END, 6) AS proba FROM k"
        QUERIES[f"explain_{kind}"], SQL[f"explain_{kind}"] = explain, m + ", " + per + ", " + winner("o") + f" SELECT k.sid, o.c AS y_pred, k.c, round(k.m, 9) AS membership, v0, w1, {held} AS held FROM k JOIN o USING (sid) JOIN mb ON mb.box_id = k.box_id"


_MID = ["(l0 + u0) / 2", "(l1 + u1) / 2"]
_CENTRE = ["coalesce(m0, (v0 + w0) / 2)", "coalesce(m1, (v1 + w1) / 2)"]
_TO_CENTRE = f"sqrt(({_CENTRE[0]} - {_MID[0]}) * ({_CENTRE[0]} - {_MID[0]}) + ({_CENTRE[1]} - {_MID[1]}) * ({_CENTRE[1]} - {_MID[1]}))"
_WHOLE = "(SELECT * FROM s WHERE y > 0 AND x0 IS NOT NULL AND x1 IS NOT NULL)"
_LABELLED = "(SELECT * FROM s WHERE y > 0)"


def pruned_sql(m: str, rule: str = "manhattan", threshold: float = 0.5, model: str = "SELECT DISTINCT member, box_id, c FROM m", answer: str = "box_id, c") -> str:
    """Boxes kept by pruning; of the boxes without samples the validation decides."""
    more = ", -n" if rule == "centroid" else ""
    told = (lambda name, source: likeliest(name, source)) if rule == "probability" else (lambda name, source: winner(name, source, f", CASE WHEN torn THEN -n ELSE 0 END" if more else ""))
    near = "" if rule == "probability" else f"""a AS (SELECT sid, member, arg_min(box_id, (dist{more}, box_id)) AS box_id FROM (SELECT *, max(m) OVER (PARTITION BY sid, member) AS top FROM m) WHERE m = top GROUP BY 1, 2),
"""
    head = f"{likeliest('a')},\n" if rule == "probability" else near
    return m + ", " + head + f"""t AS ({model}),
h AS (SELECT a.member, a.box_id, count(*) FILTER (t.c = y) AS r, count(*) FILTER (t.c <> y AND y <> -1) AS x FROM a JOIN (SELECT DISTINCT sid, y FROM m) USING (sid) JOIN t ON t.member = a.member AND t.box_id = a.box_id GROUP BY 1, 2),
f AS (SELECT t.*, coalesce(r, 0) + coalesce(x, 0) = 0 AS unused, coalesce(r / (r + x) >= {threshold}, false) AS good FROM t LEFT JOIN h ON h.member = t.member AND h.box_id = t.box_id),
q AS (SELECT *, NOT bool_or(good) OVER (PARTITION BY member, c) AND box_id = min(box_id) OVER (PARTITION BY member, c) AS rescued FROM f),
mf AS (SELECT m.* FROM m JOIN q ON q.member = m.member AND q.box_id = m.box_id WHERE good OR unused), me AS (SELECT m.* FROM m JOIN q ON q.member = m.member AND q.box_id = m.box_id WHERE good OR rescued),
{told("pf", "mf")}, {told("pe", "me")},
af AS (SELECT member, count(*) FILTER (c = y) AS ok FROM pf JOIN (SELECT DISTINCT sid, y FROM m) USING (sid) GROUP BY 1), ae AS (SELECT member, count(*) FILTER (c = y) AS ok FROM pe JOIN (SELECT DISTINCT sid, y FROM m) USING (sid) GROUP BY 1)
SELECT {answer} FROM q LEFT JOIN af ON af.member = q.member LEFT JOIN ae ON ae.member = q.member WHERE good OR CASE WHEN coalesce(ae.ok, 0) >= coalesce(af.ok, 0) THEN rescued ELSE unused END"""


def _kept(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


def _pruning() -> None:
    labelled = lambda spark, d: inputs.labelled(spark, d)
    whole = lambda spark, d: inputs.labelled(spark, d).filter(F.col("xl")[0].isNotNull() & F.col("xl")[1].isNotNull())
    fmnn = inputs.fmnn(["x0", "x1"], V, W)
    rules = [
        ("prune_boxes", labelled, "onln_gfmm", {}, numeric(_LABELLED, _NUMBER, _L1)),
        ("prune_probability", labelled, "iol_gfmm", {"rule": "probability"}, numeric(_LABELLED, _NUMBER, _L1, "iol_gfmm")),
        ("prune_fmnn", whole, "onln_gfmm", {"kind": "fmnn"}, numeric(_WHOLE, fmnn, _L1)),
        ("prune_rfmnn", whole, "onln_gfmm", {"kind": "fmnn", "rule": "corners"}, numeric(_WHOLE, fmnn, "(abs(x0 - v0) + abs(x0 - w0) + (abs(x1 - v1) + abs(x1 - w1))) / 4")),
        ("prune_free_range", labelled, "onln_gfmm", {"kind": "free"}, numeric(_LABELLED, inputs.free_range(L, U, LO, HI), _L1)),
        ("prune_centroid", labelled, "multi_gran", {"rule": "centroid"}, numeric(_LABELLED, _NUMBER, _TO_CENTRE, "multi_gran")),
    ]
    for name, rows, model, asked, m in rules:
        _kept(name, lambda spark, d, rows=rows, model=model, asked=asked: prune.prune(rows(spark, d), inputs.boxes(spark, d, model), 2, **asked).select("box_id", "c"), pruned_sql(m, asked.get("rule", "manhattan")))
    for kind in KINDS:
        def pruned(spark, d, kind=kind):
            s, b = _asked(spark, d, kind)
            for c in score.NEEDS[kind]:
                b = b.filter(F.col(c).isNotNull())
            return prune.prune(s.filter("y > 0"), b, 2, 0.3, **how(spark, d, kind)).select("box_id", "c")

        _kept(f"prune_{kind}", pruned, pruned_sql(_memberships(kind).rstrip().removesuffix(")") + " AND y > 0)", threshold=0.3))

    def members(spark, d):
        b = inputs.boxes(spark, d, "onln_gfmm").withColumn("member_id", F.col("level"))
        return prune.prune_members(inputs.labelled(spark, d), b, 2).select("member_id", "box_id", "c")

    _kept("prune_members", members, pruned_sql(numeric(_LABELLED, _NUMBER, _L1, by="level"), answer="q.member AS member_id, box_id, c"))

    def large_ids(spark, d):
        """Boxes numbered by part, as partitioned fits number them."""
        b = inputs.boxes(spark, d, "onln_gfmm").withColumn("box_id", F.coalesce("partition_id", F.lit(0)).cast("bigint") * (1 << 32) + F.col("box_id"))
        return prune.prune(inputs.labelled(spark, d), b, 2).select("box_id", "c")

    _kept("prune_partitioned", large_ids, pruned_sql(numeric(_LABELLED, _NUMBER, _L1).replace("0 AS member, box_id,", "0 AS member, coalesce(partition_id, 0) * 4294967296 + box_id AS box_id,")))


def _classes() -> None:
    per = ", k AS (SELECT sid, c, max(m) AS m, arg_max(box_id, (m, -box_id)) AS box_id FROM m GROUP BY 1, 2) SELECT sid, c, round(m, 9) AS membership, box_id FROM k"
    for name, kind, source, member in (("membership_per_class_fmnn", "fmnn", "(SELECT * FROM s WHERE x0 IS NOT NULL AND x1 IS NOT NULL)", inputs.fmnn(["x0", "x1"], V, W)), ("membership_per_class_free_range", "free", "s", inputs.free_range(L, U, LO, HI))):
        def run(spark, d, kind=kind):
            s = inputs.samples(spark, d)
            s = s.filter(F.col("xl")[0].isNotNull() & F.col("xl")[1].isNotNull()) if kind == "fmnn" else s
            return score.class_memberships(s, inputs.boxes(spark, d, "onln_gfmm"), 2, kind=kind).select("sid", "c", F.round("membership", 9).alias("membership"), "box_id")

        QUERIES[name], SQL[name] = run, numeric(source, member, _L1) + per

    def explain_fmnn(spark, d):
        s = inputs.samples(spark, d).filter(F.col("xl")[0].isNotNull() & F.col("xl")[1].isNotNull())
        e = score.explain(s, inputs.boxes(spark, d, "onln_gfmm"), 2, kind="fmnn")
        return e.select("sid", "y_pred", "c", F.round("membership", 9).alias("membership"), F.get("v", F.lit(0)).alias("v0"), F.get("w", F.lit(1)).alias("w1"))

    QUERIES["explain_fmnn"] = explain_fmnn
    SQL["explain_fmnn"] = numeric("(SELECT * FROM s WHERE x0 IS NOT NULL AND x1 IS NOT NULL)", inputs.fmnn(["x0", "x1"], V, W), _L1) + ", " + winner("o") + ", k AS (SELECT sid, c, max(m) AS m, arg_max(box_id, (m, -box_id)) AS box_id FROM m GROUP BY 1, 2) SELECT k.sid, o.c AS y_pred, k.c, round(k.m, 9) AS membership, v0, w1 FROM k JOIN o USING (sid) JOIN b ON b.box_id = k.box_id"

    def at_partition(spark, d):
        """Predictions of the first learners of one part."""
        b = inputs.boxes(spark, d, "multi_gran").filter("partition_id = 1")
        return score.predict(inputs.samples(spark, d), b, 2, rule="centroid").select("sid", "y_pred")

    QUERIES["predict_at_partition"] = at_partition
    SQL["predict_at_partition"] = numeric("s", _NUMBER, _TO_CENTRE, "multi_gran' AND partition_id = '1") + ", " + winner("o", more=", CASE WHEN torn THEN -n ELSE 0 END") + "SELECT sid, c AS y_pred FROM o"

    def accuracy(spark, d):
        s = inputs.labelled(spark, d)
        return score.accuracy(score.predict(s, inputs.boxes(spark, d, "onln_gfmm"), 2).join(s.select("sid", "y"), "sid")).select(F.round("accuracy", 9).alias("accuracy"))

    QUERIES["accuracy_manhattan"] = accuracy
    SQL["accuracy_manhattan"] = numeric(_LABELLED, _NUMBER, _L1) + ", " + winner("o") + "SELECT round(avg((o.c = y)::INT::DOUBLE), 9) AS accuracy FROM o JOIN (SELECT DISTINCT sid, y FROM m) USING (sid)"

    def level_means(spark, d):
        """Memberships as means over the levels."""
        return granular.memberships(inputs.samples(spark, d), inputs.boxes(spark, d, "multi_gran"), 2).select("sid", "c", F.round("membership", 9).alias("membership"))

    QUERIES["granular_membership"] = level_means
    SQL["granular_membership"] = numeric("s", _NUMBER, _L1, "multi_gran", "level") + ", k AS (SELECT sid, member, c, max(m) AS m FROM m GROUP BY 1, 2, 3) SELECT sid, c, round(sum(m) / (SELECT count(DISTINCT member) FROM m), 9) AS membership FROM k GROUP BY 1, 2"


_predictions()
_pruning()
_classes()
