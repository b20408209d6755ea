"""Queries of the ordered learners, and the same folds in recursive SQL: one step per sample, or per pair of boxes to part."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfold.lineage import cut, shared_folder
from boxfold.operators import fit as fitting
from boxfold.operators import granular, prepare
from boxfold.plans import inputs, kernels
from boxfold.streaming import learner as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Rows of one part; every part is learnt by itself.
PART_ROWS = 4_000

_BOX = "STRUCT(v0 DOUBLE, v1 DOUBLE, w0 DOUBLE, w1 DOUBLE, c INT, n DOUBLE, m0 DOUBLE, m1 DOUBLE)"
_POINTS = """
p AS (SELECT sid, min(seq) AS seq, min(CASE WHEN NOT isnan(c0) THEN c0 END) AS x0, min(CASE WHEN NOT isnan(c1) THEN c1 END) AS x1, min(coalesce(c2, -1)) AS y FROM syn_num_test GROUP BY 1),
base AS ({base}),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY seq, sid) - 1) % (SELECT greatest(1, ceil(count(*) / {rows}::DOUBLE))::BIGINT FROM base) AS part FROM base),
s AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq, sid) AS i FROM dealt)"""
#: Every delivery for itself, in parts by sid.
DELIVERIES = """
base AS (SELECT sid, seq, coalesce(c2, -1) AS y, CASE WHEN NOT isnan(c0) THEN c0 END AS x0, CASE WHEN NOT isnan(c1) THEN c1 END AS x1 FROM syn_num_test),
dealt AS (SELECT *, coalesce(x0, 1.001::DOUBLE) AS l0, coalesce(x1, 1.001::DOUBLE) AS l1, coalesce(x0, -0.001::DOUBLE) AS u0, coalesce(x1, -0.001::DOUBLE) AS u1, sid % (SELECT greatest(1, ceil(count(*) / {rows}::DOUBLE))::BIGINT FROM base) AS part FROM base),
s AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq, sid) AS i FROM dealt)"""
WHOLE = "SELECT sid, seq, y, greatest(0, least(1, x0)) AS l0, greatest(0, least(1, x1)) AS l1, l0 AS u0, l1 AS u1 FROM p WHERE y > 0 AND x0 IS NOT NULL AND x1 IS NOT NULL"
EVERY = "SELECT sid, seq, y, coalesce(x0, 1.001::DOUBLE) AS l0, coalesce(x1, 1.001::DOUBLE) AS l1, coalesce(x0, -0.001::DOUBLE) AS u0, coalesce(x1, -0.001::DOUBLE) AS u1 FROM p"

_LO, _HI = ["least(b.v0, b.w0)", "least(b.v1, b.w1)"], ["greatest(b.v0, b.w0)", "greatest(b.v1, b.w1)"]
_L, _U = ["l0", "l1"], ["u0", "u1"]
_V, _W = ["b.v0", "b.v1"], ["b.w0", "b.w1"]
_GROWN = "least(b.v0, l0) AS v0, least(b.v1, l1) AS v1, greatest(b.w0, u0) AS w0, greatest(b.w1, u1) AS w1"


def _edges(limit: str) -> str:
    return f"greatest(b.w0, u0) - least(b.v0, l0) <= {limit} AND greatest(b.w1, u1) - least(b.v1, l1) <= {limit}"


def _meet(v: list[str], w: list[str], x: str) -> str:
    """Box (v, w) meets box x; missing dimensions meet nothing."""
    formed = f"{v[0]} <= {w[0]} AND {v[1]} <= {w[1]} AND {x}.v0 <= {x}.w0 AND {x}.v1 <= {x}.w1"
    return f"({formed} AND {inputs.gfmm(w, v, [f'{x}.v0', f'{x}.v1'], [f'{x}.w0', f'{x}.w1'])} = 1)"


def _meet_free(v: list[str], w: list[str], x: str) -> str:
    return f"(least({w[0]}, {x}.w0) >= greatest({v[0]}, {x}.v0) AND least({w[1]}, {x}.w1) >= greatest({v[1]}, {x}.v1))"


_GV, _GW = ["least(boxes[r.k].v0, l0)", "least(boxes[r.k].v1, l1)"], ["greatest(boxes[r.k].w0, u0)", "greatest(boxes[r.k].w1, u1)"]
_NEW = "{'v0': l0, 'v1': l1, 'w0': u0, 'w1': u1, 'c': y, 'n': 1.0::DOUBLE, 'm0': (l0 + u0) / 2, 'm1': (l1 + u1) / 2}"
_PUT = """list_transform(boxes, lambda b, k: CASE WHEN k = j THEN {'v0': CASE WHEN grow THEN least(b.v0, l0) ELSE b.v0 END, 'v1': CASE WHEN grow THEN least(b.v1, l1) ELSE b.v1 END,
  'w0': CASE WHEN grow THEN greatest(b.w0, u0) ELSE b.w0 END, 'w1': CASE WHEN grow THEN greatest(b.w1, u1) ELSE b.w1 END, 'c': CASE WHEN y <> -1 AND b.c = -1 THEN y ELSE b.c END, 'n': b.n + 1.0,
  'm0': (b.m0 * b.n + (l0 + u0) / 2) / (b.n + 1.0), 'm1': (b.m1 * b.n + (l1 + u1) / 2) / (b.n + 1.0)} ELSE b END)"""


def fold_sql(base: str, rows: int, *, own: str, membership: str, decide: str, part: str | None = None, step: dict | None = None, rivals: str = "", split: bool = False, source: str = _POINTS, extra: dict[str, tuple[str, str, str]] | None = None, also: tuple[str, ...] = ()) -> str:
    """Boxes of all parts.

    ``own``: which boxes b may take the sample; ``membership``: of b; ``decide``: from the ranked list ``ranked`` of (m, k, f: first in order of
    membership then of age) a struct (j: box that takes the sample, grow: whether its corners do, skip: nothing happens); no box: a new one.
    ``extra``: further fields of a box, each with its type, its value in a new box and in a box b that takes the sample; ``also``: further columns of samples.
    ``part``: (case, feature) in SQL; ``rivals``: boxes b that the box g, just grown, is to be parted from."""
    case, dim = part if part else ("NULL", "NULL")
    extra = extra or {}
    made = _NEW[:-1] + "".join(f", '{f}': {new}" for f, (_, new, _) in extra.items()) + "}"
    taken = _PUT.replace("} ELSE b END)", "".join(f", '{f}': {put}" for f, (_, _, put) in extra.items()) + "} ELSE b END)")
    box = _BOX[:-1] + "".join(f", {f} {kind}" for f, (kind, _, _) in extra.items()) + ")"
    corners = kernels.corner_sql(step) if step else {}
    fields = lambda side: ", ".join(f"'{f}': {corners[f'{c}{side}_{q}']}" for f, c, q in (("v0", "v", 0), ("v1", "v", 1), ("w0", "w", 0), ("w1", "w", 1)))
    keep = lambda k: f"'c': boxes[{k}].c, 'n': boxes[{k}].n, 'm0': boxes[{k}].m0, 'm1': boxes[{k}].m1" + "".join(f", '{f}': boxes[{k}].{f}" for f in extra)
    parted = f"list_transform(boxes, lambda b, k: CASE WHEN k = j AND cs IS NOT NULL THEN {{{fields(1)}, {keep('j')}}} WHEN k = pend[1] AND cs IS NOT NULL THEN {{{fields(2)}, {keep('pend[1]')}}} ELSE b END)" if step else "boxes"
    widths = ["least(b.w0 - l0, u0 - b.v0)", "least(b.w1 - l1, u1 - b.v1)"]
    zero = f"({widths[0]} = 0 AND {widths[1]} = 0)"
    first = f"CASE WHEN {zero} OR {widths[0]} <> 0 THEN {widths[0]} ELSE 1e308 END <= CASE WHEN {zero} OR {widths[1]} <> 0 THEN {widths[1]} ELSE 1e308 END"
    cut0 = f"(b.c <> y AND {_meet_free(_L, _U, 'b')} AND {first} AND b.v0 < l0 AND u0 < b.w0)"
    cut1 = f"(b.c <> y AND {_meet_free(_L, _U, 'b')} AND NOT {first} AND b.v1 < l1 AND u1 < b.w1)"
    shrunk = f"list_transform(boxes, lambda b: CASE WHEN {cut0} THEN {{'v0': b.v0, 'v1': b.v1, 'w0': l0 - 0.001, 'w1': b.w1, 'c': b.c, 'n': b.n, 'm0': b.m0, 'm1': b.m1}} WHEN {cut1} THEN {{'v0': b.v0, 'v1': b.v1, 'w0': b.w0, 'w1': l1 - 0.001, 'c': b.c, 'n': b.n, 'm0': b.m0, 'm1': b.m1}} ELSE b END)"
    low = ["(CASE WHEN d THEN u0 + 0.001 ELSE b.v0 END)", "(CASE WHEN d THEN b.v1 ELSE u1 + 0.001 END)"]
    pieces = f"list_transform(list_filter(boxes, lambda b: {cut0} OR {cut1}), lambda b: {{'v0': {low[0]}, 'v1': {low[1]}, 'w0': b.w0, 'w1': b.w1, 'c': b.c, 'n': b.n, 'm0': ({low[0]} + b.w0) / 2, 'm1': ({low[1]} + b.w1) / 2}})".replace(" d THEN", f" {cut0} THEN")
    added = f"{shrunk} || [{made}] || {pieces}" if split else f"list_append(boxes, {made})"
    pending = f"list_filter(range(1, len(after) + 1), lambda k: CASE WHEN skip OR j IS NULL OR NOT grow OR k = j THEN false ELSE {rivals.replace('g.', 'after[j].').replace('b.', 'after[k].')} END)" if rivals else "[]::BIGINT[]"
    busy = f"""
  SELECT part, i, {parted} AS boxes, j, pend[2:] AS pend FROM (SELECT *, {case} AS cs, {dim} AS dim FROM (
    SELECT *, boxes[j].v0 AS a0, boxes[j].v1 AS a1, boxes[j].w0 AS b0, boxes[j].w1 AS b1, boxes[pend[1]].v0 AS c0, boxes[pend[1]].v1 AS c1, boxes[pend[1]].w0 AS d0, boxes[pend[1]].w1 AS d1 FROM (
      SELECT f.part, f.i, f.boxes, f.j, f.pend, s.l0, s.l1 FROM fold f JOIN s ON s.part = f.part AND s.i = f.i WHERE len(f.pend) > 0)))
  UNION ALL""" if step else ""
    return f"""WITH RECURSIVE {source.format(base=base, rows=rows).strip()},
fold(part, i, boxes, j, pend) USING KEY (part) AS (
  SELECT DISTINCT part, 0::BIGINT, []::{box}[], NULL::BIGINT, []::BIGINT[] FROM s
  UNION ALL (
  {busy}
  SELECT part, i, after AS boxes, j, {pending} AS pend FROM (
    SELECT *, CASE WHEN skip THEN boxes WHEN j IS NULL THEN {added} ELSE {taken} END AS after FROM (
      SELECT *, coalesce(told.skip, false) AS skip, told.j AS j, coalesce(told.grow, false) AS grow FROM (
        SELECT *, {decide} AS told FROM (
          SELECT *, list_reverse_sort(list_filter(list_transform(boxes, lambda b, k: {{'m': {membership}, 'k': k, 'own': {own}}}), lambda r: r.own)) AS ranked FROM (
            SELECT f.part, s.i, f.boxes, s.l0, s.l1, s.u0, s.u1, s.y{"".join(f", s.{c}" for c in also)} FROM fold f JOIN s ON s.part = f.part AND s.i = f.i + 1 WHERE len(f.pend) = 0)))))))
SELECT part::INT AS partition_id, part * 4294967296 + k AS box_id, b.c AS c, round(b.v0, 9) AS v0, round(b.v1, 9) AS v1, round(b.w0, 9) AS w0, round(b.w1, 9) AS w1, b.n AS n_samples, round(b.m0, 9) AS m0, round(b.m1, 9) AS m1
FROM (SELECT part, unnest(boxes) AS b, unnest(range(1, len(boxes) + 1)) AS k FROM fold)
"""


_TOLD = """SELECT part::INT AS partition_id, part * 4294967296 + k AS box_id, b.c AS c, round(b.v0, 9) AS v0, round(b.v1, 9) AS v1, round(b.w0, 9) AS w0, round(b.w1, 9) AS w1, b.n AS n_samples, round(b.m0, 9) AS m0, round(b.m1, 9) AS m1{more}
FROM (SELECT part, unnest(boxes) AS b, unnest(range(1, len(boxes) + 1)) AS k FROM fold)
"""


def told(sql: str, more: str = "") -> str:
    """``fold_sql`` with further columns of its boxes b."""
    return sql[: sql.rindex("SELECT part::INT")] + _TOLD.format(more=more)


def flat(boxes: DataFrame, *more: Column) -> DataFrame:
    """Boxes of two features as plain columns."""
    two = [F.round(F.get(c, F.lit(j)), 9).alias(f"{n}{j}") for c, n in (("v", "v"), ("w", "w"), ("centroid", "m")) for j in (0, 1)]
    return boxes.select("partition_id", "box_id", "c", "n_samples", *two, *more)


def _learner(name: str, learner: str, sql: Callable[[str, int], str] | None, rows: int = PART_ROWS, unlabelled: bool = True, missing: bool = True, **params) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = inputs.samples(spark, d) if missing else inputs.whole_samples(spark, d)
        return flat(fitting.partitioned(s if unlabelled else s.filter("y > 0"), learner, rows, **params))

    QUERIES[name] = run
    if sql:
        SQL[name] = sql(EVERY if missing else WHOLE, rows)


def _fmnn(theta: float, whole_edge: bool, efmnn: bool, nearest: int = 0) -> Callable[[str, int], str]:
    fits = f"(({_GW[0]} - {_GV[0]}) + ({_GW[1]} - {_GV[1]}) <= {theta * 2})" if not whole_edge else f"({_GW[0]} - {_GV[0]} <= {theta} AND {_GW[1]} - {_GV[1]} <= {theta})"
    # the first of the equally best, or the first of the k best that covers or may grow
    pick = f"list_filter(ranked[1:{nearest}], lambda r: r.m = 1 OR {fits})[1]" if nearest else "list_filter(ranked, lambda r: r.m = ranked[1].m)[-1]"
    decide = f"list_transform([{pick}], lambda r: {{'j': CASE WHEN r IS NOT NULL AND r.m < 1 AND {fits} THEN r.k END, 'grow': true, 'skip': coalesce(r.m = 1, false)}})[1]"
    case = kernels.efmnn_case_sql(("l0", "l1")) if efmnn else kernels.fmnn_case_sql()
    return lambda base, rows: fold_sql(base, rows, own="b.c = y", membership=inputs.fmnn(_L, _V, _W), decide=decide, part=case, step=kernels.FMNN_STEP, rivals=f"b.c <> g.c AND {_meet_free(['g.v0', 'g.v1'], ['g.w0', 'g.w1'], 'b')}")


def _rfmnn(theta: float) -> Callable[[str, int], str]:
    blocked = f"list_filter(boxes, lambda o: o.c <> y AND {_meet_free(_GV, _GW, 'o')}) = []"
    fits = f"({_GW[0]} - {_GV[0]} <= {theta} AND {_GW[1]} - {_GV[1]} <= {theta} AND {blocked})"
    decide = f"list_transform([list_filter(ranked, lambda r: r.m = ranked[1].m)[-1]], lambda r: {{'j': CASE WHEN r IS NOT NULL AND r.m < 1 AND {fits} THEN r.k END, 'grow': true, 'skip': coalesce(r.m = 1, false)}})[1]"
    return lambda base, rows: fold_sql(base, rows, own="b.c = y", membership=inputs.fmnn(_L, _V, _W), decide=decide, split=True)


_OPEN = "(b.c = y OR b.c = -1 OR y = -1)"


def _improved(theta: float, gamma: float = 1.0, source: str = _POINTS) -> Callable[[str, int], str]:
    g = _GV, _GW
    other = "(o.c <> (CASE WHEN y = -1 THEN boxes[r.k].c ELSE y END) OR o.c = -1) AND NOT (y = -1 AND boxes[r.k].c = -1 AND o.v0 = boxes[r.k].v0 AND o.v1 = boxes[r.k].v1)"
    fits = f"r.m >= {1 - gamma * theta!r} AND {_GW[0]} - {_GV[0]} <= {theta} AND {_GW[1]} - {_GV[1]} <= {theta}"
    free = f"list_filter(list_filter(ranked, lambda r: {fits}), lambda r: list_filter(boxes, lambda o: {other} AND {_meet(*g, 'o')}) = [])[1].k"
    covers = "list_filter(ranked, lambda r: r.m = 1 AND (boxes[r.k].c = y OR boxes[r.k].c = -1))[1].k"
    decide = f"CASE WHEN ranked[1].m = 1 THEN {{'j': {covers}, 'grow': false, 'skip': {covers} IS NULL}} ELSE {{'j': {free}, 'grow': true, 'skip': false}} END"
    return lambda base, rows: fold_sql(base, rows, own=_OPEN, membership=inputs.gfmm(_L, _U, _LO, _HI, gamma), decide=decide, source=source)


def _online(theta: float | str, **how) -> Callable[[str, int], str]:
    least = f"1 - {theta}" if isinstance(theta, str) else repr(1 - theta)
    fits = f"r.m >= {least} AND {_GW[0]} - {_GV[0]} <= {theta} AND {_GW[1]} - {_GV[1]} <= {theta}"
    decide = f"{{'j': list_filter(ranked, lambda r: {fits})[1].k, 'grow': true, 'skip': coalesce(ranked[1].m = 1 AND (boxes[ranked[1].k].c = y OR y = -1), false)}}"
    return lambda base, rows: fold_sql(base, rows, own=_OPEN, membership=inputs.gfmm(_L, _U, _LO, _HI), decide=decide, part=_gfmm_part(2.0), step=kernels.GFMM_STEP, rivals=_rivals(_meet(["g.v0", "g.v1"], ["g.w0", "g.w1"], "b")), **how)


def _rivals(meet: str) -> str:
    return f"(b.c <> g.c OR g.c = -1) AND {meet}"


def _gfmm_part(limit: float) -> tuple[str, str]:
    """Parts boxes j and pend[1] where they still meet."""
    case, dim = kernels.gfmm_case_sql()
    still = f"a0 <= b0 AND a1 <= b1 AND c0 <= d0 AND c1 <= d1 AND {inputs.gfmm(['b0', 'b1'], ['a0', 'a1'], ['c0', 'c1'], ['d0', 'd1'])} = 1" if limit == 2.0 else "least(b0, d0) >= greatest(a0, c0) AND least(b1, d1) >= greatest(a1, c1)"
    case, dim = (x if limit == 2.0 else x.replace("< 2)", f"< {limit})").replace("< 2 ", f"< {limit} ") for x in (case, dim))
    return f"CASE WHEN {still} THEN {case} END", f"CASE WHEN {still} THEN {dim} END"


def _inf(theta: float, least: float) -> Callable[[str, int], str]:
    share = [f"((boxes[r.k].w{j} - boxes[r.k].v{j}) / ({_GW[j]} - {_GV[j]} + 1e-5))" for j in (0, 1)]
    fits = f"r.m >= {least} AND ({share[0]} = 0 OR {share[0]} >= {theta}) AND ({share[1]} = 0 OR {share[1]} >= {theta})"
    decide = f"{{'j': list_filter(ranked, lambda r: {fits})[1].k, 'grow': true, 'skip': coalesce(ranked[1].m = 1 AND (boxes[ranked[1].k].c = y OR y = -1), false)}}"
    return lambda base, rows: fold_sql(base, rows, own="(b.c = y OR b.c = -1)", membership=inputs.free_range(_L, _U, _LO, _HI), decide=decide, part=_gfmm_part(1e308), step=kernels.GFMM_STEP, rivals=_rivals(_meet_free(["g.v0", "g.v1"], ["g.w0", "g.w1"], "b")))


_learner("fit_fmnn", "fmnn", _fmnn(0.1, False, False), missing=False, theta=0.1)
_learner("fit_efmnn", "efmnn", _fmnn(0.1, True, True), missing=False, theta=0.1)
_learner("fit_knefmnn", "knefmnn", _fmnn(0.1, True, True, 5), missing=False, theta=0.1, k_neighbors=5)
_learner("fit_rfmnn", "rfmnn", _rfmnn(0.1), missing=False, theta=0.1)
_learner("fit_online_gfmm", "online", _online(0.1), theta=0.1, theta_min=0.1)
_learner("fit_iol_gfmm", "improved", _improved(0.1), theta=0.1)
_learner("fit_semi_supervised", "improved", _improved(0.1, 2.0), theta=0.1, gamma=2.0)
_learner("fit_inf_gfmm", "inf", _inf(0.3, 0.5), theta=0.3, min_membership_expansion=0.5)
# two passes, the second with a smaller theta; a third would be under theta_min
_TWICE = _POINTS[: _POINTS.rindex("s AS (")] + "s AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY theta DESC, seq, sid) AS i FROM dealt, (VALUES (0.2::DOUBLE), (0.2::DOUBLE * 0.7::DOUBLE)) t(theta))"
_learner("fit_online_gfmm_passes", "online", _online("theta", source=_TWICE, also=("theta",)), missing=False, theta=0.2, theta_min=0.1, alpha=0.7)


def fit_continued(spark: SparkSession, d: str) -> DataFrame:
    """The second half of the samples goes on from the boxes of the first, which gives what one fit of all gives."""
    s = inputs.whole_samples(spark, d)
    s = prepare.dealt(s, "y", fitting.parts_for(s, PART_ROWS))
    middle = s.agg(F.percentile_approx("seq", 0.5).alias("m")).first()["m"] or 0
    first = cut(fitting.fit(s.filter(F.col("seq") <= middle), "improved", ["partition_id"], theta=0.1))
    boxes = fitting.fit(s.filter(F.col("seq") > middle), "improved", ["partition_id"], first, theta=0.1)
    return flat(boxes.withColumn("box_id", F.col("partition_id").cast("bigint") * (1 << 32) + F.col("box_id")))


QUERIES["fit_continued"] = fit_continued
SQL["fit_continued"] = _improved(0.1)(WHOLE, PART_ROWS)

#: Deliveries of one file of the stream.
STREAM_ROWS = 500_000


def stream_iol(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries as a stream of files in order of arrival, one file a micro-batch; every micro-batch goes on from the boxes before it."""
    table, folder = inputs.table(spark, d, "syn_num_test"), shared_folder(spark, "stream")
    n = table.count()
    slices = max(3, -(-n // STREAM_ROWS))
    cuts = table.agg(F.percentile_approx("seq", [k / slices for k in range(1, slices)], 10_000).alias("c")).first()["c"] or []
    for lo, hi in zip([None, *cuts], [*cuts, None]):  # one job per file, written in order
        part = table if lo is None else table.filter(F.col("seq") > lo)
        (part if hi is None else part.filter(F.col("seq") <= hi)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    x = F.array(*[F.when(~F.isnan(c), F.col(c)) for c in ("c0", "c1")])
    parts = max(1, -(-n // PART_ROWS))
    s = rows.select("sid", "seq", x.alias("xl"), x.alias("xu"), F.coalesce("c2", F.lit(-1)).alias("y"), F.pmod("sid", F.lit(parts)).cast("int").alias("partition_id"))
    stream.learn_stream(s, f"{folder}/boxes", f"{folder}/progress", by=("partition_id",), theta=0.1).awaitTermination()
    boxes = stream.latest(spark, f"{folder}/boxes")
    return flat(boxes.withColumn("box_id", F.col("partition_id").cast("bigint") * (1 << 32) + F.col("box_id")))


QUERIES["stream_iol"] = stream_iol
SQL["stream_iol"] = _improved(0.1, source=DELIVERIES)("", PART_ROWS)


def agglomerative2_sql(base: str, rows: int, theta: float, floor: float) -> str:
    """Box after box looks for its best partner, until a whole pass merges nothing: one step per box looked at."""
    box = lambda x: ([f"{x}.v0", f"{x}.v1"], [f"{x}.w0", f"{x}.w1"])
    (v, w), (bv, bw) = box("boxes[k]"), box("b")
    similar = f"greatest({inputs.gfmm(v, w, bv, bw)}, {inputs.gfmm(bv, bw, v, w)})"
    uv, uw = [f"least(boxes[k].v{j}, boxes[r.t].v{j})" for j in (0, 1)], [f"greatest(boxes[k].w{j}, boxes[r.t].w{j})" for j in (0, 1)]
    fits = f"{uw[0]} - {uv[0]} <= {theta} AND {uw[1]} - {uv[1]} <= {theta} AND list_filter(boxes, lambda o: o.c <> boxes[k].c AND {_meet(uv, uw, 'o')}) = []"
    mean = lambda m: f"(boxes[i].{m} * boxes[i].n + boxes[j].{m} * boxes[j].n) / (boxes[i].n + boxes[j].n)"
    one = f"{{'v0': least(boxes[i].v0, boxes[j].v0), 'v1': least(boxes[i].v1, boxes[j].v1), 'w0': greatest(boxes[i].w0, boxes[j].w0), 'w1': greatest(boxes[i].w1, boxes[j].w1), 'c': boxes[i].c, 'n': boxes[i].n + boxes[j].n, 'm0': {mean('m0')}, 'm1': {mean('m1')}}}"
    return f"""WITH RECURSIVE {_POINTS.format(base=base, rows=rows).strip()},
fold(part, boxes, k, merged) USING KEY (part) AS (
  SELECT part, list({_NEW} ORDER BY i)::{_BOX}[], 1::BIGINT, false FROM s GROUP BY 1
  UNION ALL
  SELECT part, after AS boxes, CASE WHEN again THEN 1 ELSE ahead END AS k, CASE WHEN again THEN false ELSE found END AS merged FROM (
    SELECT *, ahead > len(after) AND found AS again FROM (
      SELECT part, merged OR t IS NOT NULL AS found, CASE WHEN t IS NULL OR k < t THEN k + 1 ELSE k END AS ahead,
             CASE WHEN t IS NULL THEN boxes ELSE list_transform(boxes, lambda b, p: CASE WHEN p = i THEN {one} ELSE b END)[1 : j - 1] || boxes[j + 1 :] END AS after FROM (
        SELECT *, least(k, t) AS i, greatest(k, t) AS j FROM (
          SELECT *, list_filter(ranked, lambda r: {fits})[1].t AS t FROM (
            SELECT *, list_reverse_sort(list_filter(list_transform(boxes, lambda b, p: {{'s': {similar}, 't': p, 'own': b.c = boxes[k].c AND p <> k}}), lambda r: r.own AND r.s >= {floor})) AS ranked FROM fold WHERE k <= len(boxes)))))))
SELECT part::INT AS partition_id, part * 4294967296 + k AS box_id, b.c AS c, round(b.v0, 9) AS v0, round(b.v1, 9) AS v1, round(b.w0, 9) AS w0, round(b.w1, 9) AS w1, b.n AS n_samples, round(b.m0, 9) AS m0, round(b.m1, 9) AS m1
FROM (SELECT part, unnest(boxes) AS b, unnest(range(1, len(boxes) + 1)) AS k FROM fold)
"""


def agglomerative_sql(base: str, rows: int, theta: float, floor: float) -> str:
    """Rounds of merges of the most similar pairs: one step per merge, or per new round, in which all pairs are ranked again."""
    box = lambda x: ([f"{x}.v0", f"{x}.v1"], [f"{x}.w0", f"{x}.w1"])
    (pv, pw), (qv, qw) = box("boxes[p]"), box("boxes[q]")
    similar = f"greatest({inputs.gfmm(pv, pw, qv, qw)}, {inputs.gfmm(qv, qw, pv, pw)})"
    uv, uw = [f"least(boxes[r.p].v{j}, boxes[r.q].v{j})" for j in (0, 1)], [f"greatest(boxes[r.p].w{j}, boxes[r.q].w{j})" for j in (0, 1)]
    fits = f"{uw[0]} - {uv[0]} <= {theta} AND {uw[1]} - {uv[1]} <= {theta} AND list_filter(boxes, lambda o: o.c <> boxes[r.p].c AND {_meet(uv, uw, 'o')}) = []"
    mean = lambda m: f"(boxes[i].{m} * boxes[i].n + boxes[j].{m} * boxes[j].n) / (boxes[i].n + boxes[j].n)"
    one = f"{{'v0': least(boxes[i].v0, boxes[j].v0), 'v1': least(boxes[i].v1, boxes[j].v1), 'w0': greatest(boxes[i].w0, boxes[j].w0), 'w1': greatest(boxes[i].w1, boxes[j].w1), 'c': boxes[i].c, 'n': boxes[i].n + boxes[j].n, 'm0': {mean('m0')}, 'm1': {mean('m1')}}}"
    every = f"flatten(list_transform(range(1, len(boxes) + 1), lambda p: list_transform(range(p + 1, len(boxes) + 1), lambda q: {{'s': CASE WHEN boxes[p].c = boxes[q].c THEN {similar} ELSE -1 END, 'p': p, 'q': q}})))"
    after = "list_transform(list_filter(pairs, lambda r: r.s >= hit.s AND (r.s, r.p, r.q) < (hit.s, hit.p, hit.q) AND r.p <> hit.p AND r.p <> hit.q AND r.q <> hit.p AND r.q <> hit.q), lambda r: {'s': r.s, 'p': r.p - (r.p > hit.q)::BIGINT, 'q': r.q - (r.q > hit.q)::BIGINT})"
    return f"""WITH RECURSIVE {_POINTS.format(base=base, rows=rows).strip()},
fold(part, boxes, pairs, merged, fresh) USING KEY (part) AS (
  SELECT part, list({_NEW} ORDER BY i)::{_BOX}[], []::STRUCT(s DOUBLE, p BIGINT, q BIGINT)[], false, true FROM s GROUP BY 1
  UNION ALL (
  SELECT part, boxes, list_reverse_sort(list_filter({every}, lambda r: r.s >= {floor} AND r.s > 0)) AS pairs, false AS merged, false AS fresh FROM fold WHERE fresh
  UNION ALL
  SELECT part, CASE WHEN hit IS NULL THEN boxes ELSE list_transform(boxes, lambda b, k: CASE WHEN k = i THEN {one} ELSE b END)[1 : j - 1] || boxes[j + 1 :] END AS boxes,
         CASE WHEN hit IS NULL THEN [] ELSE {after} END AS pairs, hit IS NOT NULL OR merged AS merged, hit IS NULL AND merged AS fresh FROM (
    SELECT *, hit.p AS i, hit.q AS j FROM (SELECT *, list_filter(pairs, lambda r: {fits})[1] AS hit FROM fold WHERE NOT fresh)) WHERE hit IS NOT NULL OR merged))
{_TOLD.format(more="")}"""


# all pairs of a part are compared, so parts are small
_learner("fit_agglo2", "agglomerative2", lambda base, rows: agglomerative2_sql(base, rows, 0.2, 0.8), rows=500, missing=False, theta=0.2, min_simil=0.8)
_learner("fit_agglo_sm", "agglomerative", lambda base, rows: agglomerative_sql(base, rows, 0.2, 0.8), rows=150, missing=False, theta=0.2, min_simil=0.8)


def fit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of every part: rows, boxes and passes."""
    s = inputs.whole_samples(spark, d)
    return fitting.fit_summary(prepare.dealt(s, "y", fitting.parts_for(s, PART_ROWS)), "improved", ["partition_id"], theta=0.1).select("partition_id", "n_rows", "n_boxes", "n_passes", (F.col("seconds") >= 0).alias("timed"))


QUERIES["fit_summary"] = fit_summary
SQL["fit_summary"] = SQL["fit_continued"][: SQL["fit_continued"].rindex("SELECT part::INT")] + "SELECT part::INT AS partition_id, i AS n_rows, len(boxes)::BIGINT AS n_boxes, 1 AS n_passes, true AS timed FROM fold"


# Mixed learners ----------------------------------------------------------------------------------------------------

_MIXED = f"""{inputs.CODES.strip().split("mb AS (")[0].rstrip().rstrip(",")},
base AS (SELECT c.sid, c.y, coalesce(x0, 1.001::DOUBLE) AS l0, coalesce(x1, 1.001::DOUBLE) AS l1, coalesce(x0, -0.001::DOUBLE) AS u0, coalesce(x1, -0.001::DOUBLE) AS u1, q.seq, CASE WHEN k0 IS NULL THEN 0 ELSE 1::BIGINT << k0 END AS bit0, CASE WHEN k1 IS NULL THEN 0 ELSE 1::BIGINT << k1 END AS bit1,
         coalesce(c4, '100000') AS cat0, coalesce(c6, '100000') AS cat1 FROM coded c JOIN (SELECT sid, min(seq) AS seq, min(c4) AS c4, min(c6) AS c6 FROM japanese_credit GROUP BY 1) q ON q.sid = c.sid),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY seq, sid) - 1) % (SELECT greatest(1, ceil(count(*) / {{rows}}::DOUBLE))::BIGINT FROM base) AS part FROM base),
s AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq, sid) AS i FROM dealt)"""
MIXED_ROWS = 1_000


def _onehot_sql(theta: float) -> str:
    shared = "((CASE WHEN bit0 & b.b0 <> 0 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN bit1 & b.b1 <> 0 THEN 1.0::DOUBLE ELSE 0 END)) / 2"
    joins = "(bit0 & boxes[r.k].b0 <> 0 OR bit1 & boxes[r.k].b1 <> 0)"
    fits = f"{_GW[0]} - {_GV[0]} <= {theta} AND {_GW[1]} - {_GV[1]} <= {theta} AND {joins}"
    decide = f"{{'j': list_filter(ranked, lambda r: {fits})[1].k, 'grow': true, 'skip': coalesce(ranked[1].m = 1 AND (boxes[ranked[1].k].c = y OR y = -1), false)}}"
    extra = {f"b{j}": ("BIGINT", f"bit{j}", f"b.b{j} | bit{j}") for j in (0, 1)}
    sql = fold_sql("", MIXED_ROWS, own=_OPEN, membership=f"({inputs.gfmm(_L, _U, _LO, _HI)} + {shared}) / 2", decide=decide, part=_gfmm_part(2.0), step=kernels.GFMM_STEP, rivals=_rivals(_meet(["g.v0", "g.v1"], ["g.w0", "g.w1"], "b")), source=_MIXED, extra=extra, also=("bit0", "bit1"))
    return told(sql, ", b.b0 AS bits0, b.b1 AS bits1")


def _eiol_sql(theta: float, delta: float, alpha: float = 0.5) -> str:
    count = lambda h, x: f"coalesce({h}[{x}], 0)"
    fit = f"({count('b.h0', 'cat0')} + {count('b.h1', 'cat1')})::DOUBLE / b.n / 2"
    grown = lambda h, x: f"(CASE WHEN {h}[{x}] IS NULL THEN map_concat({h}, MAP([{x}], [1::BIGINT])) ELSE map_concat({h}, MAP([{x}], [{h}[{x}] + 1])) END)"
    bits = lambda h: f"list_sum(list_transform(map_values({h}), lambda c: -(c / list_sum(map_values({h}))::DOUBLE) * log2(c / list_sum(map_values({h}))::DOUBLE)))"
    even = " AND ".join(f"{bits(grown(f'boxes[r.k].h{j}', f'cat{j}'))} - boxes[r.k].n / (boxes[r.k].n + 1) * {bits(f'boxes[r.k].h{j}')} <= {delta}" for j in (0, 1))
    same = lambda j: f"list_filter(map_keys(o.h{j}), lambda x: coalesce(o.h{j}[x] / o.n = ({grown(f'boxes[r.k].h{j}', f'cat{j}')})[x] / (boxes[r.k].n + 1), false)) <> []"
    other = "(o.c <> (CASE WHEN y = -1 THEN boxes[r.k].c ELSE y END) OR o.c = -1) AND NOT (y = -1 AND boxes[r.k].c = -1 AND o.v0 = boxes[r.k].v0 AND o.v1 = boxes[r.k].v1)"
    fits = f"{_GW[0]} - {_GV[0]} <= {theta} AND {_GW[1]} - {_GV[1]} <= {theta}"
    free = f"list_filter(list_filter(list_filter(ranked, lambda r: {fits}), lambda r: {even}), lambda r: list_filter(boxes, lambda o: {other} AND {_meet(_GV, _GW, 'o')} AND {same(0)} AND {same(1)}) = [])[1].k"
    covers = "list_filter(ranked, lambda r: r.m = 1 AND boxes[r.k].c = y)[1].k"
    decide = f"CASE WHEN ranked[1].m = 1 THEN {{'j': {covers}, 'grow': false, 'skip': {covers} IS NULL}} ELSE {{'j': {free}, 'grow': true, 'skip': false}} END"
    extra = {f"h{j}": ("MAP(VARCHAR, BIGINT)", f"MAP([cat{j}], [1::BIGINT])", grown(f"b.h{j}", f"cat{j}")) for j in (0, 1)}
    sql = fold_sql("", MIXED_ROWS, own=_OPEN, membership=f"{alpha}::DOUBLE * {inputs.gfmm(_L, _U, _LO, _HI)} + {1 - alpha}::DOUBLE * ({fit})", decide=decide, source=_MIXED, extra=extra, also=("cat0", "cat1"))
    return told(sql, ", len(map_keys(b.h0)) AS values0, len(map_keys(b.h1)) AS values1")


def _mixed(name: str, kind: str, more: Callable[[], list[Column]], sql: str, **params) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return flat(fitting.partitioned(cut(inputs.mixed_training(spark, d, kind)), kind, MIXED_ROWS, **params), *more())

    QUERIES[name], SQL[name] = run, sql


_mixed("fit_onehot", "onehot", lambda: [F.get("bits", F.lit(j)).alias(f"bits{j}") for j in (0, 1)], _onehot_sql(0.3), theta=0.3, theta_min=0.3)
_mixed("fit_eiol", "eiol", lambda: [F.size(F.get("hist", F.lit(j))).cast("bigint").alias(f"values{j}") for j in (0, 1)], _eiol_sql(0.3, 0.4), theta=0.3, delta=0.4)


# Granular learning -------------------------------------------------------------------------------------------------


def contained_sql(name: str, rows: str) -> str:
    """Common tables up to ``name``(c, id, v0 … m1): what is left of ``rows`` (the same columns) after boxes inside others of their class gave their weight on."""
    into = inputs.gfmm(["boxes[i + 1].v0", "boxes[i + 1].v1"], ["boxes[i + 1].w0", "boxes[i + 1].w1"], ["boxes[k].v0", "boxes[k].v1"], ["boxes[k].w0", "boxes[k].w1"])
    away = "sqrt((boxes[k].m0 - boxes[i + 1].m0) * (boxes[k].m0 - boxes[i + 1].m0) + (boxes[k].m1 - boxes[i + 1].m1) * (boxes[k].m1 - boxes[i + 1].m1))"
    holder = f"list_sort(list_transform(list_filter(range(1, len(boxes) + 1), lambda k: k <> i + 1 AND boxes[k].kept AND {into} = 1), lambda k: {{'d': -{away}, 'k': k}}))[1].k"
    same = "'id': b.id, 'v0': b.v0, 'v1': b.v1, 'w0': b.w0, 'w1': b.w1"
    mean = lambda m: f"(b.n * b.{m} + boxes[i + 1].n * boxes[i + 1].{m}) / (b.n + boxes[i + 1].n)"
    given = f"list_transform(boxes, lambda b, k: CASE WHEN k = p THEN {{{same}, 'n': b.n + boxes[i + 1].n, 'm0': {mean('m0')}, 'm1': {mean('m1')}, 'kept': b.kept}} WHEN k = i + 1 THEN {{{same}, 'n': b.n, 'm0': b.m0, 'm1': b.m1, 'kept': false}} ELSE b END)"
    return f"""{name}_fold(c, i, boxes) USING KEY (c) AS (
  SELECT c, 0::BIGINT, list({{'id': id, 'v0': v0, 'v1': v1, 'w0': w0, 'w1': w1, 'n': n, 'm0': m0, 'm1': m1, 'kept': true}} ORDER BY id) FROM ({rows}) GROUP BY 1
  UNION ALL
  SELECT c, i + 1 AS i, CASE WHEN p IS NULL THEN boxes ELSE {given} END AS boxes FROM (SELECT *, {holder} AS p FROM {name}_fold WHERE i < len(boxes))),
{name} AS (SELECT c, b.id AS id, b.v0 AS v0, b.v1 AS v1, b.w0 AS w0, b.w1 AS w1, b.n AS n, b.m0 AS m0, b.m1 AS m1 FROM (SELECT c, unnest(boxes) AS b FROM {name}_fold) WHERE b.kept)"""


def remove_contained(spark: SparkSession, d: str) -> DataFrame:
    b = inputs.boxes(spark, d, "multi_gran").withColumn("centroid", F.coalesce("centroid", F.transform(F.arrays_zip("v", "w"), lambda z: (z["v"] + z["w"]) / 2))).withColumn("n_samples", F.coalesce("n_samples", F.lit(1.0)))
    left = granular.remove_contained(b.select("box_id", "v", "w", "c", "n_samples", "centroid"))
    return flat(left.withColumn("partition_id", F.lit(0))).drop("partition_id")


_FLAT = "round(v0, 9) AS v0, round(v1, 9) AS v1, round(w0, 9) AS w0, round(w1, 9) AS w1, n AS n_samples, round(m0, 9) AS m0, round(m1, 9) AS m1"
QUERIES["remove_contained"] = remove_contained
SQL["remove_contained"] = "WITH RECURSIVE " + contained_sql("r", "SELECT coalesce(c, -1) AS c, box_id AS id, v[1] AS v0, v[2] AS v1, w[1] AS w0, w[2] AS w1, coalesce(n_samples, 1) AS n, coalesce(centroid[1], (v[1] + w[1]) / 2) AS m0, coalesce(centroid[2], (v[2] + w[2]) / 2) AS m1 FROM hyperbox WHERE model_id = 'multi_gran'") + f" SELECT id AS box_id, c, {_FLAT} FROM r"


def coarsen_sql(name: str, source: str, theta: float, least: float = 0.5) -> str:
    """Common tables up to ``name``: boxes learnt from the boxes of ``source``, in order of id; a new box is parted from those of other classes it meets."""
    fits = f"r.m >= {max(least, 1 - theta)!r} AND {_GW[0]} - {_GV[0]} <= {theta} AND {_GW[1]} - {_GV[1]} <= {theta}"
    kind = "(CASE WHEN boxes[r.k].c = -1 THEN y ELSE boxes[r.k].c END)"
    free = f"list_filter(list_filter(ranked, lambda r: {fits}), lambda r: list_filter(range(1, len(boxes) + 1), lambda o: o <> r.k AND (boxes[o].c <> {kind} OR boxes[o].c = -1) AND {_meet(_GV, _GW, 'boxes[o]')}) = [])[1].k"
    decide = f"{{'j': {free}, 'grow': true, 'skip': coalesce(ranked[1].m = 1 AND (boxes[ranked[1].k].c = y OR y = -1), false)}}"
    sql = fold_sql("", 1, own=_OPEN, membership=inputs.gfmm(_L, _U, _LO, _HI), decide=decide, part=_gfmm_part(2.0), step=kernels.GFMM_STEP, rivals=_rivals(_meet(["g.v0", "g.v1"], ["g.w0", "g.w1"], "b")), source="s AS (0)", also=("sn", "sm0", "sm1"))
    # weights and centroids come from the boxes learnt, and it is the new box that is parted
    sql = sql.replace("'n': 1.0::DOUBLE, 'm0': (l0 + u0) / 2, 'm1': (l1 + u1) / 2", "'n': sn, 'm0': sm0, 'm1': sm1").replace("'n': b.n + 1.0", "'n': b.n + sn")
    for m in ("0", "1"):
        sql = sql.replace(f"(b.m{m} * b.n + (l{m} + u{m}) / 2) / (b.n + 1.0)", f"(b.m{m} * b.n + sm{m} * sn) / (b.n + sn)")
    sql = sql.replace("SELECT part, i, after AS boxes, j, list_filter(", "SELECT part, i, after AS boxes, new AS j, list_filter(").replace("CASE WHEN skip OR j IS NULL OR NOT grow OR k = j THEN false", "CASE WHEN new IS NULL OR k = new THEN false").replace("after[j].", "after[new].")
    sql = sql.replace("END AS after FROM (", "END AS after, CASE WHEN NOT skip AND j IS NULL AND len(boxes) > 0 THEN len(boxes) + 1 END AS new FROM (", 1)
    body = sql[sql.index("fold(part") : sql.rindex("SELECT part::INT")].rstrip()
    body = re.sub(r"\bfold\b", f"{name}_fold", re.sub(r"\bs\b", f"{name}_s", body))
    return f"""{name}_s AS (SELECT 0 AS part, row_number() OVER (ORDER BY id) AS i, v0 AS l0, v1 AS l1, w0 AS u0, w1 AS u1, c AS y, n AS sn, m0 AS sm0, m1 AS sm1 FROM {source}),
{body},
{name} AS (SELECT b.c AS c, k AS id, b.v0 AS v0, b.v1 AS v1, b.w0 AS w0, b.w1 AS w1, b.n AS n, b.m0 AS m0, b.m1 AS m1 FROM (SELECT unnest(boxes) AS b, unnest(range(1, len(boxes) + 1)) AS k FROM {name}_fold))"""


def fit_granular(spark: SparkSession, d: str) -> DataFrame:
    s = inputs.whole_samples(spark, d)
    boxes = granular.fit(s, (0.1, 0.2, 0.3), n_partitions=fitting.parts_for(s, PART_ROWS))
    return flat(boxes.withColumn("partition_id", F.col("level"))).withColumnRenamed("partition_id", "level")


def _granular_sql() -> str:
    first = _online(0.1)(WHOLE, PART_ROWS)
    free = first[: first.rindex("SELECT part::INT")].rstrip()
    free = re.sub(r"list_filter\(range\(1, len\(after\) \+ 1\), .* AS pend FROM", "[]::BIGINT[] AS pend FROM", free)  # nothing is parted at the first level
    rows = "SELECT b.c AS c, part * 4294967296 + k AS id, b.v0 AS v0, b.v1 AS v1, b.w0 AS w0, b.w1 AS w1, b.n AS n, b.m0 AS m0, b.m1 AS m1 FROM (SELECT part, unnest(boxes) AS b, unnest(range(1, len(boxes) + 1)) AS k FROM fold)"
    levels = " UNION ALL ".join(f"SELECT {k} AS level, id AS box_id, c, {_FLAT} FROM {name}" for k, name in enumerate(("r", "c1", "c2")))
    return f"{free},\n{contained_sql('r', rows)},\n{coarsen_sql('c1', 'r', 0.2)},\n{coarsen_sql('c2', 'c1', 0.3)}\n{levels}"


QUERIES["fit_granular"] = fit_granular
SQL["fit_granular"] = _granular_sql()
