"""Queries for loading and filling credit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfold.operators.csvload import CREDIT_DOUBLES, CREDIT_INTS, load_lines
from boxfold.operators.fill import apply_fills, credit_rules, fill_cells, find_donors

CREDIT_DETERMINANTS = ("acct_no", "c3", "c4", "c5", "c6", "c8", "c9", "c11", "c12")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/japanese_credit_raw.parquet").select("raw_id", "raw_line")
    return load_lines(lines)[1].select("raw_id", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_lines(spark.read.parquet(f"{d}/japanese_credit_raw.parquet").select("raw_id", "raw_line"))[0]


_CREDIT = dict(record="sid", group="acct_no", time="opened_at", present=credit_rules, determinants=CREDIT_DETERMINANTS)


def _how() -> dict:
    return _CREDIT | {"present": credit_rules()}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cells = find_donors(spark.read.parquet(f"{d}/japanese_credit.parquet"), **_how())
    return cells.filter(F.col("donor").isNotNull()).select("sid", "field", F.col("donor").alias("donor_sid"))


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    credit = spark.read.parquet(f"{d}/japanese_credit.parquet")
    filled = apply_fills(credit, fill_cells(credit, **_how()), record="sid", present=credit_rules())
    return filled.select("sid", "seq", "c0", "c1", "c15", "c0_filled", "c1_filled", "c15_filled")


FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
NUM = r"\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

SIGNED = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _field(j: int) -> str:
    """The text of field j of a sound line, unquoted."""
    raw = f"regexp_extract(s, '^(?:{FIELD},){{{j}}}({FIELD})', 1, 's')"
    return f"CASE WHEN {raw} LIKE '\"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"


def _loaded(j: int) -> str:
    number = f"CASE WHEN regexp_full_match(trim(v{j}, ' '), '{SIGNED}') THEN trim(v{j}, ' ')::DOUBLE END"
    return f"TRY_CAST(trunc({number}) AS INT) AS c{j}" if f"c{j}" in CREDIT_INTS else f"{number} AS c{j}" if f"c{j}" in CREDIT_DOUBLES else f"v{j} AS c{j}"


_P2 = f"""
WITH l AS (SELECT raw_id, regexp_replace(coalesce(raw_line, ''), '\\r\\z', '') AS s FROM japanese_credit_raw),
q AS (SELECT *, regexp_full_match(s, '{FIELD}(?:,{FIELD})*', 's') AS sound FROM l),
n AS (SELECT *, regexp_replace(s, '"(?:[^"]|"")*"', 'q', 'gs') AS bare FROM q),
m AS (SELECT *, length(bare) - length(replace(bare, ',', '')) + 1 AS k FROM n),
v AS (SELECT *, {", ".join(f"{_field(j)} AS v{j}" for j in range(16))} FROM m),
u AS (SELECT *, NOT (trim(v1, ' ') IN ('', '?') OR regexp_full_match(trim(v1, ' '), '{NUM}')) AS bad1, NOT (trim(v13, ' ') IN ('', '?') OR regexp_full_match(trim(v13, ' '), '{NUM}')) AS bad13 FROM v)
"""

P2_SQL = _P2 + """
SELECT raw_id, 'quoting' AS reason FROM u WHERE NOT sound
UNION ALL SELECT raw_id, 'columns' FROM u WHERE sound AND k <> 16
UNION ALL SELECT raw_id, 'c1' FROM u WHERE sound AND k = 16 AND bad1
UNION ALL SELECT raw_id, 'c13' FROM u WHERE sound AND k = 16 AND bad13
"""

P2_LOADED_SQL = _P2 + f"SELECT raw_id, {', '.join(_loaded(j) for j in range(16))} FROM u WHERE sound AND k = 16 AND NOT bad1 AND NOT bad13"

_P5 = """
WITH r AS (SELECT DISTINCT sid, acct_no, opened_at, c0, c1, c15 FROM japanese_credit),
cell AS (
  SELECT sid, acct_no, opened_at, 'c0' AS field, coalesce(regexp_full_match(c0, '[a-z][a-z0-9]{0,3}'), false) AS has FROM r
  UNION ALL SELECT sid, acct_no, opened_at, 'c1', coalesce(NOT isnan(c1) AND c1 BETWEEN 10 AND 100, false) FROM r
  UNION ALL SELECT sid, acct_no, opened_at, 'c15', coalesce(c15 >= 0, false) FROM r),
pair AS (
  SELECT m.sid, m.field, d.sid AS donor_sid,
         row_number() OVER (PARTITION BY m.sid, m.field ORDER BY abs(epoch_us(d.opened_at) - epoch_us(m.opened_at)), d.opened_at, d.sid) AS k
  FROM cell m JOIN cell d ON m.acct_no = d.acct_no AND m.field = d.field AND NOT m.has AND d.has)
SELECT sid, field, donor_sid FROM pair WHERE k = 1
"""

P5_SQL = _P5
_HAS = {"c0": "coalesce(regexp_full_match(c0, '[a-z][a-z0-9]{0,3}'), false)", "c1": "coalesce(NOT isnan(c1) AND c1 BETWEEN 10 AND 100, false)", "c15": "coalesce(c15 >= 0, false)"}
_cells = " UNION ALL ".join(f"SELECT *, '{f}' AS field, {has} AS has, CAST({f} AS VARCHAR) AS val FROM japanese_credit" for f, has in _HAS.items())
_dets = " UNION ALL ".join(f"SELECT {j} AS det, {d} AS key, field, val, sid FROM t WHERE has AND {d} IS NOT NULL" for j, d in enumerate(CREDIT_DETERMINANTS))
_wants = " UNION ALL ".join(f"SELECT {j} AS det, {d} AS key, field, sid FROM t WHERE NOT has AND {d} IS NOT NULL" for j, d in enumerate(CREDIT_DETERMINANTS))
_names = "[" + ", ".join(f"'{d}'" for d in CREDIT_DETERMINANTS) + "]"

# values by verified dependencies (the account's own entries first, where it has a donor), then by the nearest record of the account
P5_FILLED_SQL = f"""
WITH t AS ({_cells}), donors AS ({_P5}),
entry AS (SELECT det, key, field, count(*) AS n, count(DISTINCT val) AS k, arg_min(val, sid) AS val FROM ({_dets}) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
ok AS (SELECT det, field FROM entry GROUP BY 1, 2 HAVING count(*) FILTER (k = 1) >= 0.9 * count(*)),
way AS (SELECT w.sid, w.field, arg_min(e.val, e.det) AS val, min(e.det) AS det FROM ({_wants}) w JOIN entry e USING (det, key, field) JOIN ok USING (det, field) WHERE e.k = 1 AND e.det > 0 GROUP BY 1, 2),
own AS (SELECT DISTINCT w.sid, w.field FROM ({_wants}) w JOIN entry e USING (det, key, field) JOIN ok USING (det, field) WHERE e.k = 1 AND e.det = 0),
near AS (SELECT d.sid, d.field, min(t.val) AS val FROM donors d JOIN t ON t.sid = d.donor_sid AND t.field = d.field AND t.has GROUP BY 1, 2),
fill AS (SELECT coalesce(near.sid, way.sid) AS sid, coalesce(near.field, way.field) AS field,
                CASE WHEN own.sid IS NOT NULL OR way.sid IS NULL THEN near.val ELSE way.val END AS val,
                CASE WHEN own.sid IS NOT NULL THEN 'dependency:acct_no' WHEN way.sid IS NOT NULL THEN 'dependency:' || ({_names})[way.det + 1] ELSE 'group' END AS how
         FROM near FULL JOIN way ON near.sid = way.sid AND near.field = way.field LEFT JOIN own ON own.sid = near.sid AND own.field = near.field),
wide AS (SELECT sid, {", ".join(f"max(val) FILTER (field = '{f}') AS v_{f}, max(how) FILTER (field = '{f}') AS h_{f}" for f in _HAS)} FROM fill GROUP BY 1)
SELECT sid, seq, CASE WHEN {_HAS["c0"]} OR v_c0 IS NULL THEN c0 ELSE v_c0 END AS c0, CASE WHEN {_HAS["c1"]} OR v_c1 IS NULL THEN c1 ELSE v_c1::DOUBLE END AS c1, CASE WHEN {_HAS["c15"]} OR v_c15 IS NULL THEN c15 ELSE v_c15::INT END AS c15,
       {", ".join(f"CASE WHEN NOT {has} THEN h_{f} END AS {f}_filled" for f, has in _HAS.items())}
FROM japanese_credit LEFT JOIN wide USING (sid)
"""

QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p5_found": p5_found, "p5_filled": p5_filled}
SQL = {"p2_found": P2_SQL, "p2_loaded": P2_LOADED_SQL, "p5_found": P5_SQL, "p5_filled": P5_FILLED_SQL}
