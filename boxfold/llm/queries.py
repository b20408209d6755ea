"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfold.llm import cluster, leak, pack, sample, terms, unify


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(_table(spark, d, "japanese_credit"), ["c0", "c3", "c15"], "sid")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_frequencies(spark, d).filter("mark IS NOT NULL").select("field", "code", "mark")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    points = cluster.labelled_points(_table(spark, d, "syn_num_test"))
    return cluster.describe(cluster.cluster_records(points))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    points = cluster.labelled_points(_table(spark, d, "syn_num_test"))
    return cluster.members(cluster.cluster_records(points)).select(F.col("first").alias("sid_a"), F.col("record").alias("sid_b"))


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the clusters are what the reach asks for."""
    return cluster.audit(cluster.cluster_cells(cluster.labelled_points(_table(spark, d, "syn_num_test"))))


TABLES = {"japanese_credit": ["c15"], "syn_num_test": ["c2"]}


def _samples(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    """Plan and drawn sample of the targets of each table."""
    targets, out = _table(spark, d, "sample_targets"), []
    for t, fields in TABLES.items():
        found = sample.candidates(_table(spark, d, t), "sid", fields)
        plan = sample.plan_quotas(sample.category_counts(found), targets.filter(F.col("target_table") == t))
        out.append((plan, sample.draw(found, plan)))
    return out


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """What every category of every target wanted, had and got."""
    a, b = (sample.report(plan, drawn) for plan, drawn in _samples(spark, d))
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sample.shortfalls(p4_report(spark, d)).select("target_id", "category")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    (_, a), (_, b) = _samples(spark, d)
    return a.unionByName(b).withColumnRenamed("record", "sid")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    sizes = _table(spark, d, "documents").select("doc_id", pack.byt5_size(F.col("text")).alias("size")).filter("size IS NOT NULL")
    return pack.pack_documents(sizes, pack.stated_specs(_table(spark, d, "pack_specs")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("piece = 0 AND n_pieces > 1").select("spec_id", "doc_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return pack.packing_report(_pieces(spark, d))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its class is the smallest document that looks the same, its links are those whose text is stored differently."""
    return unify.class_members(_table(spark, d, "documents")).select(F.col("record").alias("doc_id"), F.col("class").alias("class_id"), "n_links")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.same_looking_pairs(_table(spark, d, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


QUERIES = {f.__name__: f for f in (p1_found, p1_frequencies, p3_found, p3_clusters, p3_audit, p4_found, p4_report, p4_sample, p6_found, p6_report, p7_found, p7_leaks, p8_found, p8_classes)}

_P1 = """
WITH t AS (
  SELECT sid, 'c0' AS field, c0 AS code FROM japanese_credit UNION ALL SELECT sid, 'c3', c3 FROM japanese_credit
  UNION ALL SELECT sid, 'c15', CAST(c15 AS VARCHAR) FROM japanese_credit),
f AS (SELECT field, code, count(*) AS occurrences, count(DISTINCT sid) AS records FROM t WHERE code IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN records <= 5 THEN 'rare' WHEN records > 0.6 * (SELECT count(DISTINCT sid) FROM japanese_credit) THEN 'common' END AS mark FROM f)
"""

_P4 = """
WITH a AS (
  SELECT 'japanese_credit' AS target_table, 'c15' AS field, CAST(c15 AS VARCHAR) AS category, count(DISTINCT sid) AS n FROM japanese_credit GROUP BY 3
  UNION ALL SELECT 'syn_num_test', 'c2', CAST(c2 AS VARCHAR), count(DISTINCT sid) FROM syn_num_test GROUP BY 3)
SELECT target_id, category FROM sample_targets LEFT JOIN a USING (target_table, field, category)
WHERE coalesce(n, 0) < greatest(min_rows, round(sample_size * CAST(target_share AS DECIMAL(20, 10))))
"""

_P3 = """
WITH p AS (SELECT DISTINCT sid, c0, c1, c2 FROM syn_num_test WHERE c2 > 0 AND NOT isnan(c0) AND NOT isnan(c1)),
l AS (SELECT b.sid AS sid_b, min(a.sid) AS sid_a FROM p a JOIN p b ON a.c2 = b.c2 AND abs(a.c0 - b.c0) <= 0.0045 AND abs(a.c1 - b.c1) <= 0.0045 GROUP BY 1)
SELECT sid_a, sid_b FROM l WHERE sid_a <> sid_b
"""

_P3_AUDIT = """
WITH p AS (SELECT DISTINCT sid, c0, c1, c2 FROM syn_num_test WHERE c2 > 0 AND NOT isnan(c0) AND NOT isnan(c1)),
l AS (SELECT b.sid, b.c2, b.c0, b.c1, min(a.sid) AS least FROM p a JOIN p b ON a.c2 = b.c2 AND abs(a.c0 - b.c0) <= 0.0045 AND abs(a.c1 - b.c1) <= 0.0045 GROUP BY 1, 2, 3, 4),
e AS (SELECT c2, least, min(c0) AS lo0, max(c0) AS hi0, min(c1) AS lo1, max(c1) AS hi1 FROM l GROUP BY 1, 2)
SELECT count(*) AS clusters, count(*) FILTER (hi0 - lo0 > 0.0045 OR hi1 - lo1 > 0.0045) AS wide,
       (SELECT count(*) FROM e a JOIN e b ON a.c2 = b.c2 AND a.least < b.least AND greatest(a.lo0 - b.hi0, b.lo0 - a.hi0) <= 0.0045 AND greatest(a.lo1 - b.hi1, b.lo1 - a.hi1) <= 0.0045) AS near FROM e
"""

_P6 = "SELECT spec_id, doc_id FROM documents, pack_specs WHERE strlen(text) + 1 > capacity"



def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _forms(name: str, source: str, key: str, text: str, fold_case: bool) -> str:
    """Common table ``name``(key, stored, form): the one form of every text, from a table of single characters and the normal form of what it gives."""
    table = unify.expansions(fold_case)
    sides = ", ".join(f"unnest([{', '.join(_literal(x) for x in side)}])" for side in (table.keys(), table.values()))
    return f"""{name}_map AS (SELECT * FROM (SELECT {sides}) AS t(c, r)),
{name}_chars AS (SELECT {key}, unnest(string_split({text}, '')) AS c, generate_subscripts(string_split({text}, ''), 1) AS k FROM {source} WHERE length({text}) > 0),
{name}_made AS (SELECT {key}, nfc_normalize(string_agg(coalesce(r, c), '' ORDER BY k)) AS form FROM {name}_chars LEFT JOIN {name}_map USING (c) GROUP BY {key}),
{name} AS (SELECT {key}, {text} AS stored, form FROM {name}_made JOIN {source} USING ({key}))"""


_WORD = r"[\p{L}\p{N}\x{300}-\x{36F}]+"

_P7 = f"""
WITH {_forms("d", "documents", "doc_id", "text", True)}, {_forms("e", "eval_items", "item_id", "passage", True)},
dw AS (SELECT doc_id, regexp_extract_all(form, '{_WORD}') AS w FROM d),
ew AS (SELECT item_id, regexp_extract_all(form, '{_WORD}') AS w FROM e),
ep AS (SELECT item_id, least(12, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 11) + 1)) AS k, w FROM ew WHERE len(w) > 0),
eg AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM ep),
dp AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM dw, (SELECT DISTINCT n FROM eg) WHERE len(w) >= n),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM dp)
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (n, phrase)
"""

_P8 = f"WITH {_forms('d', 'documents', 'doc_id', 'text', False)}"

SQL = {
    "p1_found": _P1 + "SELECT field, code, mark FROM m WHERE mark IS NOT NULL",
    "p1_frequencies": _P1 + "SELECT field, code, occurrences, records, mark FROM m",
    "p3_found": _P3,
    "p3_audit": _P3_AUDIT,
    "p4_found": _P4,
    "p6_found": _P6,
    "p7_found": _P7,
    "p8_found": _P8 + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.form = b.form AND a.stored <> b.stored AND a.doc_id < b.doc_id",
    "p8_classes": _P8 + ", n AS (SELECT form, stored, count(*) AS n FROM d GROUP BY 1, 2), a AS (SELECT form, count(*) AS n, min(doc_id) AS class_id FROM d GROUP BY 1) SELECT doc_id, class_id, a.n - n.n AS n_links FROM d JOIN n USING (form, stored) JOIN a USING (form)",
}
