"""Filling missing cells from similar records, with provenance.

Two sources, in this order: determinant dictionaries (columns that determine the field in the complete records,
verified before use), left-joined to the missing cells; then, for what is left, the record of the same group nearest
in time.  Every filled cell names the way it was filled, the record its value comes from (``source``), and the donor.
A dictionary over the group itself names its donor too: all records of the group that have the field support the
entry, and the donor is the nearest of them.  Entries of other determinants are supported by records of any group;
their source is the smallest of these, their donor is the nearest record of the cell's own group, if there is one.

All of it runs in the JVM.  The table is read once for the dictionaries and once for the timelines.  A group's timeline first
collapses to one donor per instant, which also absorbs repeated deliveries; the nearest earlier and later donors are
two running windows.  Groups above ``hot_rows`` are cut into chunks of time by range, as many as their rows need, and the last
donor before and the first after each chunk are carried over, so that no task holds a whole hot group.

Defined results: rows without group or time have no donor; rows without record id are neither filled nor donors;
of equally near donors the earlier, then the smaller id; repeated deliveries of a record give one row; of a record's
differing values the least counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxfold.lineage import cut


def credit_rules() -> dict[str, Column]:
    """Where a cell of the credit table counts as present."""
    present = lambda c: F.coalesce(c, F.lit(False))
    return {
        "c0": present(F.col("c0").rlike(r"\A[a-z][a-z0-9]{0,3}\z")),
        "c1": present(~F.isnan("c1") & F.col("c1").between(10, 100)),
        "c15": present(F.col("c15") >= 0),
    }


def mine_dependencies(df: DataFrame, record: str, present: Mapping[str, Column], determinants: Sequence[str], min_confidence: float, min_support: int) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Dictionary (det, key, and per field the smallest record that supports its only value) over complete records, and the verified (field, det) pairs.

    Values are compared by 64 bits of hash, so that one hash aggregation over all determinants does."""
    fields, m = list(present), len(determinants)
    n = range(len(fields))
    keys = [f"_key{j}" for j in range(m)]
    rows = df.select(F.col(f"`{record}`").alias("_rec"), *[F.col(f"`{d}`").cast("string").alias(k) for d, k in zip(determinants, keys)], *[F.when(present[f], F.xxhash64(F.col(f).cast("string"))).alias(f"_h{k}") for k, f in enumerate(fields)]).filter("_rec IS NOT NULL")
    aggregates = [a for k in n for a in (F.count(f"_h{k}").alias(f"n{k}"), F.min(f"_h{k}").alias(f"lo{k}"), F.max(f"_h{k}").alias(f"hi{k}"), F.min(F.when(F.col(f"_h{k}").isNotNull(), F.col("_rec"))).alias(f"r{k}"))]
    stats = rows.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_g"), *aggregates)
    which = F.array(*[F.lit((1 << m) - 1 - (1 << (m - 1 - j))) for j in range(m)])
    seen = [F.col(f"n{k}") >= min_support for k in n]
    stats = cut(stats.select((F.array_position(which, F.col("_g").cast("int")) - 1).cast("int").alias("det"), F.coalesce(*keys).alias("key"), *[x for k in n for x in (
        seen[k].alias(f"seen{k}"), F.when(seen[k] & (F.col(f"lo{k}") == F.col(f"hi{k}")), F.col(f"r{k}")).alias(f"r{k}"))]).filter("key IS NOT NULL"))
    found = stats.groupBy("det").agg(*[a for k in n for a in (F.count_if(f"seen{k}").alias(f"seen{k}"), F.count(f"r{k}").alias(f"n{k}"))]).collect()  # one row per determinant
    ok = [(k, r["det"]) for r in sorted(found) for k in n if r[f"seen{k}"] and r[f"n{k}"] >= min_confidence * r[f"seen{k}"]]
    return stats, [(fields[k], determinants[j]) for k, j in ok]


def _timeline(timed: DataFrame, n: range, spread: bool) -> DataFrame:
    """One row per instant of a group with the smallest donor of each field (kind 0), and one per record that lacks something (kind 1)."""
    some = reduce(lambda a, b: a | b, [F.col(f"_has{k}") for k in n])
    lacks = reduce(lambda a, b: a | b, [~F.col(f"_has{k}") for k in n])
    kinds = F.when(some & lacks, F.array(F.lit(0), F.lit(1))).when(some, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    donor = F.col("_kind") == 0
    rows = timed.withColumn("_kind", F.explode(kinds))
    rows = rows.select("_grp", "_at", "_kind", F.when(~donor, F.col("_rec")).alias("_want"), *[(donor | F.col(f"_has{k}")).alias(f"_has{k}") for k in n], *[F.when(donor & F.col(f"_has{k}"), F.col("_rec")).alias(f"_r{k}") for k in n])
    rows = rows if spread else rows.repartition("_grp")  # the one shuffle: both the instants and the windows are of a group
    return rows.groupBy("_grp", "_at", "_kind", "_want", *[f"_has{k}" for k in n]).agg(*[F.min(f"_r{k}").alias(f"_r{k}") for k in n])


def _neighbours(line: DataFrame, n: range, keys: Sequence[str]) -> DataFrame:
    """Rows of kind 1 with the nearest earlier (_p) and later (_q) donor of each field among the rows with the same keys."""
    line = line.select("*", *[F.when(F.col(f"_r{k}").isNotNull(), F.struct(F.col("_at").alias("at"), F.col(f"_r{k}").alias("rec"))).alias(f"_d{k}") for k in n])
    running = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead, back = running(F.col("_at").desc(), "_kind"), running("_at", "_kind")
    return line.select("*", *[F.last(f"_d{k}", True).over(back).alias(f"_p{k}") for k in n], *[F.last(f"_d{k}", True).over(ahead).alias(f"_q{k}") for k in n]).filter("_kind = 1")


def _hot_neighbours(timed: DataFrame, n: range, chunks: int) -> DataFrame:
    """The same for hot groups: their timelines are cut by range of (group, time, record), donors are carried over the cuts."""
    line = _timeline(timed, n, True).repartitionByRange(chunks, "_grp", "_at", "_kind", "_want").withColumn("_chunk", F.spark_partition_id())
    line = cut(line)
    near = _neighbours(line, n, ["_grp", "_chunk"])
    when = lambda k: F.when(F.col(f"_r{k}").isNotNull(), F.col("_at"))
    end = lambda k: F.struct(F.col("_at").alias("at"), F.col(f"_r{k}").alias("rec"))
    ends = line.groupBy("_grp", "_chunk").agg(*[F.max_by(end(k), when(k)).alias(f"_l{k}") for k in n], *[F.min_by(end(k), when(k)).alias(f"_f{k}") for k in n])  # one row per chunk
    past = Window.partitionBy("_grp").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy("_grp").orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_grp", "_chunk", *[F.last(f"_l{k}", True).over(past).alias(f"_cp{k}") for k in n], *[F.last(f"_f{k}", True).over(future).alias(f"_cq{k}") for k in n])
    near = near.join(carried, ["_grp", "_chunk"], "left")
    return near.withColumns({f"_p{k}": F.coalesce(f"_p{k}", f"_cp{k}") for k in n} | {f"_q{k}": F.coalesce(f"_q{k}", f"_cq{k}") for k in n})


def find_donors(df: DataFrame, *, record: str, group: str, time: str, present: Mapping[str, Column], determinants: Sequence[str] = (),
                min_confidence: float = 0.9, min_support: int = 2, hot_rows: int = 1_000_000) -> DataFrame:
    """One row per missing cell that can be filled: ``record``, ``field``, ``source``, ``donor``, ``donor_at``, ``method``."""
    fields = list(present)
    n = range(len(fields))
    base = df.select(F.col(f"`{record}`").alias("_rec"), F.col(f"`{group}`").alias("_grp"), F.col(f"`{time}`").alias("_at"), *[present[f].alias(f"_has{k}") for k, f in enumerate(fields)],
                     *[F.col(f"`{d}`").cast("string").alias(f"_det{j}") for j, d in enumerate(determinants)]).filter("_rec IS NOT NULL")
    stats, ok = mine_dependencies(df, record, present, determinants, min_confidence, min_support) if determinants else (None, [])
    entries = lambda f, d: stats.filter(F.col("det") == list(determinants).index(d)).select("key", F.col(f"r{fields.index(f)}").alias("source")).filter("source IS NOT NULL")

    timed = base.filter(F.col("_grp").isNotNull() & F.col("_at").isNotNull()).drop(*[c for c in base.columns if c.startswith("_det")])
    near = None
    if timed.count() > hot_rows:  # else no group can be hot
        hot = timed.groupBy("_grp").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
        hot = cut(hot)
        if not hot.isEmpty():
            chunks = 2 * hot.agg(F.sum("_n")).first()[0] // hot_rows + 1
            near = _hot_neighbours(timed.join(F.broadcast(hot.select("_grp")), "_grp", "left_semi"), n, chunks)  # hot groups number fewer than rows / hot_rows
            timed = timed.join(F.broadcast(hot.select("_grp")), "_grp", "left_anti")
    columns = ["_grp", "_at", "_want", *[f"{x}{k}" for x in ("_has", "_p", "_q") for k in n]]
    cold = _neighbours(_timeline(timed, n, False), n, ["_grp"]).select(*columns)
    near = cold if near is None else near.select(*columns).unionByName(cold)

    micros = lambda c: F.unix_micros(c) if dict(base.dtypes)["_at"] == "timestamp" else c

    def nearest(k: int) -> Column:
        p, q = F.col(f"_p{k}"), F.col(f"_q{k}")
        earlier = q.isNull() | (micros(F.col("_at")) - micros(p["at"]) <= micros(q["at"]) - micros(F.col("_at")))
        return F.when(p.isNotNull() & earlier, p).otherwise(q)

    # a dictionary over the group itself: an entry of the cell's group names the nearest record that supports it
    for f, d in ok:
        if d == group:
            k = fields.index(f)
            near = near.join(entries(f, d).select(F.col("key").alias(f"_e{k}"), F.lit(True).alias(f"_in{k}")), F.col("_grp").cast("string") == F.col(f"_e{k}"), "left").drop(f"_e{k}")
    by_group = [f for f, d in ok if d == group]
    cells = F.array(*[F.when(~F.col(f"_has{k}"), F.struct(F.lit(f).alias("field"), nearest(k).alias("donor"), (F.coalesce(F.col(f"_in{k}"), F.lit(False)) if f in by_group else F.lit(False)).alias("named"))) for k, f in enumerate(fields)])
    found = near.select(F.col("_want").alias("_rec"), F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).select("_rec", "c.field", F.col("c.donor.rec").alias("donor"), F.col("c.donor.at").alias("donor_at"), F.when(F.col("c.named"), f"dependency:{group}").alias("known")).filter("donor IS NOT NULL")

    others = [(f, d) for f, d in ok if d != group]
    if not others:
        return found.select(F.col("_rec").alias(record), "field", F.col("donor").alias("source"), "donor", "donor_at", F.coalesce("known", F.lit("group")).alias("method"))
    ways = []
    for order, (f, d) in enumerate(others):
        k, j = fields.index(f), list(determinants).index(d)
        missing = base.filter(~F.col(f"_has{k}") & F.col(f"_det{j}").isNotNull()).select("_rec", F.col(f"_det{j}").alias("key")).distinct()
        ways.append(missing.join(entries(f, d), "key").select("_rec", F.lit(f).alias("field"), F.struct(F.lit(order).alias("order"), "source", F.lit(f"dependency:{d}").alias("how")).alias("way")))
    told = reduce(DataFrame.unionByName, ways).groupBy("_rec", "field").agg(F.min("way").alias("way"))
    both = found.join(told, ["_rec", "field"], "full")
    return both.select(F.col("_rec").alias(record), "field", F.when(F.col("known").isNotNull() | F.col("way").isNull(), F.col("donor")).otherwise(F.col("way.source")).alias("source"), "donor", "donor_at", F.coalesce("known", "way.how", F.lit("group")).alias("method"))


def fill_cells(df: DataFrame, *, record: str, present: Mapping[str, Column], **how) -> DataFrame:
    """``find_donors`` with the ``value`` (as text) of the source."""
    fields = list(present)
    cells = cut(find_donors(df, record=record, present=present, **how))
    values = df.select(F.col(f"`{record}`").alias("_src"), *[F.when(present[f], F.col(f"`{f}`").cast("string")).alias(f"_v{k}") for k, f in enumerate(fields)])
    values = values.join(cells.select(F.col("source").alias("_src")).distinct(), "_src", "left_semi").groupBy("_src").agg(*[F.min(f"_v{k}").alias(f"_v{k}") for k in range(len(fields))])
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(f"_v{k}")) for k, f in enumerate(fields)])
    return cells.join(values, F.col("source") == F.col("_src")).select(record, "field", value.alias("value"), "source", "donor", "donor_at", "method")


def apply_fills(df: DataFrame, cells: DataFrame, *, record: str, present: Mapping[str, Column]) -> DataFrame:
    """The table with its missing cells filled, and ``<field>_filled`` telling how (NULL where nothing was filled)."""
    taken = {c.lower() for c in df.columns}
    side = "_fill"
    while any(c.startswith(side) for c in taken):
        side = "_" + side
    key, value, how = f"{side}_key", {f: f"{side}_value_{k}" for k, f in enumerate(present)}, {f: f"{side}_how_{k}" for k, f in enumerate(present)}
    wide = cells.groupBy(F.col(record).alias(key)).agg(*[a for f in present for a in (F.max(F.when(F.col("field") == f, F.col("value"))).alias(value[f]), F.max(F.when(F.col("field") == f, F.col("method"))).alias(how[f]))])
    types = dict(df.dtypes)
    joined = df.join(wide, F.col(record) == F.col(key), "left")
    out = {f: F.when(present[f] | F.col(value[f]).isNull(), F.col(f)).otherwise(F.col(value[f]).cast(types[f])) for f in present}
    marks = {f"{f}_filled": F.when(~present[f], F.col(how[f])) for f in present}
    kept = [out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns if c not in marks]
    return joined.select(*kept, *[m.alias(name) for name, m in marks.items()])
