"""Preparing samples: scaling, missing values, category distances, folds and samples of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxfold.functions.distance import FREE_HIGH, FREE_LOW, MISSING_HIGH, MISSING_LOW
from boxfold.lineage import cut
from boxfold.operators import dictionary

UNLABELLED = -1
#: Values of one feature at most of which all distances are worked out (the result has a row per pair).
MOST_VALUES = 10_000


def clean(c: str) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), F.col(c))


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each column, in one pass."""
    row = df.agg(*[f(clean(c)).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def scale_unit(df: DataFrame, columns: Sequence[str], known: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Each column scaled to [0, 1] by its range; a constant column becomes 0."""
    known = known or ranges(df, columns)

    def scaled(c: str) -> Column:
        lo, hi = known[c]
        if lo is None:
            return F.lit(None).cast("double")
        return (clean(c) - F.lit(float(lo))) / F.lit(float(hi - lo) if hi > lo else 1.0)

    return df.withColumns({c: scaled(c) for c in columns})


def mark_missing(low: Column, high: Column, free: bool = False) -> tuple[Column, Column]:
    """A missing bound becomes its mark; the marks are out of order, so the dimension shows as missing."""
    return F.coalesce(low, F.lit(FREE_LOW if free else MISSING_LOW)), F.coalesce(high, F.lit(FREE_HIGH if free else MISSING_HIGH))


def has_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: whether any value of the columns is missing."""
    missing = [F.col(c).isNull() | F.isnan(c) for c in columns]
    any_of = missing[0]
    for m in missing[1:]:
        any_of = any_of | m
    return df.agg(F.coalesce(F.bool_or(any_of), F.lit(False)).alias("has_missing"))


def label(y: Column) -> Column:
    return F.coalesce(y, F.lit(UNLABELLED))


def category_distances(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """(feature, a, b, dist), a <= b: how far two values' class shares are apart, in units of the farthest pair.

    Of a feature with two values they are at distance 1.  Values number few (they are codes), rows many: all rows
    collapse to counts by feature, value and class first."""
    sides = F.array(*[F.struct(F.lit(j).alias("feature"), F.col(f"`{c}`").alias("a")) for j, c in enumerate(columns)])
    counts = df.select(F.explode(sides).alias("s"), F.col(y).alias("c")).select("s.feature", "s.a", "c").filter("a IS NOT NULL").groupBy("feature", "a", "c").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("feature", "a"))).select("feature", "a", "c", "p")
    vectors = share.groupBy("feature", "a").agg(F.map_from_entries(F.collect_list(F.struct("c", "p"))).alias("p"))
    most = vectors.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    if most > MOST_VALUES:
        raise ValueError(f"{most} values of one feature, {MOST_VALUES} at most; give the rare ones one name first")
    pairs = vectors.join(vectors.select("feature", F.col("a").alias("b"), F.col("p").alias("q")), "feature").filter("a <= b")
    classes = F.array_sort(F.array_union(F.map_keys("p"), F.map_keys("q")))
    gap = lambda k: F.pow(F.coalesce(F.try_element_at("p", k), F.lit(0.0)) - F.coalesce(F.try_element_at("q", k), F.lit(0.0)), F.lit(2.0))
    raw = pairs.withColumn("d", F.sqrt(F.aggregate(F.transform(classes, gap), F.lit(0.0), lambda x, z: x + z)))
    top = Window.partitionBy("feature")
    values = F.size(F.collect_set("a").over(top))
    dist = F.when(values <= 2, F.when(F.col("a") == F.col("b"), 0.0).otherwise(1.0)).otherwise(F.coalesce(F.col("d") / F.nullif(F.max("d").over(top), F.lit(0.0)), F.lit(0.0)))
    return raw.select("feature", "a", "b", dist.alias("dist"))


def shuffle_key(record: Column, seed: int) -> Column:
    return F.xxhash64(record, F.lit(seed))


#: Rows of one bin of random keys, about; bin tables of no more rows are broadcast.
BIN_ROWS, BROADCAST_BINS = 4_096, 200_000


def stratified_folds(df: DataFrame, record: str, y: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Folds of even class shares: a record's rank in its class, by a random key, modulo k."""
    return _ranked(df, [y], record, seed, own_key=True).withColumn(name, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_size")


def dealt(df: DataFrame, y: str, k: int, order: Sequence[str] = ("seq", "sid"), name: str = "partition_id") -> DataFrame:
    """Rows dealt class by class, in their order, to k parts: every part has its share of every class and of all times.

    A row's place comes from a range partition by class and order, so no class is sorted in one task."""
    if k == 1:
        return df.withColumn(name, F.lit(0))
    placed = dictionary.dense_ids(df, [y, *order], "_place")
    first = placed.groupBy(y).agg(F.min("_place").alias("_first"))  # one row per class
    matched = placed.join(F.broadcast(first.withColumnRenamed(y, "_class")), F.col(y).eqNullSafe(F.col("_class")))
    return matched.withColumn(name, F.pmod(F.col("_place") - F.col("_first"), F.lit(k)).cast("int")).drop("_place", "_first", "_class")


def _ranked(df: DataFrame, by: Sequence[str], record: str, seed: int, own_key: bool = False, most: int | None = None) -> DataFrame:
    """``_rank`` from 1 by a random key inside each group, ``_size`` of the group.

    Ranks come from a histogram of the keys: a bin's offset plus the rank inside the bin, so no group is sorted whole.  Bins are as
    many as the rows need; their table goes to the rows, not the rows to it, as long as it is small.  ``own_key``: the record's key is the same in all groups."""
    keyed, bins = _binned(df, by, record, seed, own_key, most)
    few = bins.count() <= BROADCAST_BINS
    return _placed(keyed, F.broadcast(bins) if few else bins, by, record).drop(*[f"_g_{c}" for c in by], "_b", "_bin", "_key", "_n", "_before", "_inside")


def _binned(df: DataFrame, by: Sequence[str], record: str, seed: int, own_key: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their key and bin, and the bins with their rows ``_n``, those before them and those of their group: as many bins as the largest group (``most`` rows, if known) needs."""
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0 if most is None else most
    bits = max(0, min(40, (most // BIN_ROWS).bit_length()))
    keyed = df.withColumn("_key", shuffle_key(F.struct(*by, record) if by and not own_key else F.col(record), seed)).withColumn("_bin", F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("bigint"))
    bins = cut(keyed.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n")))
    group = Window.partitionBy(*by)
    return keyed, bins.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_bin").alias("_b"), "_n", (F.sum("_n").over(group.orderBy("_bin")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("_size"))


def _of_bins(keyed: DataFrame, bins: DataFrame, by: Sequence[str]) -> DataFrame:
    match = F.col("_bin") == F.col("_b")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return keyed.join(bins, match)


def _placed(keyed: DataFrame, bins: DataFrame, by: Sequence[str], record: str) -> DataFrame:
    """``_rank`` of the rows of whole bins."""
    inside = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(F.expr("shiftrightunsigned(_key, 1)"), "_key", record))
    return _of_bins(keyed.withColumn("_inside", inside), bins, by).withColumn("_rank", F.col("_before") + F.col("_inside"))


def _first(df: DataFrame, by: Sequence[str], record: str, seed: int, most: Column) -> DataFrame:
    """The rows of ``_rank`` up to ``most``, a column of ``_size``: only the bin in which a group's last one lies is sorted, the bins before it are taken whole."""
    keyed, bins = _binned(df, by, record, seed)
    bins = cut(bins.withColumn("_most", most).filter("_before < _most"))
    whole, last = bins.filter("_before + _n <= _most"), bins.filter("_before + _n > _most")
    if bins.count() <= BROADCAST_BINS:
        whole, last = F.broadcast(whole), F.broadcast(last)
    ranked = _of_bins(keyed, last, by)
    inside = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(F.expr("shiftrightunsigned(_key, 1)"), "_key", record))
    cut_off = ranked.withColumn("_inside", inside).filter("_before + _inside <= _most")
    return _of_bins(keyed, whole, by).select(*df.columns).unionByName(cut_off.select(*df.columns))


def stated(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The distinct values of a column that holds a stated set; more than ``most`` are refused."""
    values = [r[0] for r in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"more than {most} values of {column}")
    return values


def per_member(df: DataFrame, members: DataFrame) -> DataFrame:
    """Every row once per member."""
    ids = stated(members, "member_id")
    return df.withColumn("member_id", F.explode(F.array(*[F.lit(i) for i in ids])))


def draw_rate(df: DataFrame, record: str, rate: float, bootstrap: bool = False, by: Sequence[str] = ("member_id",), seed: int = 0) -> DataFrame:
    """Per group a share of its rows: without replacement exactly, with replacement as Poisson weights ``n_samples``."""
    if bootstrap:
        unit = (F.shiftrightunsigned(shuffle_key(F.struct(*by, record), seed), 11)) / F.lit(float(1 << 53))
        n, term, cumulative, weight = 0, 2.718281828459045**-rate, 0.0, F.lit(0)
        for n in range(12):  # inverse of the Poisson distribution
            cumulative += term
            weight = weight + F.when(unit >= cumulative, 1).otherwise(0)
            term *= rate / (n + 1)
        return df.withColumn("n_samples", weight.cast("double")).filter("n_samples > 0")
    return _first(df, by, record, seed, F.floor(F.col("_size") * rate))


def draw_balanced(df: DataFrame, record: str, y: str, rate: float, by: Sequence[str] = ("member_id",), seed: int = 0) -> DataFrame:
    """Per group the same number of every class, no more than the rarest class has."""
    ranked = _ranked(df, [*by, y], record, seed)
    sizes = df.groupBy(*by, y).agg(F.count(F.lit(1)).alias("_c")).groupBy(*by).agg(F.min("_c").alias("_least"), F.count(F.lit(1)).alias("_k"), F.sum("_c").alias("_all"))
    joined = ranked.join(sizes, list(by)) if by else ranked.join(F.broadcast(sizes))
    return joined.filter(F.col("_rank") <= F.least("_least", F.floor(F.col("_all") * rate / F.col("_k")))).drop("_rank", "_size", "_least", "_k", "_all")


def draw_stratified(df: DataFrame, record: str, y: str, rate: float, by: Sequence[str] = ("member_id",), seed: int = 0) -> DataFrame:
    """Per group and class the share of its rows, rounded half up."""
    return _first(df, [*by, y], record, seed, F.floor(F.col("_size") * rate + 0.5))
