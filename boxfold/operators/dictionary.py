"""Global dictionaries: dense integers for values, and encoding by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfold.lineage import cut

#: Dictionaries up to this many entries are broadcast, larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def dense_ids(values: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """``values`` with dense integers in the given order, without gathering them in one task.

    Rows are range-partitioned and sorted; an integer is its partition's offset plus its place there."""
    placed = cut(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    total, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = F.broadcast(values.sparkSession.createDataFrame(offsets, "_p bigint, _o bigint"))
    return placed.join(table, part == F.col("_p")).withColumn(name, F.col("_o") + place).drop("_m", "_p", "_o")


def build(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code): the sorted distinct non-null values of each column, numbered from 0 within it."""
    sides = F.array(*[F.struct(F.lit(j).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for j, c in enumerate(columns)])
    values = df.select(F.explode(sides).alias("s")).select("s.*").filter("value IS NOT NULL").distinct()
    ids = cut(dense_ids(values, ["feature", "value"]))
    first = ids.groupBy("feature").agg(F.min("id").alias("first"))
    return ids.join(F.broadcast(first), "feature").select("feature", "value", (F.col("id") - F.col("first")).cast("int").alias("code"))


def encode(df: DataFrame, columns: Sequence[str], dictionary: DataFrame, missing: int | None = None, unseen: str = "null") -> DataFrame:
    """``df`` with each column replaced by its code; ``missing`` stands for nulls; an unseen value gives NULL or an error."""
    small = dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = df
    for j, c in enumerate(columns):
        side = dictionary.filter(F.col("feature") == j).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        out = out.join(F.broadcast(side) if small else side, F.col(f"`{c}`").cast("string") == F.col("_value"), "left")
        code = F.when(F.col(f"`{c}`").isNull(), F.lit(missing).cast("int")).otherwise(F.col("_code"))
        if unseen == "error":
            code = F.when(F.col(f"`{c}`").isNotNull() & F.col("_code").isNull(), F.raise_error(F.concat(F.lit(f"unseen value of {c}: "), F.col(f"`{c}`").cast("string")))).otherwise(code)
        out = out.withColumn(c, code).drop("_value", "_code")
    return out


def one_hot(df: DataFrame, columns: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """``df`` with each column replaced by a bit set of its value; missing and unseen values give no bit.

    Codes from 63 on share the last bit set word's range and are refused."""
    if dictionary.filter("code > 62").limit(1).count():
        raise ValueError("a feature has more than 63 values; give the rare ones one name first")
    coded = encode(df, columns, dictionary)
    return coded.withColumns({c: F.coalesce(F.expr(f"shiftleft(1L, `{c}`)"), F.lit(0).cast("bigint")) for c in columns})
