"""Frequency of every distinct value, with marks for the too rare and the too common.

1. A dictionary of dense integers over all distinct values: values are counted field by field, added up before the
   shuffle, then range-partitioned and sorted; a value's identifier is its partition's offset plus its place.
   Identifier 0 stands for the record itself.
2. Terms are encoded.  A dictionary of checked size is broadcast whole; of a larger one only the values above the
   head bound - at most ``HEAD`` of them can exist - and the rest is joined by shuffle and has no hot key by construction.
3. Repeated deliveries are added up to (record, identifier) pairs (one shuffle of integers, both keys in it, so no
   value or record makes a hot partition).
4. Each block of sorted identifiers adds up count arrays, one identifier range at a time; only nonzero cells leave.
5. Arrays are added up by identifier range: first by range and part, then by range.  The cell of the record itself is the number of records.

Defined results: a null value is no term; a row without record id counts as an occurrence but no record; values
count exactly as stored; an empty table gives no rows; numbers count by their decimal text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfold.lineage import cut
from boxfold.operators.dictionary import dense_ids

#: Identifiers in one range, hence cells of a count array.
RANGE = 4096
#: A value is of the head if it has more than 1 / HEAD of all triples, so there are fewer than HEAD of them.
HEAD = 1024
#: A dictionary of no more values is broadcast whole.
BROADCAST_ROWS = 200_000
#: Parts in which the arrays of one range are added up first.
PARTS = 16

_SUMS = "range bigint, part int, cell array<int>, occurrences array<bigint>, records array<bigint>"


def _emit(ranges, parts, cells, occ, rec) -> pa.RecordBatch:
    n = np.cumsum([0, *map(len, cells)]).astype(np.int32)
    cat = lambda x, t: pa.ListArray.from_arrays(pa.array(n), pa.array(np.concatenate(x).astype(t)))
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(parts, pa.int32()), cat(cells, np.int32), cat(occ, np.int64), cat(rec, np.int64)], names=["range", "part", "cell", "occurrences", "records"])


def _count_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifiers arrive sorted, so one range's arrays are open at a time."""
    now, occ, rec, part = None, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64), 0

    def close():
        cell = np.flatnonzero(occ)
        return _emit([now], [part], [cell], [occ[cell]], [rec[cell]])

    for batch in batches:
        ids, n, held = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(3))
        if not len(ids):
            continue
        if now is None:
            part = int(batch.column(3)[0].as_py()) % PARTS
        ranges = ids // RANGE
        for lo, hi in zip(at := np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])), [*at[1:], len(ids)]):
            if ranges[lo] != now:
                if now is not None:
                    yield close()
                now, occ, rec = int(ranges[lo]), np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)
            cell = ids[lo:hi] % RANGE
            occ += np.bincount(cell, n[lo:hi], RANGE).astype(np.int64)
            rec += np.bincount(cell, held[lo:hi], RANGE).astype(np.int64)
    if now is not None:
        yield close()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occ, rec, key = np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = (batch.column("range")[0].as_py(), batch.column("part")[0].as_py())
        cell = batch.column("cell").flatten().to_numpy(zero_copy_only=False)
        np.add.at(occ, cell, batch.column("occurrences").flatten().to_numpy(zero_copy_only=False))
        np.add.at(rec, cell, batch.column("records").flatten().to_numpy(zero_copy_only=False))
    if key:
        cell = np.flatnonzero(occ)
        yield _emit([key[0]], [key[1]], [cell], [occ[cell]], [rec[cell]])


def build_dictionary(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(id, field, code, n): dense identifiers from 1 in order of (field, code), and how often each value occurs."""
    counts = [df.groupBy(F.col(f"`{f}`").cast("string").alias("code")).agg(F.count(F.lit(1)).alias("n")).filter("code IS NOT NULL").select(F.lit(f).alias("field"), "code", "n") for f in fields]
    return dense_ids(reduce(DataFrame.unionByName, counts), ["field", "code"]).withColumn("id", F.col("id") + 1)


def encode(df: DataFrame, fields: Sequence[str], record: str, words: DataFrame) -> DataFrame:
    """(record, id): every occurrence of every term, and identifier 0 once per row with a record."""
    size, bound = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    head = words if size <= BROADCAST_ROWS else words.filter(F.col("n") > bound / HEAD)
    parts = [df.select(F.col(f"`{record}`").alias("record"), F.lit(0).cast("bigint").alias("id")).filter("record IS NOT NULL")]
    for f in fields:
        own = lambda w, f=f: w.filter(F.col("field") == f).select("code", "id")
        rows = df.select(F.col(f"`{record}`").alias("record"), F.col(f"`{f}`").cast("string").alias("code")).filter("code IS NOT NULL")
        if size <= BROADCAST_ROWS:
            parts.append(rows.join(F.broadcast(own(head)), "code").select("record", "id"))
        else:
            hot = rows.join(F.broadcast(own(head)), "code", "left")
            parts += [hot.filter("id IS NOT NULL").select("record", "id"), hot.filter("id IS NULL").drop("id").join(own(words.filter(F.col("n") <= bound / HEAD)), "code").select("record", "id")]
    return reduce(DataFrame.unionByName, parts)


def term_frequencies(df: DataFrame, fields: Sequence[str], record: str, rare_records: int = 5, common_share: float = 0.6) -> DataFrame:
    """(field, code, occurrences, records, mark): every distinct value; ``mark`` is ``rare``, ``common`` or NULL."""
    words = build_dictionary(df, fields)
    pairs = encode(df, fields, record, words).groupBy("record", "id").agg(F.count(F.lit(1)).alias("n"))
    terms = pairs.select("id", "n", F.col("record").isNotNull().cast("int").alias("held"))
    blocks = terms.sortWithinPartitions("id").select("id", "n", "held", F.spark_partition_id().alias("block")).mapInArrow(_count_block, _SUMS)
    sums = blocks.groupBy("range", "part").applyInArrow(_add_up, _SUMS).withColumn("part", F.lit(0)).groupBy("range").applyInArrow(_add_up, _SUMS)
    cells = cut(sums.select("range", F.explode(F.arrays_zip("cell", "occurrences", "records")).alias("c")).select((F.col("range") * RANGE + F.col("c.cell")).alias("id"), "c.occurrences", "c.records"))
    n_records = cells.filter("id = 0").agg(F.coalesce(F.max("records"), F.lit(0))).first()[0]
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * n_records, "common")
    return words.join(cells, "id").select("field", "code", "occurrences", "records", mark.alias("mark"))
