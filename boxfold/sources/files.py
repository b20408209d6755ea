"""Reading samples from files, storing and loading models, and a page of parallel coordinates."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxfold.lineage import cut
from boxfold.operators import dictionary

#: The credit file's columns, none named in the file.
CREDIT_SCHEMA = "c0 string, c1 double, c2 double, c3 string, c4 string, c5 string, c6 string, c7 double, c8 string, c9 string, c10 double, c11 string, c12 string, c13 double, c14 double, c15 int"
CREDIT_CATEGORICAL = (0, 3, 4, 5, 6, 8, 9, 11, 12)


def read_numeric(spark: SparkSession, path: str, d: int) -> DataFrame:
    """Files without header of d features and a label in the last column, as samples in file order."""
    schema = ", ".join(f"x{j} double" for j in range(d)) + ", y int"
    rows = spark.read.schema(schema).csv(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"))
    placed = dictionary.dense_ids(rows, ["_file", "_split", "_row"], "_place")  # splits may be read in any order
    x = F.array(*[f"x{j}" for j in range(d)])
    return placed.select(F.col("_place").alias("sid"), F.col("_place").alias("seq"), x.alias("xl"), x.alias("xu"), F.coalesce("y", F.lit(-1)).alias("y"))


def read_credit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CREDIT_SCHEMA).option("nullValue", "?").csv(path)


#: Splits of files whose quote parity is broadcast at most; more are refused.
BROADCAST_SPLITS = 1_000_000

_FRAGMENTS = "source string, split bigint, place bigint, begins boolean, ends boolean, raw_line string"


def _odd(values: pa.Array) -> np.ndarray:
    return (np.asarray(pc.fill_null(pc.count_substring(values, '"'), 0)) & 1).astype(np.int64)


def _split_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each split of a file holds an odd number of quotes."""
    odd: dict[tuple[str, int], int] = {}
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for key, o in zip(keys, _odd(batch.column(2)).tolist()):
            odd[key] = odd.get(key, 0) ^ o
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in odd], pa.string()), pa.array([k[1] for k in odd], pa.int64()), pa.array(list(odd.values()), pa.int64())], names=["source", "split", "odd"])


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Physical lines of splits, in order, to whole records and the fragments at the ends of splits; ``odd``: the parity before the split.

    The prefix parity of a batch's lines tells where records end; lines between are joined all at once."""
    held = None  # what a batch leaves open: source, split, place, whether it begins a record, its text
    now, place = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        source, split, value, before = (batch.column(k) for k in range(4))
        value = pc.fill_null(value, "")
        odd, base = _odd(value), before.to_numpy(zero_copy_only=False).astype(np.int64).copy()
        names, split_no = source.dictionary_encode(), split.to_numpy(zero_copy_only=False)
        new = np.ones(len(odd), bool)
        code = names.indices.to_numpy(zero_copy_only=False)
        new[1:] = (code[1:] != code[:-1]) | (split_no[1:] != split_no[:-1])
        first = (source[0].as_py(), int(split_no[0]))
        if held is not None and held[:2] != first:
            yield _fragments(*([x] for x in (held[0], held[1], held[2], held[3], False, held[4])))
            held = None
        if held is not None:  # goes before the lines, as one line that leaves the quotes open
            source, value = pa.concat_arrays([pa.array([held[0]], source.type), source]), pa.concat_arrays([pa.array([held[4]], value.type), value])
            split_no, odd, base = np.append(held[1], split_no), np.append(int(held[3]), odd), np.append(int(not held[3]), base)
            new = np.append(True, new)
            new[1] = False
        elif now == first:  # goes on where the last record ended
            base[0] = 0
        total = np.cumsum(odd)
        head = np.flatnonzero(new)
        segment = np.cumsum(new) - 1
        earlier = (total - odd - (total - odd)[head][segment] + base[head][segment]) & 1
        ends = (earlier + odd) & 1 == 0
        if now == first and held is None:
            offset = place
        else:
            offset = held[2] if held is not None else 0
        starts = new.copy()
        starts[1:] |= ends[:-1]
        at = np.flatnonzero(starts)
        stop = np.append(at[1:], len(odd)) - 1
        rank = np.arange(len(at)) - np.searchsorted(at, head, "left")[segment[at]] + np.where(segment[at] == 0, offset, 0)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(odd)).astype(np.int32)), value), "\n")
        begins, done = earlier[at] == 0, ends[stop]
        now = (source[-1].as_py(), int(split_no[-1]))
        place = int(rank[-1]) + 1
        keep = len(at)
        held = None
        if not done[-1]:
            keep -= 1
            held = (*now, int(rank[-1]), bool(begins[-1]), text[-1].as_py())
        if keep:
            yield _fragments(source.take(pa.array(at[:keep])), split_no[at[:keep]], rank[:keep], begins[:keep], done[:keep], text.slice(0, keep))
    if held is not None:
        yield _fragments(*([x] for x in (held[0], held[1], held[2], held[3], False, held[4])))


def _fragments(*columns) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([(c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t)) for c, t in zip(columns, kinds)], names=["source", "split", "place", "begins", "ends", "raw_line"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(source, split, place, raw_line): the records of delimited files, where quoted fields may hold line breaks, ready for ``load_lines``.

    A record ends at a line feed with an even number of quotes before it in the file.  Splits are read side by side: first the
    parity of each, added up along its file; then its lines are joined to records.  What runs over the end of a split - at most
    two fragments each - is put together by a shuffle of just these.  A file that ends inside quotes gives its rest as one record,
    and a lone quote shifts the ends up to the next one; such records come out as unsound."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), "value")
    splits = lines.mapInArrow(_split_parity, "source string, split bigint, odd bigint").groupBy("source", "split").agg(F.sum("odd").alias("odd"))
    earlier = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    before = cut(splits.select("source", "split", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("odd")))
    if before.limit(BROADCAST_SPLITS + 1).count() > BROADCAST_SPLITS:
        raise ValueError(f"more than {BROADCAST_SPLITS} splits; read the files in several calls")
    made = lines.join(F.broadcast(before), ["source", "split"]).select("source", "split", "value", "odd").mapInArrow(_join_lines, _FRAGMENTS)
    whole = made.filter("begins AND ends")
    loose = made.filter("NOT (begins AND ends)")
    order = Window.partitionBy("source").orderBy("split", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most two rows per split
    chains = loose.withColumn("chain", F.sum(F.col("begins").cast("int")).over(order)).groupBy("source", "chain").agg(F.sort_array(F.collect_list(F.struct("split", "place", "raw_line"))).alias("parts"))
    joined = chains.select("source", F.col("parts")[0]["split"].alias("split"), F.col("parts")[0]["place"].alias("place"), F.array_join(F.transform("parts", lambda p: p["raw_line"]), "\n").alias("raw_line"))
    return whole.select("source", "split", "place", "raw_line").unionByName(joined)


def store_model(boxes: DataFrame, path: str, model_id: str, params: dict) -> None:
    """Boxes as Parquet, one folder per model under ``path``; parameters as JSON text beside them. Overwrites the model."""
    boxes.withColumn("params", F.lit(json.dumps(params, sort_keys=True))).write.mode("overwrite").parquet(f"{path}/model_id={model_id}")


def load_model(spark: SparkSession, path: str, model_id: str) -> tuple[DataFrame, dict]:
    boxes = spark.read.parquet(f"{path}/model_id={model_id}")
    first = boxes.select("params").first()
    return boxes.drop("params"), json.loads(first["params"]) if first else {}


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of all models under ``path``, with ``model_id``."""
    return spark.read.parquet(path).drop("params")


def parallel_coordinates(explanation: DataFrame, path: str, most: int = 200) -> None:
    """A page with the corners of the boxes in an explanation, one polyline per corner; ``most`` rows at most, it is a picture."""
    rows = explanation.orderBy(F.desc("membership")).limit(most).collect()
    lines = []
    for r in rows:
        for corner, dash in (("v", ""), ("w", ' stroke-dasharray="4"')):
            d = max(1, len(r[corner]) - 1)
            points = " ".join(f"{20 + 560 * j / d:.1f},{280 - 260 * min(1, max(0, x)):.1f}" for j, x in enumerate(r[corner]))
            lines.append(f'<polyline fill="none" stroke="hsl({r["c"] * 67 % 360},70%,45%)"{dash} points="{points}"><title>{html.escape(str(r["c"]))}: {r["membership"]:.4f}</title></polyline>')
    with open(path, "w") as f:
        f.write('<!doctype html><meta charset="utf-8"><title>Boxes</title><svg viewBox="0 0 600 300" width="900">' + "".join(lines) + "</svg>")
