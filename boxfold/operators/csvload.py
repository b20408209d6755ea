"""Loading undigested delimited lines, keeping unsound ones apart with the reason.

Each Arrow batch is scanned as one byte array: a quote mask and its prefix parity tell which commas delimit
fields, so records are split without touching them one by one.  The work is map-only: no shuffle, no state.

Defined results: an empty or null line is one empty field, hence ``columns``; a line may end in one carriage
return; columns of the input that clash with a field's name come out as ``<name>_in``; repeated lines come out
repeatedly; a null key is kept.  Numeric fields other than the checked ones load as NULL where they hold no number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, COMMA, CR = 34, 44, 13
NUMBER = r"^\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
SIGNED = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

#: The credit file: sixteen fields, of which fields 2 and 14 are checked.
CREDIT_FIELDS = tuple(f"c{i}" for i in range(16))
CREDIT_DOUBLES = ("c1", "c2", "c7", "c10", "c13", "c14")
CREDIT_INTS = ("c15",)
CREDIT_CHECKED = ("c1", "c13")


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in one array, and the offsets of the values; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def gather(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Strings of the byte spans [start, stop)."""
    lengths = stop - start
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    index = np.repeat(start - at[:-1], lengths) + np.arange(at[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.tobytes()), pa.py_buffer(data[index].tobytes())).cast(pa.string())


def split_lines(column: pa.Array, n_fields: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]:
    """Per line: quoting broken, wrong number of fields, sound; and of the sound lines, in order, each field's strings."""
    data, at = as_bytes(column)
    start, stop = at[:-1], at[1:].copy()
    if not len(start):
        none = np.zeros(0, bool)
        return none, none, none, [pa.array([], pa.string())] * n_fields
    last = data[np.maximum(stop - 1, 0)] if len(data) else np.zeros(len(stop), np.uint8)
    stop -= (stop > start) & (last == CR)
    quotes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == QUOTE, out=quotes[1:])

    def inside(places: np.ndarray, record: np.ndarray) -> np.ndarray:
        return ((quotes[places] - quotes[start[record]]) & 1).astype(bool)

    padded = np.concatenate([[0], data, [0]]).astype(np.uint8)  # padded[p + 1] is data[p]
    where = np.flatnonzero(data == QUOTE)
    record = np.searchsorted(at, where, "right") - 1
    closing = inside(where, record)
    before, after = padded[where], padded[where + 2]
    reopens = ~closing & (where > start[record]) & (before == QUOTE)
    opens = ~closing & ((where == start[record]) | (before == COMMA) | reopens)
    closes = closing & ((where + 1 == stop[record]) | (after == COMMA) | (after == QUOTE))
    unquoted = ((quotes[stop] - quotes[start]) & 1).astype(bool)
    unquoted[record[~(opens | closes)]] = True

    commas = np.flatnonzero(data == COMMA)
    record = np.searchsorted(at, commas, "right") - 1
    outer = ~inside(commas, record)
    commas, record = commas[outer], record[outer]
    wrong = ~unquoted & (np.bincount(record, minlength=len(start)) + 1 != n_fields)
    sound = ~unquoted & ~wrong

    keep = data != QUOTE
    keep[where[reopens]] = True
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    clean = data[keep]
    cuts = commas[sound[record]].reshape(-1, n_fields - 1)
    begins = np.column_stack([start[sound], cuts + 1])
    ends = np.column_stack([cuts, stop[sound]])
    return unquoted, wrong, sound, [gather(clean, kept[begins[:, j]], kept[ends[:, j]]) for j in range(n_fields)]


def _not_a_number(values: pa.Array) -> np.ndarray:
    v = pc.utf8_trim(values, " ")
    good = pc.or_(pc.or_(pc.equal(v, ""), pc.equal(v, "?")), pc.match_substring_regex(v, NUMBER))
    return ~np.asarray(good)


def parse_lines(df: DataFrame, line: str = "raw_line", fields: Sequence[str] = CREDIT_FIELDS, checked: Sequence[str] = CREDIT_CHECKED,
                doubles: Sequence[str] = CREDIT_DOUBLES, ints: Sequence[str] = CREDIT_INTS) -> DataFrame:
    """All lines: the other columns, ``line``, the fields (NULL for unsound lines) and ``reasons`` (empty for sound lines)."""
    fields = list(fields)
    taken = {f.lower() for f in fields} | {"reasons", line.lower()}
    kept = [c for c in df.columns if c != line]
    named = [f"{c}_in" if c.lower() in taken else c for c in kept]
    base = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, named)], F.col(f"`{line}`").alias(line))
    schema = T.StructType([*base.schema.fields, *[T.StructField(f, T.StringType()) for f in fields], T.StructField("reasons", T.ArrayType(T.StringType()))])
    n, spots = len(fields), [(fields.index(c), c) for c in checked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unquoted, wrong, sound, parts = split_lines(batch.column(batch.num_columns - 1), n)
            bad = np.zeros((len(sound), len(spots)), bool)
            for k, (j, _) in enumerate(spots):
                bad[sound, k] = _not_a_number(parts[j])
            loadable = sound & ~bad.any(axis=1)
            place = np.full(len(sound), -1)
            place[sound] = np.arange(int(sound.sum()))
            index = pa.array(place, pa.int64(), mask=~loadable)
            reasons = np.column_stack([unquoted, wrong, bad])
            names = np.array(["quoting", "columns", *[c for _, c in spots]], object)
            ends = np.concatenate([[0], np.cumsum(reasons.sum(axis=1))]).astype(np.int32)
            said = pa.ListArray.from_arrays(pa.array(ends), pa.array(names[np.nonzero(reasons)[1]], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[p.take(index) for p in parts], said], names=schema.names)

    parsed = base.mapInArrow(run, schema)
    number = lambda c: F.when(F.trim(c).rlike(SIGNED), F.trim(c).try_cast("double"))
    typed = {c: number(F.col(c)) for c in doubles} | {c: number(F.col(c)).try_cast("int") for c in ints}
    return parsed.withColumns(typed)


def load_lines(df: DataFrame, line: str = "raw_line", **how) -> tuple[DataFrame, DataFrame]:
    """The loaded rows, and one row per fault: the other columns, the line and ``reason``."""
    parsed = parse_lines(df, line, **how)
    good = parsed.filter(F.size("reasons") == 0).drop("reasons", line)
    fields = list(how.get("fields", CREDIT_FIELDS))
    bad = parsed.drop(*fields).withColumn("reason", F.explode("reasons")).drop("reasons")
    return good, bad
