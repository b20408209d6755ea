import csv
import io
import random
import re

import pyarrow as pa
from pyspark.sql import types as T

from boxfold.operators.csvload import CREDIT_FIELDS, load_lines, parse_lines, split_lines

FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
SCHEMA = T.StructType([T.StructField("raw_id", T.LongType()), T.StructField("raw_line", T.StringType())])


def plain(line, n):
    """One line by regular expression: 'quoting', 'columns' or its fields."""
    line = line[:-1] if line.endswith("\r") else line
    if not re.fullmatch(f"{FIELD}(?:,{FIELD})*", line):
        return "quoting"
    fields = next(csv.reader(io.StringIO(line, newline=""), strict=True)) if line else [""]
    bare = re.sub(r'"(?:[^"]|"")*"', "q", line)
    return fields if bare.count(",") == n - 1 else "columns"


def test_split_against_regular_expression():
    rng = random.Random(0)
    lines = ["".join(rng.choice('ab",\r\né ') for _ in range(rng.randrange(12))) for _ in range(30_000)]
    lines += [",".join('"' + "".join(rng.choice('a,""\n') for _ in range(4)).replace('"', '""') + '"' if rng.random() < 0.5 else "x" for _ in range(3)) for _ in range(3_000)]
    unquoted, wrong, sound, parts = split_lines(pa.array(lines), 3)
    fields = iter(zip(*(p.to_pylist() for p in parts)))
    for line, q, w, s in zip(lines, unquoted, wrong, sound):
        expected = plain(line, 3)
        if s:
            got = list(next(fields))
            if "\n" not in line and "\r" not in line:
                assert got == expected, line
            assert expected not in ("quoting", "columns"), line
        else:
            assert expected == ("quoting" if q else "columns"), line
            assert q != w


def row(**change):
    values = dict(zip(CREDIT_FIELDS, "b,30.5,1,u,g,w,v,1.2,t,f,3,f,g,200,0,1".split(",")), **change)
    return ",".join(values.values())


def test_reasons(spark):
    cases = {
        row(): [], row(c1=" 30 "): [], row(c1='"30"'): [], row(c1="?"): [], row(c1=""): [], row(c1="+.5e-3"): [], row(c1="5."): [], row(c0='"b,""x"'): [], row(c5='"a\nb"'): [], row() + "\r": [],
        row(c1="-3"): ["c1"], row(c1="."): ["c1"], row(c1="1e"): ["c1"], row(c1="NaN"): ["c1"], row(c1="１"): ["c1"], row(c1="1\t"): ["c1"], row(c1="x", c13="0x1"): ["c1", "c13"], row(c1=" 1"): ["c1"],
        row() + ",": ["columns"], "": ["columns"], None: ["columns"], 'a"b': ["quoting"], row(c0='"b" '): ["quoting"], row(c0=' "b"'): ["quoting"], row(c0='"b'): ["quoting"], row() + "\r\r": [],
        '"' + "x" * 300_000 + '"': ["columns"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), SCHEMA)
    got = {r["raw_id"]: r["reasons"] for r in parse_lines(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_loaded_values_and_clashing_names(spark):
    df = spark.createDataFrame([(1, row(c0='"b""x"', c1=" 7 ", c2="x", c15="-1"), "kept"), (None, row(), None), (None, row(), None)], T.StructType([*SCHEMA.fields, T.StructField("c0", T.StringType())]))
    good, bad = load_lines(df)
    rows = {r["raw_id"]: r for r in good.collect()}
    assert good.count() == 3 and bad.count() == 0
    assert (rows[1]["c0"], rows[1]["c0_in"], rows[1]["c1"], rows[1]["c2"], rows[1]["c15"]) == ('b"x', "kept", 7.0, None, -1)


def test_empty_table(spark):
    good, bad = load_lines(spark.createDataFrame([], SCHEMA))
    assert good.count() == bad.count() == 0
