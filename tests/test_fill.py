import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boxfold.operators.fill import apply_fills, credit_rules, fill_cells

SCHEMA = "sid bigint, acct_no string, opened_at timestamp, c0 string, c1 double, c15 int, c3 string, _rec string"
T0 = datetime(2020, 1, 1)


def make(n, seed, accounts=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        acct = None if rng.random() < 0.05 else f"a{int(rng.paretovariate(0.7)) % accounts}"
        out.append((i, acct, T0 + timedelta(minutes=rng.randrange(n // 2)), rng.choice(["b", "a", None, "", "?", "x9", "B"]), rng.choice([20.0, 30.5, None, float("nan"), 5.0, 1e9]), rng.choice([0, 1, None, -1]), "u", "clash"))
    return out + out[: n // 10]


def brute(rows):
    import re

    has = {"c0": lambda r: bool(r[3] and re.fullmatch("[a-z][a-z0-9]{0,3}", r[3])), "c1": lambda r: r[4] is not None and r[4] == r[4] and 10 <= r[4] <= 100, "c15": lambda r: r[5] is not None and r[5] >= 0}
    out = set()
    for r in set(rows):
        for f, ok in has.items():
            if ok(r) or r[1] is None:
                continue
            best = min(((abs((d[2] - r[2]).total_seconds()), d[2], d[0]) for d in rows if d[1] == r[1] and ok(d)), default=None)
            if best:
                out.add((r[0], f, best[2]))
    return out


def cells(df, **how):
    found = fill_cells(df, record="sid", group="acct_no", time="opened_at", present=credit_rules(), **how)
    return {(r["sid"], r["field"], r["donor"]) for r in found.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = make(120, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert cells(df) == brute(rows)


def test_hot_groups_in_chunks_are_the_same(spark):
    rows = make(300, 3, accounts=2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert cells(df, hot_rows=10) == brute(rows)


def test_dependency_goes_first_and_all_cells_are_marked(spark):
    rows = [(1, "a", T0, "b", 20.0, 1, "u", ""), (2, "a", T0, "b", 20.0, 1, "u", ""), (3, "a", T0, None, None, None, "u", ""), (4, None, T0, None, 20.0, 1, "u", ""), (5, None, T0, "q", 20.0, 0, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = fill_cells(df, record="sid", group="acct_no", time="opened_at", present=credit_rules(), determinants=["acct_no", "c3"])
    by = {(r["sid"], r["field"]): r for r in found.collect()}
    assert by[3, "c0"]["method"] == "dependency:acct_no" and by[3, "c0"]["donor"] == 1
    assert by[4, "c0"]["method"] == "dependency:c3" and by[4, "c0"]["donor"] is None and by[4, "c0"]["value"] == "b"
    filled = {r["sid"]: r for r in apply_fills(df, found, record="sid", present=credit_rules()).collect()}
    assert filled[3]["c0"] == "b" and filled[3]["c1"] == 20.0 and filled[3]["c15"] == 1 and filled[3]["c0_filled"] == "dependency:acct_no"
    assert filled[1]["c0_filled"] is None and filled[5]["c0"] == "q" and len(filled) == 5


def test_nulls_ties_and_empty(spark):
    rows = [(None, "a", T0, "b", 20.0, 1, "", ""), (1, "a", None, None, 20.0, 1, "", ""), (2, "a", T0, None, 20.0, 1, "", ""), (4, "a", T0 - timedelta(hours=1), "b", 20.0, 1, "", ""), (3, "a", T0 + timedelta(hours=1), "c", 20.0, 1, "", ""), (9, "a", T0 - timedelta(hours=1), "c", 20.0, 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert cells(df) == {(2, "c0", 4)}
    assert cells(df.limit(0)) == set() and cells(df.limit(0), determinants=["c3"]) == set()


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(make(20, 4), SCHEMA)
    plan = fill_cells(df, record="sid", group="acct_no", time="opened_at", present=credit_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert F is not None
