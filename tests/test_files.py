import random

import pytest

from boxfold.operators.csvload import load_lines
from boxfold.sources import files


def split_at_even_quotes(text):
    out, held, odd = [], [], 0
    lines = text.split("\n")
    for line in lines[:-1] if text.endswith("\n") else lines:
        held.append(line)
        odd ^= line.count('"') & 1
        if not odd:
            out.append("\n".join(held))
            held = []
    return out + (["\n".join(held)] if held else [])


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_record_ends_are_found_over_splits(spark, tmp_path, size):
    rng, want = random.Random(size), []
    for k in range(3):
        records = []
        for i in range(60):
            fields = [f'"{i}\n{"x" * rng.randrange(90)}\r\n, ""q"" "' if rng.random() < 0.3 else str(rng.randrange(1000)) for _ in range(3)]
            records.append(",".join(fields))
        text = "\n".join(records) + ("\n" if k else "") + ('"open\nend' if k == 2 else "")
        (tmp_path / f"f{k}.csv").write_bytes(text.encode())
        want += [(f"f{k}.csv", r) for r in split_at_even_quotes(text)]
    (tmp_path / "g.csv").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = files.read_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((r["source"].rsplit("/", 1)[1], r["split"], r["place"], r["raw_line"]) for r in rows)
    assert [(f, line) for f, _, _, line in got] == want
    assert len({g[:3] for g in got}) == len(got)


def test_files_load_with_line_breaks_in_quotes(spark, tmp_path):
    good = 'b,30.83,0,u,g,w,v,1.25,t,t,1,f,"g\nh",202,0,1'
    (tmp_path / "a.csv").write_text(good + "\n" + "b,30\n" + good.replace("30.83", "x") + "\n")
    loaded, faults = load_lines(files.read_records(spark, str(tmp_path / "a.csv")))
    (row,) = loaded.collect()
    assert row["c12"] == "g\nh" and row["c1"] == 30.83
    assert sorted(r["reason"] for r in faults.collect()) == ["c1", "columns"]


def test_numbers_follow_the_file_over_splits(spark, tmp_path):
    (tmp_path / "n.csv").write_text("".join(f"{k / 100},{k},{k % 3}\n" for k in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.read_numeric(spark, str(tmp_path), 2).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["seq"], r["xl"][1], r["y"]) for r in rows] == [(k, float(k), k % 3) for k in range(200)]
