"""The stored table: rows as by plain rewriting, untouched files kept, writes that die or meet."""

import os
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import tables
from factloom.operators.stored import StoredTable

SCHEMA = "id long, at long, text string"


def files(path):
    return {f"{d}/{x}": os.stat(f"{d}/{x}").st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.randint(0, 9), f"old {i}") for i in range(400)] + [(None, 1, "null key")], SCHEMA)
    t = StoredTable(spark, str(tmp_path / "t"), "id", 16)
    t.create(rows)
    before = files(tmp_path / "t")
    new = spark.createDataFrame([(7, 15, "new"), (7, 16, "newer"), (1000, 0, "more"), (8, -1, "late")], SCHEMA)
    written = t.upsert(new, "at")
    assert 0 < written <= 3
    want = sorted(map(str, tables.upsert(rows, new, ["id"], F.col("at")).collect()))
    assert sorted(map(str, t.read().collect())) == want and any("newer" in w for w in want)
    after = files(tmp_path / "t")
    assert all(after[f] == at for f, at in before.items())  # no file is touched; those of other buckets are still read
    used = {r[0].split("file://")[-1].replace("///", "/") for r in t.read().select(F.input_file_name()).distinct().collect()}
    assert len(used & set(before)) >= 13
    t.vacuum()
    assert sorted(map(str, t.read().collect())) == want and len(t._numbers()) == 1


def test_replace_takes_all_rows_of_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(i // 3, i % 3, "s") for i in range(90)], SCHEMA)
    t = StoredTable(spark, str(tmp_path / "t"), "id", 8)
    t.create(rows)
    new = spark.createDataFrame([(4, 0, "whole"), (77, 0, "new")], SCHEMA)
    t.replace(new)
    assert sorted(map(str, t.read().collect())) == sorted(map(str, tables.replace_groups(rows, new, "id").collect()))


def test_a_write_that_dies_or_comes_second_changes_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, 0, "a") for i in range(20)], SCHEMA)
    t = StoredTable(spark, str(tmp_path / "t"), "id", 4)
    with pytest.raises(ValueError, match="no table"):
        t.read()
    t.create(rows)
    want, new = sorted(map(str, t.read().collect())), spark.createDataFrame([(3, 9, "b")], SCHEMA)
    bad = new.withColumn("text", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        t.upsert(bad, "at")
    assert sorted(map(str, t.read().collect())) == want
    number, now = t.version()
    late = t._write(rows.limit(1))
    t.upsert(new, "at")
    with pytest.raises(RuntimeError, match="another write"):
        t._commit(number, now, late)
    assert [r.text for r in t.read().where("id = 3").collect()] == ["b"]
