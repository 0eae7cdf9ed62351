"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import importlib.util
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def rows(frame):
    show = lambda v: "null" if v is None or str(v) in ("<NA>", "nan", "None") or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", [n for n in contract.oracle_sql() if n in contract.queries()])
def test_equals_sql(name, spark, db):
    assert rows(contract.queries()[name](spark, SF).toPandas()) == rows(db.sql(contract.oracle_sql()[name]).df())


def test_stream_equals_batch_query(spark):
    q = contract.queries()
    assert sorted(map(tuple, q["stage_events_stream"](spark, SF).collect())) == sorted(map(tuple, q["enqueue_guard"](spark, SF).collect()))


def test_entry_and_other_queries_run(spark):
    assert contract.entry(spark).count() > 0
    for name, f in contract.queries().items():
        if name not in contract.oracle_sql() and not name.startswith("op") and name != "pipeline":
            assert (f(spark, SF).count() > 0) == (name != "cluster_greedy"), name  # no two of its 200 single vectors are near enough


def test_queries_take_empty_tables(spark, tmp_path):
    from factloom.plans import catalogue

    for t in os.listdir(SF):
        spark.read.parquet(f"{SF}/{t}").where("false").write.parquet(str(tmp_path / t))
    one_row = {"exact_counts", "health_level", "ops_summary", "status_count_map"}  # aggregates of nothing
    made = {"optional_filter", "proposition_seed", "feed_admin", "registered_models", "category_counts", "sitemap", "semi_passthrough"}  # rows that no table gives
    for name, f in catalogue.QUERIES.items():
        n = f(spark, str(tmp_path)).count()
        assert n == 0 or name in made or (name in one_row and n == 1), (name, n)


def test_operators_are_optional():
    there = importlib.util.find_spec("factloom.llm") is not None
    assert any(n.startswith("op1_") for n in contract.queries()) == there


@pytest.mark.parametrize("name", ["verdict_fusion", "claim_insights"])
def test_means_add_by_event_whatever_the_files(name, spark, tmp_path):
    """Confidences of an exact mean of a threshold: which side a sum of doubles falls on depends on its order. The SQL runs on one thread, in the events' order."""
    rng, rows = random.Random(7), []
    for user in range(3, 1200, 4):  # of low risk
        ks = [rng.randint(1, 99) for _ in range(rng.randint(4, 15))]
        ks += [100 - k for k in ks]
        rng.shuffle(ks)
        rows += [(user, "view", f'{{"k": {k}}}') for k in ks]
    rng.shuffle(rows)
    events = spark.createDataFrame([(4 * i + 1, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, props string")
    events.repartition(7, "props").sortWithinPartitions(F.desc("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    one = duckdb.connect(config={"threads": 1})
    one.sql(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    assert rows_of(contract.queries()[name](spark, str(tmp_path))) == sorted(one.sql(contract.oracle_sql()[name]).fetchall())


def rows_of(df):
    """Rows as they are, doubles to the last bit."""
    return sorted(map(tuple, df.collect()))
