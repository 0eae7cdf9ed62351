"""Breaker pauses: batch and stream against a plain walk."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.streaming import breaker as B

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def walk(rows):
    """(stage, paused_at, ended_at, ended_by), one row after another; what is open at the end ends in time."""
    out, state = [], {}
    for stage, seq, at, failed in sorted(rows, key=lambda r: (r[0], r[1])):
        streak, since, until = state.get(stage, (0, None, None))
        if since is not None and until <= at:
            out.append((stage, since, until, "time"))
            since = None
        if not failed:
            if since is not None:
                out.append((stage, since, at, "success"))
            streak, since = 0, None
        else:
            streak += 1
            if streak >= K.BREAKER_STREAK:
                since, until = at if since is None else since, at + B.MICROS
        state[stage] = (streak, since, until)
    return sorted(out + [(s, since, until, "time") for s, (_, since, until) in state.items() if since is not None])


def events(seed, n=400):
    rng, rows = random.Random(seed), []
    for stage, share in (("a", 0.97), ("b", 0.8), ("hot", 0.9), ("hot", 0.9), ("never", 0.1)):
        at = 1_704_067_200_000_000
        for _ in range(n):
            at += rng.choice([0, 1_000_000, 20_000_000, B.MICROS, B.MICROS - 1, rng.randint(0, 2 * B.MICROS)])
            rows.append((stage, len(rows), at, rng.random() < share))
    by = {}
    for s, q, a, f in rows:  # one clock a stage
        by.setdefault(s, []).append([a, f])
    return [(s, i, a, f) for s, x in by.items() for i, (a, f) in enumerate(sorted(x, key=lambda p: p[0]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_a_walk(spark, seed):
    rows = events(seed)
    df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "stage string, seq long, at long, failed boolean")
    want = walk(rows)
    assert sorted(map(tuple, B.pauses(df).collect())) == want and {w[3] for w in want} == {"time", "success"}
    assert B.pauses(df.where("false")).collect() == []


def test_stream_equals_the_batch_on_shuffled_input(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events(3, 60)
    shuffled = random.Random(3).sample(rows, len(rows))
    schema = "stage string, seq long, at long, failed boolean"
    last = max(r[2] for r in rows)
    parts = [shuffled[i::3] for i in range(3)] + [[("tick", k, last + 10**13 * (k + 1), False)] for k in range(2)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = B.pause_stream(stream.withColumn("ts", F.timestamp_micros("at")), "40 days")
    try:
        q = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == walk(rows)
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 40  # a few rows a stage: what waited is gone
