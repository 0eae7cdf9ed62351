"""Status changes to stage jobs, exactly once; stage runner, retries, circuit breaker, dead letters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.session import checkpointed


def stages_of(status: Column) -> Column:
    """array of the stages that a status starts; empty for others."""
    known = {s: K.STATUS_FANOUT.get(s, (stage,)) for s, stage in K.STATUS_STAGE.items()}
    return F.coalesce(F.try_element_at(F.create_map(*(x for s, to in known.items() for x in (F.lit(s), F.array(*map(F.lit, to))))), status), F.array().cast("array<string>"))


def changed(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new)


def status_jobs(changes: DataFrame) -> DataFrame:
    """Batch form: (doc_id, stage, token) of status rows (doc_id, status, seq) that differ from the row before."""
    before = F.lag("status").over(Window.partitionBy("doc_id").orderBy("seq"))
    rows = changes.withColumn("before", before).where(changed(F.col("before"), F.col("status")))
    rows = rows.select("doc_id", F.explode(stages_of(F.col("status"))).alias("stage"), F.concat_ws(":", "status", F.col("seq").cast("string")).alias("token"))
    return guarded(rows)


def guarded(jobs: DataFrame) -> DataFrame:
    """Each (doc_id, stage, token) once; on a stream without a watermark its state grows with the jobs."""
    return jobs.dropDuplicates(["doc_id", "stage", "token"])


def status_stream(changes: DataFrame) -> DataFrame:
    """Stream form of status_jobs, exactly once: the last status and the highest seq of each document are kept as state. A row
    whose seq is not higher has been handled before and starts nothing, so the guard's state does not grow with the jobs."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, highest = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for status, seq in zip(rows["status"], rows["seq"], strict=True):
            if highest is not None and seq <= highest:
                continue
            if status != last:
                out += [(key[0], stage, f"{status}:{seq}") for stage in K.STATUS_FANOUT.get(status, (K.STATUS_STAGE[status],) if status in K.STATUS_STAGE else ())]
            last, highest = status, int(seq)
        state.update((last, highest))
        yield pd.DataFrame(out, columns=["doc_id", "stage", "token"])

    return changes.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, stage string, token string", "status string, seq long", "append", "NoTimeout")


def runnable(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(F.coalesce(F.col("run_at") <= now, F.lit(True)))


def is_paused(paused: Column, until: Column, now: Column) -> Column:
    return F.coalesce(paused, F.lit(False)) & F.coalesce(until > now, F.lit(True))


def next_state(jobs: DataFrame, now: Column) -> DataFrame:
    """What becomes of each job (stage, paused, paused_until, expected_status, document_status, ok, attempt): metric and action.
    Paused stages wait a minute; a status that moved on skips; a failure retries within the stage's budget, then goes to the
    dead letters."""
    budget = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in K.RETRIES.items() for x in kv)), F.col("stage")), F.lit(3))
    held = is_paused(F.col("paused"), F.col("paused_until"), now)
    moved = changed(F.col("expected_status"), F.col("document_status"))
    metric = F.when(held, "deferred").when(moved, "skipped").when(F.col("ok"), "ok").otherwise("failed")
    action = F.when(held, "requeue").when(moved | F.col("ok"), "done").when(F.col("attempt") < budget, "retry").otherwise("dead_letter")
    return jobs.withColumns({"metric": metric, "action": action, "run_at": F.when(held, F.timestamp_seconds(F.unix_timestamp(now) + 60))})


def breaker(metrics: DataFrame) -> DataFrame:
    """metrics (stage, seq, failed boolean) with the failure streak up to each row, and whether it pauses the stage there. A
    streak restarts after each success: failures are counted within the islands between successes. Rows are sorted into ranges
    of (stage, seq) of equal size, however many a stage has; what a range hands on to the next is one row, joined up in order on
    the driver."""
    spark = metrics.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = metrics.withColumn("of", F.coalesce("stage", F.lit(""))).repartitionByRange(parts, "of", "seq")
    ranged = checkpointed(fine.withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part", "of").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(here))
    rows = rows.withColumn("streak", F.sum(F.col("failed").cast("int")).over(Window.partitionBy("part", "of", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ranged.groupBy("part", "of").agg(F.max(F.when(~F.col("failed"), F.col("seq"))).alias("success"), F.max("seq").alias("seq"))
    tails = ranged.join(ends.select("part", "of", "success"), ["part", "of"]).groupBy("part", "of", "success").agg(F.count_if(F.col("failed") & (F.col("success").isNull() | (F.col("seq") > F.col("success")))).alias("tail"))
    last = tails.groupBy("part").agg(F.min("of").alias("first"), F.max(F.struct("of", F.col("success").isNull().alias("whole"), "tail")).alias("last"))
    carried, into = None, []
    for r in sorted(last.collect(), key=lambda r: r.part):  # one short row a range
        before = carried[1] if carried and carried[0] == r.first else 0
        if before:
            into.append((r.part, r.first, before))
        carried = (r.last.of, r.last.tail + (before if r.last.whole and r.last.of == r.first else 0))
    brought = spark.createDataFrame(into, "part int, of string, brought long")
    rows = rows.join(F.broadcast(brought), ["part", "of"], "left")  # at most one row a range
    streak = F.col("streak") + F.when(F.col("island") == 0, F.coalesce("brought", F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("streak", streak).withColumn("pauses", F.col("failed") & (F.col("streak") >= K.BREAKER_STREAK))
    return rows.select(*metrics.columns, "streak", "pauses")


def poisoned(jobs: DataFrame, n: int = 200) -> tuple[DataFrame, DataFrame]:
    """(dead letters, jobs left): the first jobs of ten attempts or more."""
    dead = jobs.where(F.col("attempts") >= K.POISON_ATTEMPTS).orderBy("id").limit(n)
    return dead, jobs.join(dead.select("id"), "id", "left_anti")


def stuck(docs: DataFrame, status: str, n: int = 50) -> DataFrame:
    """Jobs for the oldest documents of a status, past the guard."""
    rows = docs.where(F.col("pipeline_status") == status).orderBy("updated_at", "id").limit(n)
    return rows.select(F.col("id").alias("doc_id"), F.explode(stages_of(F.col("pipeline_status"))).alias("stage"))


def windowed_counts(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts and mean value by tumbling window and type. With `late`, rows later than that are dropped on a stream; batch input
    has no late rows."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")
