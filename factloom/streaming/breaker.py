"""Pauses of the circuit breaker, as a batch and as a stream with timers.

A stage whose failures in a row reach BREAKER_STREAK is paused for BREAKER_SECONDS from that failure on, and each further failure
pauses it anew; a success ends the pause and the row of failures; else it ends when its time is up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from factloom import constants as K
from factloom.operators.scans import running
from factloom.session import ship
from factloom.streaming.status import breaker

MICROS = K.BREAKER_SECONDS * 1_000_000
PAUSE = "stage string, paused_at long, ended_at long, ended_by string"


def pauses(metrics: DataFrame) -> DataFrame:
    """(stage, paused_at, ended_at, ended_by) of metrics (stage, seq, at, failed), at in microseconds and rising with seq, no part
    null. Failures that pause and follow one another in time are one pause; what precedes a failure in its row of failures is
    found by its streak, so the rows of a stage may lie on any number of tasks."""
    rows = running(metrics, ["stage"], ["seq"], row=F.when(F.col("failed"), 0).otherwise(1))  # row: which row of failures
    first = rows.where(~F.col("failed")).select("stage", (F.col("row") - 1).alias("row"), F.col("at").alias("success"))  # what ends it
    hits = breaker(rows.select("stage", "seq", "failed", "at", "row")).where("pauses").select("stage", "row", "streak", "at")
    before = hits.select("stage", "row", (F.col("streak") + 1).alias("streak"), F.col("at").alias("last"))
    hits = hits.join(before, ["stage", "row", "streak"], "left").withColumn("new", F.coalesce((F.col("at") >= F.col("last") + MICROS).cast("int"), F.lit(1)))
    hits = running(hits, ["stage", "row"], ["streak"], nth=F.col("new"))
    spans = hits.groupBy("stage", "row", "nth").agg(F.min("at").alias("paused_at"), (F.max("at") + MICROS).alias("until"))
    spans = spans.join(first, ["stage", "row"], "left")
    by_success = F.coalesce(F.col("success") < F.col("until"), F.lit(False)) & (F.col("success") >= F.col("paused_at"))
    return spans.select("stage", "paused_at", F.when(by_success, F.col("success")).otherwise(F.col("until")).alias("ended_at"), F.when(by_success, "success").otherwise("time").alias("ended_by"))


class _Breaker(StatefulProcessor):
    """State of a stage: failures in a row, since when and until when it is paused, and the rows that wait for the watermark."""

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "streak long, since long, until long")
        self.waiting = handle.getMapState("waiting", "at long, seq long", "failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for frame in rows:
            for seq, at, failed in zip(frame["seq"], frame["at"], frame["failed"], strict=True):
                self.waiting.updateValue((int(at), int(seq)), (bool(failed),))
                times.add(int(at) // 1000 + 1)
        for t in times:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        streak, since, until = self.now.get() if self.now.exists() else (0, -1, -1)
        ended = []
        due = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] < upto)
        for (at, seq), failed in due:
            self.waiting.removeKey((at, seq))
            if since >= 0 and until <= at:
                ended, since = [*ended, (since, until, "time")], -1
            if not failed:
                if since >= 0:
                    ended, since = [*ended, (since, at, "success")], -1
                streak = 0
                continue
            streak += 1
            if streak >= K.BREAKER_STREAK:
                since, until = (at if since < 0 else since), at + MICROS
        if since >= 0 and until < upto:
            ended, since = [*ended, (since, until, "time")], -1
        if since >= 0:
            self.handle.registerTimer(until // 1000 + 1)
        self.now.update((streak, since, until))
        if ended:
            yield pd.DataFrame([(key[0], *e) for e in ended], columns=["stage", "paused_at", "ended_at", "ended_by"])

    def close(self) -> None:
        pass


def pause_stream(metrics: DataFrame, late: str) -> DataFrame:
    """pauses() of a stream of metrics (stage, seq, ts, at, failed): a row waits until the watermark has passed it, rows later than
    that are dropped, and a pause comes out when it has ended, by a timer if no success ends it. State: one row a stage, and the
    rows of the last `late` of time. Needs the RocksDB state store."""
    ship(metrics.sparkSession)
    rows = metrics.withWatermark("ts", late)
    return rows.groupBy("stage").transformWithStateInPandas(_Breaker(), PAUSE, "Append", "EventTime")
