"""Documents to events in the order of their arrival: what a document makes or moves, later ones meet.

A document joins the event of its key; else the known event that fits it best, whose centroid and count it moves; else it makes an
event of its own. Only events whose bucket is within 72 hours of a document can be met, so time is cut into blocks of that reach: a
block needs the events of its own time, those of the block before as that one left them, and known ones of the block after. All
blocks fold their documents at once, in order, on what the blocks before left in the round before; then those are folded anew whose
input has changed. The first block is right after one round and each next one after its own at the latest, so when no input changes
any more the result is that of the one-by-one order. Influence dies out over a few blocks, so a few rounds do.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.operators.events import keyed
from factloom.session import checkpointed, ship

SECONDS = K.EVENT_HOURS * 3600
MERGED = 10
_EVENT = "event_id string, key string, kind string, geo string, bucket long, entities array<string>, cluster_entities array<string>, centroid array<double>, n long"
_EVENT_COLUMNS = [c.split()[0] for c in _EVENT.split(", ")]
_OUT = f"block long, doc_id long, how string, left string, {_EVENT}"
_OUT_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum())
    return v / size if size > 0 else v * 0


def overlap(a: list[str], b: list[str]) -> float:
    """Jaccard of two lists; 0 of empty ones."""
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


class Timeline:
    """The events of one block and its neighbours while documents arrive."""

    def __init__(self, events: list[dict[str, Any]]):
        self.events, self.by_key, self.vectors, self.filled = [], {}, np.zeros((16, 0)), 0
        self.buckets, self.has = np.zeros(16, np.int64), np.zeros(16, bool)
        for e in sorted(events, key=lambda e: e["event_id"]):
            self._add(dict(e))

    def _add(self, event: dict[str, Any]) -> dict[str, Any]:
        at = len(self.events)
        if at == len(self.buckets):
            self.buckets, self.has = np.resize(self.buckets, 2 * at), np.resize(self.has, 2 * at)
            self.vectors = np.resize(self.vectors, (2 * at, self.vectors.shape[1]))
        event["at"] = at
        self.events.append(event)
        if event["key"] is not None:
            self.by_key.setdefault(event["key"], event)
        self.buckets[at] = event["bucket"]
        self._place(event)
        return event

    def _place(self, event: dict[str, Any]) -> None:
        c = event["centroid"]
        self.has[event["at"]] = c is not None
        if c is not None:
            if self.vectors.shape[1] != len(c):
                if self.vectors.shape[1]:
                    raise ValueError("vectors must have one length")
                self.vectors = np.zeros((len(self.buckets), len(c)))
            self.vectors[event["at"]] = _unit(np.array(c))

    def fits(self, doc: dict[str, Any]) -> dict[str, Any] | None:
        """The best event by crosswalk, if it is good enough."""
        if doc["vec"] is None or not self.vectors.shape[1]:
            return None
        n = len(self.events)
        near = np.flatnonzero(self.has[:n] & (np.abs(self.buckets[:n] * 1_000_000 - doc["micros"]) <= SECONDS * 1_000_000))
        sim = np.round(self.vectors[near] @ _unit(np.array(doc["vec"])), 9)
        near, sim = near[sim > K.EVENT_KNN_SIM], sim[sim > K.EVENT_KNN_SIM]
        ranked = sorted(zip((-sim).tolist(), (self.events[i]["event_id"] for i in near), near.tolist(), strict=True))[: K.EVENT_KNN]
        best: tuple | None = None
        for minus, name, i in ranked:
            e = self.events[i]
            shared = overlap(doc["entities"], e["entities"])
            kinds = 1.0 if e["kind"] == doc["kind"] else 0.5 if "OTHER" not in (e["kind"], doc["kind"]) else 0.0
            score = K.EVENT_SIM * -minus + K.EVENT_JACCARD * shared + K.EVENT_GEO * (e["geo"] == doc["geo"]) + K.EVENT_TYPE * kinds
            rank = (-score, minus, name)
            if best is None or rank < best[0]:
                best = (rank, shared, e)
        return best[2] if best and -best[0][0] >= K.EVENT_ACCEPT and best[1] >= K.EVENT_MIN_JACCARD else None

    def arrive(self, doc: dict[str, Any]) -> tuple[str, str]:
        """(event, how) of a document, and what it does to the event."""
        event = self.by_key.get(doc["key"])
        if event is not None:
            event["n"], event["cluster_entities"] = event["n"] + 1, doc["entities"]
            return event["event_id"], "exact"
        event = self.fits(doc)
        if event is not None:
            n = event["n"] or 1
            event["centroid"] = ((np.array(event["centroid"]) * n + np.array(doc["vec"])) / (n + 1)).tolist()
            event["n"], event["cluster_entities"] = n + 1, merged(event["cluster_entities"], doc["entities"])
            self._place(event)
            return event["event_id"], "crosswalk"
        made = {"event_id": doc["key"], "key": doc["key"], "kind": doc["kind"], "geo": doc["geo"], "bucket": doc["micros"] // 21_600_000_000 * 21_600, "entities": doc["entities"], "cluster_entities": doc["entities"], "centroid": doc["vec"], "n": 1}
        return self._add(made)["event_id"], "new"


def merged(old: list[str], new: list[str]) -> list[str]:
    """The MERGED most frequent names of both, of equals those seen first, in alphabetical order."""
    return sorted(x for x, _ in Counter([*(old or []), *new]).most_common(MERGED))


def _digest(events: list[dict[str, Any]]) -> str:
    return hashlib.sha256(repr([[e[c] for c in _EVENT_COLUMNS] for e in sorted(events, key=lambda e: e["event_id"])]).encode()).hexdigest()


def _fold(docs: pa.Table, events: pa.Table) -> pa.Table:
    """One block: its documents in order on the events it can meet. Rows: a document with its event, or the state of an event
    after the block, or, once, a digest of what the block leaves to the next."""
    out: list[dict[str, Any]] = []
    if docs.num_rows:
        block = docs["block"][0].as_py()
        line = Timeline(events.to_pylist())
        for d in sorted(docs.to_pylist(), key=lambda d: (d["micros"], d["doc_id"])):
            event, how = line.arrive(d | {"entities": d["entities"] or []})
            out.append({"block": block, "doc_id": d["doc_id"], "event_id": event, "how": how})
        out += [{"block": block} | {c: e[c] for c in _EVENT_COLUMNS} for e in line.events]
        out.append({"block": block, "left": _digest([e for e in line.events if e["bucket"] // SECONDS >= block])})
    columns = [pa.array([r.get(c) for r in out], t) for c, t in zip(_OUT_COLUMNS, _types(), strict=True)]
    return pa.Table.from_arrays(columns, _OUT_COLUMNS)


def _types() -> list[pa.DataType]:
    named = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    return [named[c.split()[1]] for c in _OUT.split(", ")]


def resolve_arrivals(docs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, event_id, how) of each document, and the events after all of them: event_id, key, kind, geo, bucket (seconds),
    entities, cluster_entities, centroid, n, of those that a document could meet. docs: doc_id (unique), at, event_type, geo,
    entities, vec (or null); by time, then id. known: event_id, event_key, event_type, geo, bucket, entities, centroid,
    document_count; of known events with one key the one of smallest id, as text, counts. Documents without a time are left out."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs.where("at is not null and doc_id is not null").withColumn("published_at", F.col("at")))
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    rows = rows.select(F.floor(micros / (SECONDS * 1_000_000)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), micros.alias("micros"), F.col("event_key").alias("key"), F.col("event_type").alias("kind"), "geo", "entities", F.col("vec").cast("array<double>").alias("vec"))
    rows = checkpointed(rows)
    blocks = rows.select("block").distinct()
    stored = spark.createDataFrame([], _EVENT) if known is None else known.select(F.col("event_id").cast("string").alias("event_id"), F.col("event_key").alias("key"), F.col("event_type").alias("kind"), "geo", F.unix_timestamp(F.col("bucket").cast("timestamp")).alias("bucket"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.col("entities").alias("cluster_entities"), F.col("centroid").cast("array<double>").alias("centroid"), F.coalesce(F.col("document_count").cast("long"), F.lit(1)).alias("n"))
    own = F.floor(F.col("bucket") / SECONDS)
    reach = stored.withColumn("block", F.explode(F.array(own - 1, own, own + 1))).join(blocks, "block", "left_semi")
    stored = checkpointed(reach.withColumn("of", own))
    before = blocks.select((F.col("block") + 1).alias("block")).join(blocks, "block", "left_semi")  # blocks that follow one
    first_seen = stored.where("of = block + 1").drop("of").unionAll(stored.where("of <= block").join(before, "block", "left_anti").drop("of"))

    def folded(of: DataFrame, inputs: DataFrame) -> DataFrame:
        events = first_seen.unionByName(inputs.select(*first_seen.columns)).join(of, "block", "left_semi")
        some = rows.join(of, "block", "left_semi")
        return some.groupBy("block").cogroup(events.groupBy("block")).applyInArrow(_fold, _OUT)

    def handed(found: DataFrame) -> DataFrame:
        """What blocks get from those before: the states of events of that block and their own."""
        states = found.where("doc_id is null and left is null").withColumn("of", F.floor(F.col("bucket") / SECONDS)).where("of >= block")
        return states.select((F.col("block") + 1).alias("block"), *_EVENT_COLUMNS).join(before, "block", "left_semi")

    given = stored.where("of <= block").join(before, "block", "left_semi").select("block", *_EVENT_COLUMNS)
    found = checkpointed(folded(blocks, given))
    used = checkpointed(before.withColumn("used", F.lit("")))  # digests of what each block was folded on
    while True:
        left = found.where("left is not null").select((F.col("block") + 1).alias("block"), "left").join(before, "block", "left_semi")
        changed = checkpointed(left.join(used, "block").where("left <> used").select("block", "left"))
        if changed.isEmpty():
            break
        again = changed.select("block")
        new = folded(again, handed(found))
        found = checkpointed(found.join(again, "block", "left_anti").unionByName(new))
        used = checkpointed(used.join(again, "block", "left_anti").unionAll(changed))
    states = found.where("doc_id is null and left is null")
    latest = states.groupBy("event_id").agg(F.max_by(F.struct(*_EVENT_COLUMNS[1:]), "block").alias("e")).select("event_id", "e.*")
    return found.where("doc_id is not null").select("doc_id", "event_id", "how"), latest
