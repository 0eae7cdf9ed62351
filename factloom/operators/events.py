"""Documents to events: entities by frequency, event keys, crosswalk to known events; greedy story clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import scores as S
from factloom.functions import text as T
from factloom.operators.evidence import top_k
from factloom.operators.scans import numbered
from factloom.operators.vectors import best_of_each, unit
from factloom.session import ship

#: Documents, and events, of a day that meet in one task.
BLOCK = 4096


def top_entities(mentions: DataFrame, n: int = 5, key: str = "document_id") -> DataFrame:
    """(key, entities): the n most frequent normalised names of two letters or more, then in alphabetical order. mentions: key,
    name, position. Of equally frequent names the first seen goes first, then by name."""
    rows = mentions.withColumn("entity", T.entity(F.col("name"))).where(F.length("entity") >= 2)
    rows = rows.groupBy(key, "entity").agg(F.count("*").alias("n"), F.min("position").alias("at"))
    return top_k(rows, [key], [F.desc("n"), F.col("at"), F.col("entity")], n).groupBy(key).agg(F.array_sort(F.collect_list("entity")).alias("entities"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs (event_type, geo, published_at, entities) with event_key; the time bucket is six hours."""
    return docs.withColumn("event_key", S.event_key(F.col("event_type"), F.col("geo"), F.col("published_at"), F.col("entities")))


def interval_pairs(docs: DataFrame, events: DataFrame, hours: int = K.EVENT_HOURS) -> DataFrame:
    """Documents and events at most `hours` apart: joined by day, each event filed under the days it can reach. docs: doc_id,
    at; events: event_id, bucket."""
    seconds = hours * 3600
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400)
    reach = events.withColumn("day", F.explode(F.sequence(day(F.timestamp_seconds(F.unix_timestamp("bucket") - seconds)), day(F.timestamp_seconds(F.unix_timestamp("bucket") + seconds)))))
    apart = F.abs(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("bucket").cast("timestamp")))
    return docs.withColumn("day", day(F.col("at"))).join(reach, "day").where(apart <= seconds * 1_000_000).drop("day")


def near_events(docs: DataFrame, events: DataFrame, k: int, above: float, hours: int = K.EVENT_HOURS, *, exclude_equal: bool = False) -> DataFrame:
    """(doc_id, event_id, sim): the k events of greatest cosine above a bound of each document, among those at most `hours` apart.
    docs: doc_id, at, vec; events: event_id, bucket, vec; ids long. Both meet by day, each event filed under the days it can
    reach, and on a busy day in blocks of BLOCK by a matrix product; a task returns only k a document."""
    ship(docs.sparkSession)
    micros = hours * 3_600_000_000
    day = lambda c: F.floor(c / 86_400_000_000)
    when = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    doubles = F.col("vec").cast("array<double>").alias("vec")
    d = docs.where("vec is not null and at is not null").select(F.col("doc_id").cast("long").alias("id"), when("at").alias("at"), doubles).withColumn("day", day(F.col("at")))
    e = events.where("vec is not null and bucket is not null").select(F.col("event_id").cast("long").alias("id"), when("bucket").alias("at"), doubles)
    e = e.withColumn("day", F.explode(F.sequence(day(F.col("at") - micros), day(F.col("at") + micros))))
    blocks = lambda rows, name: rows.groupBy("day").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(d, "many").join(blocks(e, "few"), "day")  # one row a day
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = d.join(sizes, "day").withColumn("j", each("few")).select(F.struct("day", deal("many").alias("i"), "j").alias("at_"), "id", "at", "vec")
    e = e.join(sizes, "day").withColumn("i", each("many")).select(F.struct("day", "i", deal("few").alias("j")).alias("at_"), "id", "at", "vec")

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if x.num_rows and y.num_rows:
            p, q, v, b = x["id"].to_numpy(), y["id"].to_numpy(), unit(y["vec"]), y["at"].to_numpy()
            for s in range(0, len(p), 1024):
                part = x.slice(s, 1024)
                sim = np.round(unit(part["vec"]) @ v.T, 9)
                far = np.abs(part["at"].to_numpy()[:, None] - b[None, :]) > micros
                sim[far | (sim <= above) | (exclude_equal & (p[s : s + 1024, None] == q[None, :]))] = -np.inf
                row, col = best_of_each(sim, q, k)
                out.append((p[s : s + 1024][row], q[col], sim[row, col]))
        cols = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, (np.int64, np.int64, float)[j]) for j in range(3)]
        return pa.table({"doc_id": cols[0], "event_id": cols[1], "sim": cols[2]})

    met = d.groupBy("at_").cogroup(e.groupBy("at_")).applyInArrow(meet, "doc_id long, event_id long, sim double")
    return top_k(met, ["doc_id"], [F.desc("sim"), F.col("event_id")], k)


def crosswalk(docs: DataFrame, events: DataFrame, *, exclude_equal: bool = False) -> DataFrame:
    """(doc_id, event_id, score): the best known event of each document within 72 hours, cosine above .4 (50 nearest), of score
    .55 and entity overlap .10 at least. docs: doc_id, at, vec, entities, geo, event_type; events likewise with event_id, bucket.
    exclude_equal: an event of the document's own id does not count."""
    rows = near_events(docs, events, K.EVENT_KNN, K.EVENT_KNN_SIM, exclude_equal=exclude_equal)
    rows = rows.join(docs.select("doc_id", "entities", "geo", "event_type"), "doc_id")
    rows = rows.join(events.select("event_id", F.col("entities").alias("e_entities"), F.col("geo").alias("e_geo"), F.col("event_type").alias("e_type")), "event_id")
    rows = rows.withColumn("overlap", T.jaccard(F.col("entities"), F.col("e_entities")))
    rows = rows.withColumn("score", S.crosswalk(F.col("sim"), F.col("overlap"), F.coalesce(F.col("geo") == F.col("e_geo"), F.lit(False)), F.col("event_type"), F.col("e_type")))
    rows = top_k(rows, ["doc_id"], [F.desc("score"), F.desc("sim"), F.col("event_id")], 1)
    return rows.where((F.col("score") >= K.EVENT_ACCEPT) & (F.col("overlap") >= K.EVENT_MIN_JACCARD)).select("doc_id", "event_id", "score")


def resolve(docs: DataFrame, events: DataFrame, *, exclude_equal: bool = False) -> DataFrame:
    """(doc_id, event_id, how): by equal key, else by crosswalk, else a new event named by the key. Of known events with one key
    the smallest id counts."""
    k = keyed(docs)
    events = events.withColumn("event_id", F.col("event_id").cast("long"))
    exact = k.join(events.groupBy("event_key").agg(F.min("event_id").alias("exact")), "event_key", "left")
    found = crosswalk(docs, events, exclude_equal=exclude_equal).select("doc_id", F.col("event_id").alias("near"))
    rows = exact.join(found, "doc_id", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "crosswalk").otherwise("new")
    return rows.select("doc_id", F.coalesce(F.col("exact").cast("string"), F.col("near").cast("string"), "event_key").alias("event_id"), how.alias("how"))


def running_centroids(arrivals: DataFrame) -> DataFrame:
    """(event_id, centroid, n): the running mean (old * n + new) / (n + 1) over all arrivals equals their mean, whatever the
    order, so it is one partial aggregation."""
    from factloom.operators.vectors import centroids

    return centroids(arrivals, "event_id", "vec").join(arrivals.groupBy("event_id").agg(F.count("*").alias("n")), "event_id")


def greedy_clusters(ids: list[int], sim: np.ndarray) -> list[tuple[int, int, float]]:
    """(cluster, id, mean similarity to the other members). Seeds by falling degree, then id; candidates by falling similarity to
    the seed; a candidate is in if it is near enough members."""
    near = sim >= K.CLUSTER_SIM
    np.fill_diagonal(near, False)
    degree, free, out = near.sum(axis=1), np.ones(len(ids), bool), []
    for seed in sorted(range(len(ids)), key=lambda i: (-degree[i], ids[i])):
        around = np.flatnonzero(near[seed] & free) if free[seed] else []
        if len(around) < K.CLUSTER_MIN - 1:
            continue
        members = [seed]
        for c in sorted(around, key=lambda j: (-sim[seed, j], ids[j])):
            if len(members) == K.CLUSTER_MAX:
                break
            if near[c, members].mean() >= K.CLUSTER_DENSITY:
                members.append(c)
        if len(members) >= K.CLUSTER_MIN:
            free[members] = False
            number = len({o[0] for o in out})
            out += [(number, ids[m], float(np.mean([sim[m, o] for o in members if o != m]))) for m in members]
    return out


def document_vectors(segments: DataFrame) -> DataFrame:
    """(document_id, vec): the mean vector of a document's first segments. segments: document_id, position_index, embedding."""
    from factloom.operators.vectors import centroids, first_segments

    return centroids(first_segments(segments, K.CLUSTER_SEGMENTS, positions_only=True), "document_id").withColumnRenamed("centroid", "vec")


def story_clusters(docs: DataFrame, newest: int = K.CLUSTER_DOCS, hours: int = K.CLUSTER_HOURS) -> DataFrame:
    """(cluster, doc_id, score) of the newest documents (doc_id, at, vec) within 72 hours of the last (at: a time, or seconds): at
    most 200 rows, one task, as the feature says."""
    ship(docs.sparkSession)
    times = docs.withColumn("at", F.col("at").cast("timestamp"))
    last = times.agg(F.max("at").alias("last"))
    recent = times.crossJoin(F.broadcast(last)).where(F.col("at") >= F.col("last") - F.expr(f"interval {hours} hours"))  # one row
    rows = recent.where("vec is not null").orderBy(F.desc("at"), "doc_id").limit(newest).select(F.col("doc_id").cast("long"), F.col("vec").cast("array<double>")).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if got:
            u = unit(pa.chunked_array([pa.array([r[1] for r in got])]))
            found = greedy_clusters([r[0] for r in got], np.round(u @ u.T, 9))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["cluster", "doc_id", "score"])

    return rows.mapInArrow(run, "cluster int, doc_id long, score double")


def first_seen(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """Number of each value within its group by its first position (footnotes)."""
    first = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(position).alias("_at"))
    return numbered(first, [group], ["_at", value]).drop("_at")
