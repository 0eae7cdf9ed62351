"""Story clusters of all documents of a window, by the greedy order.

A window of at most BLOCK documents is clustered by one task, all such windows at once. Larger ones go in rounds:
Links join documents of a window whose cosine is high enough. In the greedy order seeds go by falling degree, then id; a seed takes
those of its free neighbours that are near enough members so far, the most similar first. What a seed does depends only on seeds
before it whose neighbours it shares, that is on those within two links. So in every round all seeds act at once that come first
within two links among documents that are free and have a free neighbour; two of them never reach for the same document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.operators.events import greedy_clusters
from factloom.operators.scans import numbered
from factloom.operators.vectors import unit
from factloom.session import checkpointed, scratch_table, ship

#: Documents of a window that meet in one task, and candidates that a seed looks at in one step.
BLOCK, STEP = 2048, 64
SCHEMA = "window long, cluster long, doc_id long, score double"


def links(docs: DataFrame, least: float = K.CLUSTER_SIM) -> DataFrame:
    """(window, a, b, sim) both ways, of documents (window, id, vec) of one window. A window's documents meet in blocks, every two
    blocks once; a task holds two blocks at most."""
    ship(docs.sparkSession)
    rows = docs.where("vec is not null and id is not null and window is not null").select("window", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    parts = rows.groupBy("window").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # one row a window
    dealt = rows.join(parts, "window").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("window", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "vec")

    def meet(t: pa.Table) -> pa.Table:
        window, i, j = (t[c][0].as_py() for c in ("window", "i", "j"))
        ids, v, mine = t["id"].to_numpy(), unit(t["vec"]), t["mine"].to_numpy()
        first, second = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        found = []
        for s in range(0, len(first), 512):
            sim = np.round(v[first[s : s + 512]] @ v[second].T, 9)
            x, y = np.nonzero(sim >= least)
            keep = first[s + x] != second[y]
            found.append((ids[first[s + x]][keep], ids[second[y]][keep], sim[x, y][keep]))
        a, b, sim = (np.concatenate([f[k] for f in found]) for k in range(3))
        if i != j:
            a, b, sim = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim])
        return pa.table({"window": pa.array(np.full(len(a), window), pa.int64()), "a": a, "b": b, "sim": sim})

    return dealt.groupBy("window", "i", "j").applyInArrow(meet, "window long, a long, b long, sim double")


def _take(t: pa.Table) -> pa.Table:
    """One step of one seed: rows of what = 0 its members so far, 1 its next candidates by nth, 2 links (c, of) of these."""
    window, seed = t["window"][0].as_py(), t["seed"][0].as_py()
    rows = t.to_pylist()
    members = [r["c"] for r in rows if r["what"] == 0]
    near = {(r["c"], r["of"]) for r in rows if r["what"] == 2}
    new = []
    for r in sorted((r for r in rows if r["what"] == 1), key=lambda r: r["nth"]):
        if len(members) == K.CLUSTER_MAX:
            break
        if sum((r["c"], m) in near for m in members) / len(members) >= K.CLUSTER_DENSITY:
            members.append(r["c"])
            new.append(r["c"])
    return pa.table({"window": pa.array([window] * len(new), pa.int64()), "seed": pa.array([seed] * len(new), pa.int64()), "c": pa.array(new, pa.int64())})


def _clusters_of(seeds: DataFrame, free: DataFrame) -> DataFrame:
    """(window, seed, c): the members that the seeds (window, seed) take among their free links (window, a, b, sim)."""
    wanted = free.join(seeds.withColumnRenamed("seed", "a"), ["window", "a"], "left_semi").select("window", F.col("a").alias("seed"), F.col("b").alias("c"), "sim")
    wanted = scratch_table(numbered(wanted, ["window", "seed"], [F.desc("sim"), F.col("c")], "nth"), "candidates")
    members, low = checkpointed(seeds.withColumn("c", F.col("seed"))), 0
    while True:
        full = members.groupBy("window", "seed").agg(F.count("*").alias("n")).where(F.col("n") >= K.CLUSTER_MAX)
        now = wanted.where((F.col("nth") > low) & (F.col("nth") <= low + STEP)).join(full, ["window", "seed"], "left_anti")
        now = checkpointed(now.select("window", "seed", "c", "nth"))
        if now.isEmpty():
            return members
        mine = members.join(now.select("window", "seed").distinct(), ["window", "seed"], "left_semi")
        others = now.select("window", "seed", F.col("c").alias("of")).unionAll(mine.select("window", "seed", F.col("c").alias("of")))
        near = now.join(free.select("window", F.col("a").alias("c"), F.col("b").alias("of")), ["window", "c"]).join(others, ["window", "seed", "of"], "left_semi")
        none = F.lit(None).cast("long")
        rows = mine.select("window", "seed", F.lit(0).alias("what"), "c", none.alias("of"), none.alias("nth"))
        rows = rows.unionAll(now.select("window", "seed", F.lit(1), "c", none, "nth")).unionAll(near.select("window", "seed", F.lit(2), "c", "of", none))
        new = rows.groupBy("window", "seed").applyInArrow(_take, "window long, seed long, c long")
        members, low = checkpointed(members.unionAll(new)), low + STEP


def window_clusters(docs: DataFrame) -> DataFrame:
    """(window, cluster, doc_id, score): the clusters of every window of documents (window, id, vec), ids unique within a window; a
    cluster has the id of its seed, a member's score is its mean cosine to the others."""
    ship(docs.sparkSession)
    rows = docs.where("vec is not null and id is not null and window is not null").select("window", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    large = checkpointed(rows.groupBy("window").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("window"))
    small = rows.join(large, "window", "left_anti").groupBy("window").applyInArrow(_whole, SCHEMA)
    return small if large.isEmpty() else small.unionAll(_in_rounds(rows.join(large, "window", "left_semi")))


def _whole(t: pa.Table) -> pa.Table:
    """The clusters of one window of at most BLOCK documents."""
    ids, v = t["id"].to_pylist(), unit(t["vec"])
    found = greedy_clusters(ids, np.round(v @ v.T, 9))
    seeds: dict[int, int] = {}
    for number, i, _ in found:
        seeds.setdefault(number, i)  # a cluster's first row is its seed
    window = pa.array([t["window"][0].as_py()] * len(found), pa.int64())
    return pa.table({"window": window, "cluster": pa.array([seeds[n] for n, _, _ in found], pa.int64()), "doc_id": pa.array([i for _, i, _ in found], pa.int64()), "score": pa.array([s for _, _, s in found], pa.float64())})


def _in_rounds(docs: DataFrame) -> DataFrame:
    """The clusters of windows of any size. Links that fall short of the threshold are worked out for members only."""
    edges = scratch_table(links(docs), "links")
    degree = edges.groupBy("window", "a").agg(F.struct((-F.count("*")).alias("d"), F.col("a").alias("i")).alias("rank"))
    degree = scratch_table(degree.select("window", F.col("a").alias("id"), "rank"), "degrees")
    free = edges.join(degree.withColumnsRenamed({"id": "a", "rank": "rank_a"}), ["window", "a"])
    free = checkpointed(free)
    found: DataFrame | None = None
    while not free.isEmpty():
        nodes = free.select("window", F.col("a").alias("id"), F.col("rank_a").alias("rank")).distinct()
        near = free.groupBy("window", F.col("b").alias("id")).agg(F.min("rank_a").alias("near"))
        one = checkpointed(nodes.join(near, ["window", "id"]).select("window", "id", "rank", F.least("rank", "near").alias("best")))
        around = free.select("window", F.col("a").alias("id"), F.col("b").alias("n")).join(one.select("window", F.col("id").alias("n"), F.col("best").alias("theirs")), ["window", "n"])
        two = around.groupBy("window", "id").agg(F.min("theirs").alias("theirs"))
        seeds = one.join(two, ["window", "id"]).where(F.least("best", "theirs") == F.col("rank")).select("window", F.col("id").alias("seed"))
        taken = _clusters_of(checkpointed(seeds), free.select("window", "a", "b", "sim"))
        found = taken if found is None else found.unionAll(taken)
        gone = taken.select("window", F.col("c").alias("gone"))
        free = free.join(gone.withColumnRenamed("gone", "a"), ["window", "a"], "left_anti").join(gone.withColumnRenamed("gone", "b"), ["window", "b"], "left_anti")
        free = checkpointed(free.select("window", "a", "b", "sim", "rank_a"))
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    found = checkpointed(found)
    vecs = docs.select("window", F.col("id").cast("long").alias("c"), F.col("vec").cast("array<double>").alias("vec"))

    def scored(t: pa.Table) -> pa.Table:
        v = unit(t["vec"])
        sim = np.round(v @ v.T, 9)
        score = (sim.sum(axis=1) - sim.diagonal()) / max(len(v) - 1, 1)
        return pa.table({"window": t["window"], "cluster": t["seed"], "doc_id": t["c"], "score": score})

    return found.join(vecs, ["window", "c"]).groupBy("window", "seed").applyInArrow(scored, SCHEMA)
