"""Operator 1: quality rules. Base rules, then an isolation forest on the rule statistics.

The forest isolates on all rule statistics: number of words, mean word length, and shares of symbols, repeated lines,
repeated windows, capitals and exclamation marks. Its trees are grown on 256 rows each, as the method has it, without labels; the
rows are drawn by hash from all documents that the base rules pass, each for one tree where there are enough. A
document's anomaly comes from its mean path length. Its cause is the statistic whose splits narrowed its paths most: a split
that leaves a part of a node's rows gives its statistic the logarithm of that part's inverse.

Labels only set thresholds, one for each cause: the fewest wrong verdicts on all labelled rows while the causes together lose
at most `max_lost` of the rows of quality 1; a cause for which none helps takes the threshold of all rows together. They are
found by running sums over (cause, score) on Spark, exactly: no labelled row is left out. Texts are read once; what is measured in
them is written beside the checkpoints, and forest, thresholds and verdicts of all documents come from there.

Defined results: null and empty texts have zero counts and fail the base rules; repeated rows each get a row; a null
doc_id stays null; other columns of the input are ignored; of several labels of a document the largest counts, and each of the
rows that share a labelled id is a labelled row; without labelled rows of both kinds the forest rejects nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import text_stats as ts
from factloom.llm.common import map_arrow, materialise, utf8
from factloom.session import scratch_table

MIN_WORDS = 20
REPEAT_PERCENT = 30
TREES, TREE_ROWS = 100, 256
BUCKETS = 4096  # of scores, between which running sums are carried on
STATISTICS = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "exclaims")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double, cause string"
SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def statistics(m: np.ndarray) -> np.ndarray:
    """STATISTICS of text_stats.measure_all's rows, smoothed so that short texts stay near the middle."""
    m = m.astype(float)
    words, chars, symbols, dup, repeat, lines, capitals, letters = m[:, :8].T
    exclaims = m[:, ts.FIELDS.index("n_exclaim")]
    a_word = lambda n: np.log1p(20 * n / (words + 10))
    return np.stack([np.log1p(words), np.log((chars + 50) / (words + 10)), a_word(symbols), dup / (lines + 1), repeat / (words + 10), capitals / (letters + 60), a_word(exclaims)], axis=1)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of n keys."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays; all trees are walked at once, level by level."""

    def __init__(self, trees: int = TREES, sample: int = TREE_ROWS, seed: int = 7):
        self.trees, self.sample, self.seed = trees, sample, seed

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.norm = max(float(_mean_path(size)), 1e-9)
        nodes: list[list[float]] = []  # feature, threshold, left, right, path length
        credit: list[np.ndarray] = []  # by feature: how much its splits narrowed the way here
        roots = []

        def grow(rows: np.ndarray, level: int, earned: np.ndarray) -> int:
            me = len(nodes)
            nodes.append([0, np.inf, me, me, level + float(_mean_path(len(rows)))])
            credit.append(earned)
            low, high = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(high > low)
            if level < self.depth and len(rows) > 1 and len(usable):
                f = int(rng.choice(usable))
                t = rng.uniform(low[f], high[f])
                go = rows[:, f] <= t
                if go.any() and not go.all():
                    sides = []
                    for side in (rows[go], rows[~go]):
                        more = earned.copy()
                        more[f] += np.log2(len(rows) / len(side))
                        sides.append(grow(side, level + 1, more))
                    nodes[me][:4] = [f, t, *sides]
            return me

        if len(x) >= self.trees * size:  # each tree has rows of its own
            picked = rng.permutation(len(x))[: self.trees * size].reshape(self.trees, size)
        else:
            picked = [rng.choice(len(x), size, replace=False) for _ in range(self.trees)]
        for rows in picked:
            roots.append(grow(x[rows], 0, np.zeros(x.shape[1])))
        flat = np.array(nodes)
        self.roots, self.credit = np.array(roots), np.array(credit)
        self.feature, self.threshold, self.length = flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 4]
        self.children = flat[:, 2:4].astype(np.int64)
        return self

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anomaly in (0, 1), 2 to the minus mean path over the mean path expected, and the number of the cause."""
        if not len(x):
            return np.zeros(0), np.zeros(0, np.int64)
        at = np.broadcast_to(self.roots, (len(x), self.trees)).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = self.children[at, right.astype(np.int64)]
        earned = np.zeros((len(x), x.shape[1]))
        for k in range(self.trees):
            earned += self.credit[at[:, k]]
        return np.round(2.0 ** (-self.length[at].mean(axis=1) / self.norm), 12), np.argmax(np.round(earned, 9), axis=1)


def calibrate(scores: np.ndarray, good: np.ndarray, may_lose: float) -> float:
    """The threshold with the fewest wrong verdicts on the labelled rows among those that lose at most may_lose good ones; the
    highest of equals. Infinite where none is better than keeping all."""
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    lost, caught = np.cumsum(g), np.cumsum(~g)
    ends = np.append(s[1:] < s[:-1], True)[: len(s)]  # all rows of one score fall together
    usable = ends & (lost <= may_lose) & (caught > lost)
    if not usable.any():
        return float("inf")
    k = int(np.argmax(np.where(usable, caught - lost, -1)))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(np.nextafter(s[k], 0))


def thresholds(scores: np.ndarray, cause: np.ndarray, good: np.ndarray, max_lost: float) -> np.ndarray:
    """Of each cause; all infinite without labelled rows of both kinds. For rows in memory; limits() gives the same on Spark."""
    n = len(STATISTICS)
    if not good.any() or good.all():
        return np.full(n, np.inf)
    every = calibrate(scores, good, max_lost * good.sum())
    own = np.array([calibrate(scores[cause == c], good[cause == c], max_lost * good.sum() / n) for c in range(n)])
    return np.where(np.isfinite(own), own, every)


def base_failed(m: np.ndarray) -> np.ndarray:
    return (m[:, 0] < MIN_WORDS) | (100 * m[:, 4] > REPEAT_PERCENT * m[:, 0])


def limits(labelled: DataFrame, max_lost: float) -> np.ndarray:
    """thresholds() of all rows (cause, score, good), whose sorted sums stay on Spark: within buckets of the scores of a cause, then
    over its buckets. Only the threshold of each cause and of all rows comes to the driver."""
    n = len(STATISTICS)
    parts = labelled.select(F.explode(F.array("cause", F.lit(n))).alias("part"), "score", "good")  # part n: all rows
    counts = materialise(parts.groupBy("part", F.floor(F.col("score") * BUCKETS).alias("bucket"), "score").agg(F.sum("good").alias("lost"), F.sum(1 - F.col("good")).alias("caught")))
    total = counts.where(F.col("part") == n).agg(F.sum("lost").alias("good"), F.sum("caught").alias("bad")).first()
    if not total.good or not total.bad:
        return np.full(n, np.inf)
    within = Window.partitionBy("part", "bucket").orderBy(F.desc("score"))
    over = Window.partitionBy("part").orderBy(F.desc("bucket"))  # of at most BUCKETS rows
    buckets = counts.groupBy("part", "bucket").agg(F.sum("lost").alias("lost"), F.sum("caught").alias("caught"), F.max("score").alias("top"))
    buckets = buckets.select("part", "bucket", *((F.sum(c).over(over) - F.col(c)).alias(f"{c}_above") for c in ("lost", "caught")), F.lead("top").over(over).alias("below"))
    rows = counts.select("part", "bucket", "score", *(F.sum(c).over(within).alias(c) for c in ("lost", "caught")), F.lead("score").over(within).alias("next"))
    rows = rows.join(F.broadcast(buckets), ["part", "bucket"])
    lost, gain = F.col("lost") + F.col("lost_above"), F.col("caught") + F.col("caught_above") - F.col("lost") - F.col("lost_above")
    may_lose = F.when(F.col("part") == n, F.lit(max_lost * total.good)).otherwise(F.lit(max_lost * total.good / n))
    best = rows.where((lost <= may_lose) & (gain > 0)).groupBy("part").agg(F.max(F.struct(gain.alias("gain"), "score", F.coalesce("next", "below").alias("next"))).alias("best"))
    found = np.full(n + 1, np.inf)  # infinite where none is better than keeping all
    for part, (_, score, lower) in best.collect():
        found[part] = np.nextafter(score, 0) if lower is None else (score + lower) / 2
    return np.where(np.isfinite(found[:n]), found[:n], found[n])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(ts.FIELDS))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, m, base_failed) of every document, m being text_stats.FIELDS; written, so that texts are read once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = ts.measure_all(utf8(batch.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * len(ts.FIELDS), pa.int32()), pa.array(m.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists, pa.array(base_failed(m))], ["doc_id", "m", "base_failed"])

    return scratch_table(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, m array<long>, base_failed boolean"), "measured")


def grown(rows: DataFrame) -> IsolationForest | None:
    """The forest of measured documents. The rows of its trees, TREES * TREE_ROWS in all, are those of the smallest hashes among all
    that the base rules pass; the bound on hashes only keeps others from being sorted."""
    judged = rows.where(~F.col("base_failed")).select("doc_id", "m", F.shiftrightunsigned(F.xxhash64("doc_id", "m"), 1).alias("h"))
    want, n = TREES * TREE_ROWS, judged.count()
    if not n:
        return None
    share = (want + 6 * want**0.5) / n
    if share < 1:
        judged = judged.where(F.col("h") < int(share * 2**63))
    m = np.array([r.m for r in judged.orderBy("h", "doc_id", "m").limit(want).select("m").collect()], np.int64)
    return IsolationForest().fit(statistics(m.reshape(-1, len(ts.FIELDS))))


def _fit(rows: DataFrame, labels: DataFrame, *, max_lost: float = 0.01) -> tuple[Broadcast, np.ndarray]:
    """Forest, sent to the executors, and thresholds."""
    model = rows.sparkSession.sparkContext.broadcast(grown(rows))  # 100 trees of at most 511 nodes
    if model.value is None:
        return model, np.full(len(STATISTICS), np.inf)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, cause = model.value.score(statistics(_matrix(batch.column(0))))
        return pa.RecordBatch.from_arrays([pa.array(cause.astype(np.int32)), pa.array(score), batch.column(1)], ["cause", "score", "good"])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("good")).where("doc_id is not null and good in (0, 1)")
    labelled = rows.where(~F.col("base_failed")).join(known.groupBy("doc_id").agg(F.max("good").alias("good")), "doc_id").select("m", "good")
    return model, limits(map_arrow(labelled, run, "cause int, score double, good long"), max_lost)


def fit(docs: DataFrame, labels: DataFrame, **parameters) -> tuple[IsolationForest | None, np.ndarray]:
    """Forest, of all documents, and thresholds, of all labelled ones."""
    model, own = _fit(measured(docs), labels, **parameters)
    return model.value, own


def judge(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """One row for each document: counts, base verdict, and the forest's verdict among those the base rules pass."""
    rows = measured(docs)
    model, own = _fit(rows, labels, **parameters)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        forest, m = model.value, _matrix(batch.column(1))
        failed = base_failed(m)
        score, cause = forest.score(statistics(m)) if forest else (np.zeros(len(m)), np.zeros(len(m), np.int64))
        kept = ~failed & ~(score > own[cause])
        names = pa.array([STATISTICS[c] if forest else None for c in cause.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(score), names], SCHEMA_NAMES)

    return map_arrow(rows.select("doc_id", "m"), run, SCHEMA)
