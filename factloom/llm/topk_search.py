"""Operator 9: exact top-k by integer inner product with ball trees.

Candidates are dealt into shards and queries into blocks, row by row, whatever their ids; every block meets every shard in a task of
its own. A task builds the shard's ball tree and descends it with all its queries at once: a ball's bound is the query's
product with the centre plus its norm times the radius; the child of greater bound goes first, and a query leaves a ball
whose bound is under its kth score. Shards are searched in waves, each several times the one before; after each wave the
current kth score of every query is shared with the next, which returns only what can still enter.

Vectors: each component x becomes floor(64 x), as double, then long (clamped to its range). A product is found in doubles, with a
bound on its rounding: none while sums stay under 2^53, else by the lengths of the two vectors. Rows whose product may reach the
kth score, the bound added, are then scored exactly, in Python's integers where doubles are not; a sum beyond long is clamped.

Defined results: null vectors, vectors with null or non-finite components, and null ids take no part; vectors of another
length than the query's are no candidates; every row is a candidate, also of rows that share a vec_id, but for those of the
query's own id; rows that share a query's id ask together and get the k best of all their scores; a query without candidates has
no rows; ties go to the smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise

K, EVERY = 20, 20
LEAF, MOST_ROWS, LEAST_ROWS = 256, 65536, 1024
_RESULT = "query_id long, vec_id long, score long"
_LOW, _HIGH = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null").where(~bad)
    clamp: Column = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x * 64, F.lit(9.2e18)), F.lit(-9.2e18))))
    return rows.select("vec_id", clamp.alias("v"))


class BallTree:
    """Balls over the rows of x, halved along the line through two far points, down to LEAF rows."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        self.root = self._grow(0, len(x))
        self.centres, self.radii = np.array(self.centre), np.array(self.radius)

    def _grow(self, lo: int, hi: int) -> int:
        rows = self.x[self.order[lo:hi]]
        me, centre = len(self.centre), rows.mean(axis=0)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        self.centre.append(centre)
        self.radius.append(float(away.max()) * (1 + 1e-9) + 1e-6)
        self.span.append((lo, hi))
        self.child.append(None)
        if hi - lo > LEAF and away.max() > 0:
            far = rows[int(np.argmax(away))]
            other = rows[int(np.argmax(((rows - far) ** 2).sum(axis=1)))]
            by = np.argsort(rows @ (other - far), kind="stable")
            self.order[lo:hi] = self.order[lo:hi][by]
            mid = (lo + hi) // 2
            self.child[me] = (self._grow(lo, mid), self._grow(mid, hi))
        return me


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of matching rows, clamped to long. Equal pairs are worked out once."""
    both, back = np.unique(np.concatenate([q, x], axis=1), axis=0, return_inverse=True)
    n = q.shape[1]
    found = [max(_LOW, min(_HIGH, sum(a * b for a, b in zip(r[:n], r[n:], strict=True)))) for r in both.tolist()]
    return np.array(found, np.int64)[back.ravel()]


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.n = k, floor, np.zeros(n, np.int64)
        self.score, self.id = np.full((n, k), _LOW, np.int64), np.full((n, k), _HIGH, np.int64)

    def least(self, who: np.ndarray) -> np.ndarray:
        """What a candidate must reach, rounded down."""
        kth = np.where(self.n[who] == self.k, self.score[who, -1], _LOW)
        least = np.maximum(kth, self.floor[who])
        rounded = least.astype(float)
        return np.where(least == _LOW, -np.inf, rounded - np.abs(rounded) * 2.0**-52)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        who, at = np.unique(query, return_inverse=True)
        row, col = np.nonzero(np.arange(self.k) < self.n[who, None])
        at, score, ids = np.concatenate([at.ravel(), row]), np.concatenate([score, self.score[who[row], col]]), np.concatenate([ids, self.id[who[row], col]])
        order = np.lexsort((ids, ~score, at))
        at, score, ids = at[order], score[order], ids[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        keep = nth < self.k
        self.score[who[at[keep]], nth[keep]], self.id[who[at[keep]], nth[keep]] = score[keep], ids[keep]
        self.n[who] = np.minimum(np.bincount(at, minlength=len(who)), self.k)


def _search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, vec ids, scores), at most k a query. floor: scores that a candidate must reach."""
    qf, xf, n = q.astype(float), x.astype(float), max(q.shape[1], 1)
    rounding = 0.0 if _largest(qf) * _largest(xf) * n < 2**53 else (n + 4) * 2.0**-52
    tree, best = BallTree(xf), _Best(len(q), k, floor)
    long, far = np.sqrt((qf * qf).sum(axis=1)), np.sqrt((xf * xf).sum(axis=1))
    reach = np.sqrt((tree.centres**2).sum(axis=1)) + tree.radii
    bound = qf @ tree.centres.T + long[:, None] * tree.radii[None, :]
    bound += long[:, None] * reach[None, :] * (1e-11 + rounding) + 1e-3

    def leaf(node: int, active: np.ndarray) -> None:
        lo, hi = tree.span[node]
        for a in range(lo, hi, 4 * LEAF):  # a ball of equal vectors may be large
            rows = tree.order[a : min(hi, a + 4 * LEAF)]
            score = qf[active] @ xf[rows].T
            off = long[active, None] * far[None, rows] * rounding
            score[q_ids[active][:, None] == ids[rows][None, :]] = -np.inf
            least = best.least(active)
            if len(rows) >= k:  # these rows alone may already set a higher mark
                least = np.maximum(least, np.partition(score - off, len(rows) - k, axis=1)[:, len(rows) - k])
            row, col = np.nonzero((score + off >= least[:, None]) & (score > -np.inf))
            if len(row):
                exact = _products(q[active[row]], x[rows[col]]) if rounding else score[row, col].astype(np.int64)
                best.add(active[row], exact, ids[rows[col]])

    def visit(node: int, active: np.ndarray) -> None:
        active = active[bound[active, node] >= best.least(active)]
        if not len(active):
            return
        if tree.child[node] is None:
            leaf(node, active)
            return
        a, b = tree.child[node]
        left = bound[active, a] >= bound[active, b]
        visit(a, active[left])
        visit(b, active)  # these bounds are tested again, with what came in meanwhile
        visit(a, active[~left])

    visit(tree.root, np.arange(len(q)))
    row, col = np.nonzero(np.arange(k) < best.n[:, None])
    return row, best.id[row, col], best.score[row, col]


def _by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: ids, vectors, and the scores that a candidate must reach."""
    v = t["v"].combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    ids, starts, flat = t["vec_id"].to_numpy(), v.offsets.to_numpy(), v.values.to_numpy()
    floors = t["least"].fill_null(_LOW).to_numpy() if "least" in t.column_names else np.full(len(ids), _LOW, np.int64)
    lengths, out = np.diff(starts), {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = (ids[at], flat[starts[at][:, None] + np.arange(n)], floors[at])
    return out


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size else 0.0


def _meet(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and shard.num_rows:
        mine, theirs = _by_length(queries), _by_length(shard)
        for n in sorted(mine.keys() & theirs.keys()):
            (q_ids, q, floor), (ids, x, _) = mine[n], theirs[n]
            row, near, score = _search(q_ids, q, floor, ids, x, k)
            found.append((q_ids[row], near, score))
    cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols), strict=True)))


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best a query, with ranks."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of greatest inner product for each query. Both: (vec_id, v array<long>)."""
    spark = candidates.sparkSession
    candidates, queries = materialise(candidates), materialise(queries)
    n, m, cores = candidates.count(), queries.count(), max(spark.sparkContext.defaultParallelism, 1)
    shards = math.ceil(n / min(MOST_ROWS, max(LEAST_ROWS, n // (2 * cores)))) if n else 1
    blocks = max(1, math.ceil(m / MOST_ROWS))
    place = lambda parts: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")  # noqa: E731  by row: both are materialised
    dealt = candidates.select(place(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    asked = queries.select(place(blocks).alias("block"), "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _meet(left, right, k)

    def round_(of: DataFrame, low: int, high: int) -> DataFrame:
        to = of.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high))))
        theirs = dealt.where(F.col("shard").between(low, high))
        to, theirs = to.toDF(*to.columns), theirs.toDF(*theirs.columns)  # both may come from one table
        return to.groupBy("shard", "block").cogroup(theirs.groupBy("shard", "block")).applyInArrow(meet, _RESULT)

    low, size, found = 0, max(1, min(cores // blocks, shards // 4)), None
    while low < shards:
        to, high = asked, min(shards, low + size)
        if found is not None:
            kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            to = asked.join(kth.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
        new = round_(to, low, high - 1)
        found = _best(new if found is None else found.unionAll(new), k)
        if high < shards:
            found = materialise(found.select("query_id", "vec_id", "score"))
        low, size = high, 4 * size
    return found.select("query_id", "rank", "vec_id", "score")


def top_of_every(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The stated query set: rows whose id is divisible by `every`, against all rows."""
    rows = quantised(vectors)
    return search(rows.where(F.col("vec_id") % every == 0), rows, k)


ORACLE = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {EVERY} = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= {K}"""
