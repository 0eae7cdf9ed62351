"""Exact cosine neighbours and pairs by blocks that can hold some.

Rows go to the nearest of a bounded number of pivots and, within its cell, by rising angle to rings of BLOCK rows at most. By the
triangle inequality on the sphere the angles of two rings to their pivots bound the angle between any of their rows from below; two
blocks meet only if that bound allows a cosine of the threshold. A row is copied to the blocks that its own meets, no others.

Neighbours are sought by groups of blocks, GROUP rows at most a side in a task. Cosines are first taken in single precision; what
may reach the bound and the kth found so far, by what rounding can take from it, is worked out in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.scans import numbered
from factloom.session import scratch_table, ship

#: Rows of a block; two blocks meet in one task. Pivots, and the sample that they are chosen from, farthest first.
BLOCK, PIVOTS, SAMPLE = 4096, 128, 4096
#: What rounding may take from an angle.
_SLACK = 4e-6
#: Rows of a group of blocks. Rows and columns of cosines taken at once (they fit a core's cache), columns of a run, and pairs worked
#: out at once.
GROUP, _ROWS, _COLUMNS, _RUN, _PAIRS = 65536, 256, 2048, 16, 1 << 15


def unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; zero rows stay. Vectors must have one length."""
    if not len(vectors):
        return np.zeros((0, 1))
    if pc.count_distinct(pc.list_value_length(vectors), mode="all").as_py() > 1:
        raise ValueError("vectors of several lengths")
    v = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column(t.column_names[1]).to_numpy()
    return ids, unit(t.column(t.column_names[2]))


def _usable(df: DataFrame, id_col: str, vec: str, as_id: str) -> DataFrame:
    """Rows with an id and a vector. Vectors of single precision stay so until a task works with them: half the bytes to shuffle."""
    kind = "array<float>" if df.select(vec).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    return df.select(F.col(id_col).cast("long").alias(as_id), F.col(vec).cast(kind).alias(vec)).where(F.col(as_id).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0))


def best_of_each(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k best of each row, of equals the smaller id; minus infinity is no candidate."""
    kth = np.partition(sim, max(sim.shape[1] - k, 0), axis=1)[:, max(sim.shape[1] - k, 0)]
    row, col = np.nonzero((sim >= kth[:, None]) & (sim > -np.inf))
    order = np.lexsort((ids[col], -sim[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


def exact_cosines(u: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cosines of unit rows u[row] and v[col], to nine digits; a bounded number of pairs at once."""
    parts = (slice(s, s + _PAIRS) for s in range(0, len(row), _PAIRS))
    return np.round(np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", u[row[p]], v[col[p]]) for p in parts)]), 9)


def rounding(dims: int) -> float:
    """What single precision may take from, or add to, the cosine of unit rows."""
    return (dims + 8) * 2.0**-23


def _few_copies(ids: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Places of the rows that can be among the n nearest of any: of equal rows those of the n smallest ids. ids ascend."""
    if len(np.unique(v[:, 0])) == len(v):
        return np.arange(len(v))
    _, kind = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    first = np.append(True, np.diff(kind.ravel()[order]) != 0)
    other = first | np.append(True, np.diff(ids[order]) != 0)  # a new id within its kind
    nth = np.cumsum(other)
    nth -= np.maximum.accumulate(np.where(first, nth, 0)) - 1
    return np.sort(order[nth <= n])


def nearest(p: np.ndarray, u: np.ndarray, q: np.ndarray, v: np.ndarray, k: int, above: float, exclude_equal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left id, right id, cosine): of each row of u its k of v above a bound, ties to the smaller id. Rows with a component that is
    not finite have none. Columns are taken in stretches, each as long as all before it, so that some k a row pass the kth found in
    those; what rounding allows among the k is kept in single precision, and exact cosines decide last."""
    fine, sound = (np.isfinite(x).all(axis=1) for x in (u, v))
    p, u, order = p[fine], u[fine], np.flatnonzero(sound)[np.argsort(q[sound], kind="stable")]
    q, v = q[order], v[order]
    few = _few_copies(q, v, k + 1) if len(v) else np.zeros(0, np.int64)  # one more, as a row's own id may be among them
    q, v = q[few], v[few]
    single, slack, out = v.astype(np.float32), np.float32(rounding(v.shape[1])), []
    for s in range(0, len(p) if len(q) else 0, _ROWS):
        mine, w = p[s : s + _ROWS], u[s : s + _ROWS]
        own = tuple(np.searchsorted(q, mine, side) for side in ("left", "right")) if exclude_equal else None
        least = np.full(len(mine), np.float32(above) - slack, np.float32)
        row, col, sim, at, to = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), 0, _COLUMNS
        while at < len(q):
            got = _passing(w.astype(np.float32), single, at, min(to, len(q)), least, own, k, 2 * slack)
            row, col, sim = (np.append(x, y) for x, y in zip((row, col, sim), got, strict=True))
            order = np.argsort(row * 4.0 - sim)  # by row, then by falling cosine
            row, col, sim = row[order], col[order], sim[order]
            kth = np.searchsorted(row, row) + k - 1
            kth, beyond = np.minimum(kth, len(row) - 1), kth >= len(row)
            full = (row[kth] == row) & ~beyond  # of a row that has k
            keep = ~full | (sim >= sim[kth] - 2 * slack)
            least[row[full]] = np.maximum(least[row[full]], sim[kth[full]] - 2 * slack)
            row, col, sim = row[keep], col[keep], sim[keep]
            if len(row) > 4 * k * len(mine):  # too many near one another to go on with
                row, col, exact = _first(w, v, row, col, k, above)
                sim = exact.astype(np.float32)
            at, to = to, 2 * to
        row, col, exact = _first(w, v, row, col, k, above)
        out.append((mine[row], q[col], exact))
    return tuple(np.concatenate([np.zeros(0, kind), *(o[i] for o in out)]) for i, kind in enumerate((np.int64, np.int64, float)))


def _first(u: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray, k: int, above: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the k greatest cosines above a bound of each row, ties to the first column."""
    sim = exact_cosines(u, v, row, col)
    order = np.lexsort((col, -sim, row))
    order = order[sim[order] > above]
    nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    order = order[nth < k]
    return row[order], col[order], sim[order]


def _passing(w: np.ndarray, v: np.ndarray, start: int, end: int, least: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None, k: int, slack: np.float32) -> list[np.ndarray]:
    """(row, column, cosine) in single precision of what reaches each row's least in a stretch of columns. own: the columns of each
    row's own id, which don't count. Columns are looked at by runs, first at their greatest; in the first stretch k runs have a cosine
    of at least the kth greatest of these."""
    found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    space = np.empty(len(w) * min(_COLUMNS, -(-(end - start) // _RUN) * _RUN), np.float32)
    for c in range(start, end, _COLUMNS):
        some = v[c : min(c + _COLUMNS, end)]
        runs = -(-len(some) // _RUN)  # a run's columns lie that far apart
        near = space[: len(w) * runs * _RUN].reshape(len(w), -1)
        np.matmul(w, some.T, out=near[:, : len(some)])
        near[:, len(some) :] = -np.inf
        if own is not None:
            for i in np.flatnonzero((own[0] < own[1]) & (own[1] > c) & (own[0] < c + len(some))).tolist():
                near[i, max(own[0][i] - c, 0) : own[1][i] - c] = -np.inf
        greatest = near.reshape(len(w), _RUN, runs).max(axis=1)
        if c == 0 and runs >= k:
            least = np.maximum(least, np.partition(greatest, runs - k, axis=1)[:, runs - k] - slack)
        r, run = np.divmod(np.flatnonzero(greatest >= least[:, None]), runs)  # far faster than by rows and columns
        part = near.ravel().take((r * (_RUN * runs) + run)[:, None] + np.arange(_RUN) * runs)
        n, place = np.divmod(np.flatnonzero(part >= least[r, None]), _RUN)
        found.append((r[n], c + place * runs + run[n], part[n, place]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _pivots(rows: DataFrame, vec: str) -> np.ndarray:
    """Unit vectors far from one another, of a sample by hash, and at most one for every hundred rows of it."""
    got = rows.select(vec).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    v = unit(got.column(0)) if got.num_rows else np.zeros((0, 1))
    v = v[(v != 0).any(axis=1)]
    if not len(v):
        return np.zeros((1, 1))
    chosen, near = [0], v @ v[0]
    while len(chosen) < min(PIVOTS, max(1, len(v) // 100)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    return v[chosen]


def _in_blocks(rows: DataFrame, vec: str, pivots: np.ndarray, size: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, vec) with their block (pivot, ring), and one row a block: its least and greatest angle to the pivot, and its rows."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, p = unit(pa.chunked_array([batch.column(1)])), shared.value
            near = v @ p.T if p.any() and batch.num_rows else np.zeros((batch.num_rows, 1))
            pivot = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(near)), pivot], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(angle)], ["id", vec, "pivot", "angle"])

    kind = rows.schema[vec].dataType.simpleString()
    cells = rows.select("id", vec).mapInArrow(placed, f"id long, {vec} {kind}, pivot int, angle double")
    ringed = numbered(cells, ["pivot"], ["angle", "id"], "nth").withColumn("ring", F.floor((F.col("nth") - 1) / size)).withColumn("block", F.struct("pivot", "ring"))
    blocks = ringed.groupBy("block").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    return ringed.select("block", "id", vec), blocks


def _may_meet(between: np.ndarray, lo: float, hi: float, low: np.ndarray, high: np.ndarray, least: float) -> np.ndarray:
    """Whether a block may hold a row of a cosine of at least `least` to one of each other block; between: angles of the pivots."""
    bound = np.maximum.reduce([between - hi - high, lo - between - high, low - between - hi, np.zeros(len(between))])
    return np.cos(np.maximum(bound - _SLACK, 0)) + 1e-9 >= least if least > 0 else np.ones(len(between), bool)


def _meetings(a: DataFrame, b: DataFrame, pivots: np.ndarray, least: float) -> DataFrame:
    """(x, y): the blocks of a and b that may hold rows of a cosine of at least `least`. One row a block goes to the tasks."""
    right = b.select("block.pivot", "block.ring", "low", "high").toArrow()
    context = b.sparkSession.sparkContext
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    shared = context.broadcast((apart, *(right.column(c).to_numpy() for c in ("pivot", "ring", "low", "high"))))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, pivot, ring, low, high = shared.value
        for batch in batches:
            for p, r, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("pivot", "ring", "low", "high")), strict=True):
                may = _may_meet(apart[p, pivot], lo, hi, low, high, least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(may.sum(), p, np.int32)), pa.array(np.full(may.sum(), r, np.int64)), pa.array(pivot[may]), pa.array(ring[may])], ["p", "r", "q", "s"])

    met = a.select("block.pivot", "block.ring", "low", "high").mapInArrow(pairs, "p int, r long, q int, s long")
    return met.select(F.struct(F.col("p").alias("pivot"), F.col("r").alias("ring")).alias("x"), F.struct(F.col("q").alias("pivot"), F.col("s").alias("ring")).alias("y"))


def _block_size(n: int, cores: int) -> int:
    return min(BLOCK, max(256, n // cores))


def _grouped(blocks: DataFrame, n: int, cores: int) -> pa.Table:
    """One row a block: pivot, ring, low, high, number, and its group of blocks one after another, enough groups for all cores."""
    t = blocks.select("block.pivot", "block.ring", "low", "high", "n").toArrow().sort_by([("pivot", "ascending"), ("ring", "ascending")])
    rows = min(GROUP, max(256, -(-n // int(np.ceil(np.sqrt(3 * cores))))))
    size = t["n"].to_numpy()
    group = ((np.cumsum(size) - size) // rows).astype(np.int32)
    return t.drop_columns("n").append_column("number", pa.array(np.arange(len(t)), pa.int32())).append_column("of", pa.array(group, pa.int32()))


def _dealt(rows: DataFrame, mine: pa.Table, theirs: pa.Table, apart: np.ndarray, least: float, names: tuple[str, str]) -> DataFrame:
    """rows, once for each group of the other side that holds a block which theirs meets."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((apart, *(theirs[c].to_numpy() for c in ("pivot", "low", "high", "of"))))  # one row a block

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, pivot, low, high, of = shared.value
        for batch in batches:
            for p, r, lo, hi, number, group in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                to = np.unique(of[_may_meet(apart[p, pivot], lo, hi, low, high, least)])
                each = lambda x, kind: pa.array(np.full(len(to), x), kind)
                yield pa.RecordBatch.from_arrays([each(p, pa.int32()), each(r, pa.int64()), each(number, pa.int32()), each(group, pa.int32()), pa.array(to, pa.int32())], ["p", "r", "number", *names])

    blocks = spark.createDataFrame(mine.to_pandas(), "pivot int, ring long, low double, high double, number int, of int")
    to = scratch_table(blocks.mapInArrow(deal, f"p int, r long, number int, {names[0]} int, {names[1]} int"), "deals")
    return rows.join(to, (rows["block"]["pivot"] == to["p"]) & (rows["block"]["ring"] == to["r"])).drop("block", "p", "r")


def knn_join(left: DataFrame, right: DataFrame, k: int, above: float, *, left_id: str = "vec_id", right_id: str = "vec_id", vec: str = "embedding", exclude_equal: bool = True) -> DataFrame:
    """(left_id, right_id, sim, rank): for each left row its k right rows of greatest cosine above a bound; ties to the smaller
    id. A task holds a group of blocks of either side and returns only k a left row. Vectors must have one length."""
    (a, of_a, n_a), (b, of_b, n_b), pivots = _both(left, right, left_id, right_id, vec)
    context = left.sparkSession.sparkContext
    cores, apart = context.defaultParallelism, np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    ours, theirs = _grouped(of_a, n_a, cores), _grouped(of_b, n_b, cores)
    x, y = _dealt(a, ours, theirs, apart, above, ("g", "h")), _dealt(b, theirs, ours, apart, above, ("h", "g"))
    shared = context.broadcast((apart, *([t[c].to_numpy() for c in ("pivot", "low", "high")] for t in (ours, theirs))))  # one row a block

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        apart, (pivot, low, high), (to, near, far) = shared.value
        found: list = []
        if x.num_rows and y.num_rows:
            p, u, q, v, own, other = x["id"].to_numpy(), unit(x[vec]), y["id"].to_numpy(), unit(y[vec]), x["number"].to_numpy(), y["number"].to_numpy()
            blocks, alike = np.unique(other), {}
            for i in np.unique(own).tolist():  # blocks that meet the same blocks go together
                may = blocks[_may_meet(apart[pivot[i], to[blocks]], low[i], high[i], near[blocks], far[blocks], above)]
                alike.setdefault(may.tobytes(), (may, []))[1].append(i)
            for may, mine in alike.values():
                a, b = np.isin(own, mine), np.isin(other, may)
                found.append(nearest(p[a], u[a], q[b], v[b], k, above, exclude_equal))
        cols = [np.concatenate([np.zeros(0, kind), *(f[j] for f in found)]) for j, kind in enumerate((np.int64, np.int64, float))]
        return pa.table({"left_id": cols[0], "right_id": cols[1], "sim": cols[2]})

    tasks = (ours["of"].to_numpy().max(initial=0) + 1) * (theirs["of"].to_numpy().max(initial=0) + 1)  # as many as meetings: the longest ends little after the mean
    x, y = (t.repartition(int(tasks), "g", "h") for t in (x, y))
    met = x.groupBy("g", "h").cogroup(y.groupBy("g", "h")).applyInArrow(meet, "left_id long, right_id long, sim double")
    order = Window.partitionBy("left_id").orderBy(F.desc("sim"), "right_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _both(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vec: str) -> tuple[tuple, tuple, np.ndarray]:
    """Of either side its rows (block, id, vec), its blocks and the number of its rows; and the pivots."""
    spark = left.sparkSession
    ship(spark)
    a, b = _usable(left, left_id, vec, "id"), _usable(right, right_id, vec, "id")
    pivots = _pivots(b, vec)
    counts = [t.count() for t in (a, b)]
    of_a, of_b = ((*_in_blocks(t, vec, pivots, _block_size(n, spark.sparkContext.defaultParallelism)), n) for t, n in zip((a, b), counts, strict=True))
    return of_a, of_b, pivots


def meeting_blocks(left: DataFrame, right: DataFrame, least: float, *, left_id: str = "vec_id", right_id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides' rows (block, id, vec), and the pairs (x, y) of their blocks that meet."""
    (a, of_a, _), (b, of_b, _), pivots = _both(left, right, left_id, right_id, vec)
    return a, b, scratch_table(_meetings(of_a, of_b, pivots, least), "meetings")


def pair_edges(rows: DataFrame, least: float, *, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(src, dst, sim) with src < dst and cosine of at least a bound, every two blocks that may hold one meeting once."""
    spark = rows.sparkSession
    ship(spark)
    r = _usable(rows, id_col, vec, "id")
    pivots = _pivots(r, vec)
    placed, blocks = _in_blocks(r, vec, pivots, _block_size(r.count(), spark.sparkContext.defaultParallelism))
    met = scratch_table(_meetings(blocks, blocks, pivots, least).where("x <= y"), "meetings")
    sides = met.select(F.col("x").alias("block"), F.struct("x", "y").alias("at")).unionAll(met.where("x <> y").select("y", F.struct("x", "y")))
    dealt = placed.join(sides, "block").select("at", "id", vec, "block")

    def within(t: pa.Table) -> pa.Table:
        at = t["at"][0].as_py()
        ids, v = _unit(t)
        block = np.array([b == at["x"] for b in t["block"].to_pylist()])
        first, second = np.flatnonzero(block), np.flatnonzero(~block) if at["x"] != at["y"] else np.arange(len(ids))
        found = []
        for s in range(0, len(first), 1024):
            sim = np.round(v[first[s : s + 1024]] @ v[second].T, 9)
            x, y = np.nonzero(sim >= least)
            p, q = ids[first[s : s + 1024]][x], ids[second][y]
            keep = p < q if at["x"] == at["y"] else p != q
            found.append((np.minimum(p, q)[keep], np.maximum(p, q)[keep], sim[x, y][keep]))
        cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, (np.int64, np.int64, float)[j]) for j in range(3)]
        return pa.table({"src": cols[0], "dst": cols[1], "sim": cols[2]})

    return dealt.groupBy("at").applyInArrow(within, "src long, dst long, sim double")


def centroids(rows: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """(key, centroid): component-wise mean, by partial aggregation of (key, place)."""
    flat = rows.select(key, F.posexplode(vec).alias("place", "x"))
    means = flat.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda s: s["m"]).alias("centroid"))


def first_segments(segments: DataFrame, n: int = 3, *, positions_only: bool = False) -> DataFrame:
    """The segments that stand for a document: the first n with a vector, or those of position under n."""
    if positions_only:
        return segments.where((F.col("position_index") < n) & F.col("embedding").isNotNull())
    order = Window.partitionBy("document_id").orderBy("position_index")
    return segments.where(F.col("embedding").isNotNull()).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")
