"""Operator 8: mixing sources to target weights by the cube method.

A source's target over its size gives every one of its documents whole copies and a fraction of one more. The fractions
are inclusion probabilities; the flight phase moves them, a few documents at a time, through the null space of the
constraints (sum of ones, sum of sizes), so that the number of documents and of words taken stay as they are while
documents become certain. Blocks of documents of one source fly by themselves; the at most two documents each leaves
undecided meet in blocks of the next level, until one block a source is left. There HELD documents wait for the
others to fly; these few are the landing problem, solved by trying all their subsets for the words nearest to what is
expected. Every draw comes from a hash of ids and texts, so reruns agree and rows that share an id or have none spread
over blocks. Equal rows are counted before any shuffle and spread SHARE at a time, however many there are.

Targets are found without the driver, however many sources there are: one scan numbers the sources, one orders them by the words a
unit of weight may take until the cap stops it and sums caps and weights up to each, and the first source at which the rest of the
words, dealt by the rest of the weight, stays under the cap tells the unit.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source, the last; sources without
words have target 0; ids may be null or repeated, every row is a document of its own; an empty table gives an empty result.
choose() ignores other columns; mix() tells rows apart by all columns, and of equal rows it does not matter which is copied.
"""

from __future__ import annotations

import math
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, map_arrow, materialise, utf8
from factloom.operators.scans import numbered, running
from factloom.session import scratch_table

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Documents of one flight, and undecided blocks that meet on the next level.
BLOCK, FAN = 2048, 512
#: Documents kept back for the landing; with the two a flight leaves, 4096 subsets.
HELD = 10
#: Equal rows that share a block, and copies of one row that a task writes.
SHARE, WRITTEN = 256, 4096
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes (source, size long, one row a source) with sid, its number from 0, and target: shares of the total by weight, none
    above `most` times its size; the excess is shared anew, which ends where all that are not capped get one share a weight."""
    last = F.col("source").isNull()
    rows = numbered(sizes.withColumn("_null", last), [], ["_null", "source"], "sid").withColumn("sid", F.col("sid") - 1).drop("_null")
    rows = rows.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_stop", F.col("size") / F.col("_w"))
    scaled = 1_000_000  # weights are summed in millionths, so that sums do not depend on their order
    rows = running(rows, [], [F.col("_stop"), F.col("sid")], _sizes=F.col("size"), _weights=F.round(F.col("_w") * scaled))
    total = rows.agg(F.sum("size").alias("_all"), F.sum(F.round(F.col("_w") * scaled).cast("long")).alias("_weight"))
    rows = rows.join(F.broadcast(total))  # one row
    rest = (F.col("_all") - most * (F.col("_sizes") - F.col("size"))) / ((F.col("_weight") - F.col("_weights") + F.round(F.col("_w") * scaled)) / scaled)
    unit = rows.where(rest <= most * F.col("_stop")).agg(F.min_by(rest, F.struct("_stop", "sid")).alias("_unit"))
    share = F.coalesce(F.col("_unit") * F.col("_w"), most * F.col("size"))
    return rows.join(F.broadcast(unit)).select("sid", "source", "size", F.least(share, most * F.col("size")).alias("target"))  # one row


def fly(p: list[float], size: list[int], rng: Random, held: int = 0) -> None:
    """Flight phase on p, in place: but for the first `held` undecided entries, at most two end up neither 0 nor 1, and sum(p)
    and sum(p * size) are as before."""
    window: list[int] = []
    for k in range(len(p)):
        if not _EPS < p[k] < 1 - _EPS:
            p[k] = float(p[k] > 0.5)
            continue
        if held:
            held -= 1
            continue
        window.append(k)
        if len(window) < 3:
            continue
        a, b, c = window
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        _step(p, window, u if any(u) else (1, -1, 0), rng)
        window = [w for w in window if _EPS < p[w] < 1 - _EPS]
    if len(window) == 2 and size[window[0]] == size[window[1]]:
        _step(p, window, (1, -1), rng)


def _step(p: list[float], window: list[int], u: tuple[float, ...], rng: Random) -> None:
    """Along u or against it, as far as all stay in [0, 1], with the odds that keep every expectation."""
    forth = min((1 - p[w]) / x if x > 0 else p[w] / -x for w, x in zip(window, u, strict=True) if x)
    back = min(p[w] / x if x > 0 else (1 - p[w]) / -x for w, x in zip(window, u, strict=True) if x)
    by = forth if rng.random() * (forth + back) < back else -back
    for w, x in zip(window, u, strict=True):
        q = p[w] + by * x
        p[w] = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q


def land(p: list[float], size: list[int]) -> None:
    """Landing phase: of all subsets of the undecided the one whose words, then whose number, are nearest to the expected."""
    open_ = [k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS]
    subsets = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    q, n = np.array([p[k] for k in open_]), np.array([size[k] for k in open_], float)
    off_words, off_number = np.abs(subsets @ n - q @ n), np.abs(subsets.sum(axis=1) - q.sum())
    best = subsets[np.lexsort((off_number, np.round(off_words, 6)))[0]]
    for k, x in zip(open_, best.tolist(), strict=True):
        p[k] = float(x)


_FLIGHT = "sid long, blocks long, block long, h long, doc_id long, size long, mark long, mark2 long, rest long, n long, p double"


def _fly_groups(rows: DataFrame, level: int) -> DataFrame:
    """One flight for each (sid, block), each row as often as its n says; sources of one block also land."""

    def run(group: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("h", "doc_id", "size", "mark", "mark2", "rest")]
        group = group.combine_chunks().sort_by(order)
        group = group.take(pa.array(np.repeat(np.arange(group.num_rows), group["n"].to_numpy())))
        sid, block, last = group["sid"][0].as_py(), group["block"][0].as_py(), group["blocks"][0].as_py() == 1
        p, size = group["p"].to_pylist(), group["size"].to_pylist()
        rng = Random(((sid * 1_000_003 + block) * 64 + level) & (2**63 - 1))
        fly(p, size, rng, HELD if last else 0)
        if last:
            land(p, size)
        done = {"p": pa.array(p, pa.float64()), "n": pa.array(np.ones(len(p), np.int64))}
        return pa.table({c: done.get(c, group[c]) for c in group.column_names})

    return rows.groupBy("sid", "block").applyInArrow(run, _FLIGHT)


def _decided(docs: DataFrame, rest: Column, weights: tuple[float, ...], most: float) -> DataFrame:
    """(doc_id, size, source_size, target, copies, mark, mark2, rest): one row for each document. The marks are hashes of its
    text; rest tells apart rows of one id, source and text."""
    spark = docs.sparkSession

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.array([len(t.split()) for t in utf8(batch.column(2))], np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *batch.columns[3:]], ["doc_id", "source", "size", "mark", "mark2", "rest"])

    mark, mark2 = _marks()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", mark.alias("mark"), mark2.alias("mark2"), rest.alias("rest"))
    sized = map_arrow(rows, measure, "doc_id long, source string, size long, mark long, mark2 long, rest long")
    sized = materialise(sized.groupBy("doc_id", "source", "size", "mark", "mark2", "rest").agg(F.count("*").alias("n")))
    totals = scratch_table(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")), "totals")
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    whole = F.floor(ratio + _EPS).cast("int")
    plan = targets(totals.select("source", "size"), weights, most).join(totals.select(F.col("source").alias("of"), "n"), F.col("source").eqNullSafe(F.col("of")))
    plan = plan.select("sid", "of", F.col("size").alias("source_size"), "target", F.ceil(F.col("n") / BLOCK).alias("blocks"), whole.alias("whole"), F.greatest(F.lit(0.0), ratio - whole).alias("part"))
    plan = scratch_table(plan, "plan")  # one row a source; whether it is broadcast is the optimizer's to say, by its size
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
    rows = _numbered(rows)
    few = F.least(F.lit(SHARE).cast("long"), F.col("n") - F.col("nth") * SHARE)
    h = lambda seed: F.xxhash64("doc_id", "mark", "nth", "salt", F.lit(seed))
    rows = rows.select("sid", "blocks", F.pmod(h(8), F.col("blocks")).cast("long").alias("block"), h(1).alias("h"), "doc_id", "size", "mark", "mark2", "rest", few.alias("n"), F.col("part").alias("p"))
    level, decided, most_blocks = 0, [], plan.agg(F.max("blocks")).first()[0] or 1
    left = rows
    while True:
        flown = materialise(_fly_groups(left, level))
        decided.append(flown.where("p in (0, 1)"))
        if most_blocks == 1:
            break
        left = flown.where("p not in (0, 1)").withColumns({"block": F.floor(F.col("block") / F.lit(FAN)), "blocks": F.ceil(F.col("blocks") / F.lit(FAN))})
        most_blocks, level = math.ceil(most_blocks / FAN), level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionAll(more)
    out = out.join(plan.select("sid", "source_size", "target", "whole"), "sid")
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"), "mark", "mark2", "rest")


def _marks() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.xxhash64(F.lit(1), "text")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with nth and salt, which spread what shares an id, source and text: equal rows SHARE at a time, and of very many that
    differ elsewhere as many together."""
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SHARE))))
    key = ["sid", "doc_id", "mark", "mark2"]
    hot = rows.where(F.col("rest") != 0).groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > SHARE)
    hot = materialise(hot.select(*(F.col(c).alias(f"hot_{c}") for c in key), F.ceil(F.col("rows") / SHARE).alias("parts")))
    if hot.isEmpty():
        return rows.withColumn("salt", F.lit(0).cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in key]
    return rows.join(hot, same, "left").withColumn("salt", F.coalesce(F.pmod("rest", "parts"), F.lit(0).cast("long")))


def choose(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row for each document: its size, its source's size and target, the copies and the words taken."""
    rows = _decided(docs, F.lit(0).cast("long"), weights, most)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """docs as the mix takes them: each row as many times as it has copies. Equal rows meet as one before any shuffle and are
    written as often as all of them are taken."""
    columns = [F.col(f"`{c}`").cast("string") if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]  # maps have no hash
    rest = F.xxhash64(*columns)
    times, part, *marks = (fresh(name, docs) for name in ("n_copies", "nth_copy", "text_mark", "text_mark2", "row_mark"))
    named = [F.col(c).alias(n) for c, n in zip(("mark", "mark2", "rest"), marks, strict=True)]
    taken = materialise(_decided(docs, rest, weights, most).groupBy(*named).agg(F.sum("copies").alias(times)).where(F.col(times) > 0))
    one_of_each = docs.withColumns(dict(zip(marks, (*_marks(), rest), strict=True))).dropDuplicates(marks).join(taken, marks)

    def written(rows: DataFrame, n: Column) -> DataFrame:
        return rows.withColumn(part, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*(f"`{c}`" for c in docs.columns))

    if taken.where(F.col(times) > WRITTEN).isEmpty():
        return written(one_of_each, F.col(times))
    many = one_of_each.where(F.col(times) > WRITTEN).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / WRITTEN))))
    many = many.repartition(F.col(marks[2]), F.col(part))
    few = written(one_of_each.where(F.col(times) <= WRITTEN), F.col(times))
    return few.unionAll(written(many, F.least(F.lit(WRITTEN).cast("long"), F.col(times) - F.col(part) * WRITTEN)))
