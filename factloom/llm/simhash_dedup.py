"""Operator 4: SimHash near duplicates by the generalised pigeonhole.

Fingerprints: 64 majority bits over the XXH64 of 3-word shingles. Links: at most TAU differing bits. The 64 bits are split
into m parts, correlated bits together; a pair within TAU bits is within t[i] bits in some part i whenever the thresholds
t[i] (-1: part unused) add up to TAU - m + 1. Candidate counts are estimated from bit statistics of all fingerprints (and
the exact key histogram of the chosen split), and dynamic programming picks m and the thresholds of least estimated cost.
Each fingerprint is filed under its key of every used part and under the keys within t[i] bits of it; fingerprints that
share a key are compared exactly. A key with very many fingerprints is cut into blocks, every two blocks meeting in a task
of their own. Each task returns a spanning forest of the links it saw, so a group of k close fingerprints gives under k
rows a task, never all pairs. Components come from alternating star contractions over the links.

Defined results: texts without words (null, empty, blank) have fingerprint zero and link like any other; equal texts and
repeated rows share a fingerprint; a null doc_id gets its row and component but is no one's smallest id; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, map_arrow, materialise, prepare, utf8

BITS, TAU, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of one key that are compared in one task; more are cut into blocks.
BLOCK = 16384
PROBE_COST, VERIFY_COST = 1.0, 0.02
_PIECE = 1 << 15
#: Together they tell texts apart.
_HASHES = ("xxhash64(text)", "xxhash64(1, text)")


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit fingerprint: bit set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n, votes = max(len(words) - SHINGLE + 1, 1), np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _PIECE):
        size = min(_PIECE, n - at)
        h = np.fromiter((digest(next(shingles), SEED) for _ in range(size)), np.uint64, size)
        votes += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, h, h2) with fp as a signed long; h and h2 are two hashes of the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2), batch.column(3)], ["doc_id", "fp", "h", "h2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr(_HASHES[0]).alias("h"), F.expr(_HASHES[1]).alias("h2"))
    return map_arrow(rows, run, "doc_id long, fp long, h long, h2 long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of set bits, and correlation of bits, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        values = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["pos", "value"])

    prepare(nodes.sparkSession)
    rows = nodes.select("fp").mapInArrow(run, "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()  # 4,097 rows
    values = np.zeros(BITS * BITS + 1)
    for r in rows:
        values[r.pos] = r.value
    n = int(values[-1])
    both = values[:-1].reshape(BITS, BITS) / max(n, 1)
    p = np.diag(both).copy()
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, p, (both - np.outer(p, p)) / np.outer(deviation, deviation)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 8), axis=1, bitorder="little")


def split_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal width; each grows from the bit most tied to the rest by the bits most tied to it."""
    tie, free, parts = np.abs(correlation), set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        part = [max(free, key=lambda b: (round(tie[b, sorted(free)].sum(), 9), -b))]
        free.discard(part[0])
        while len(part) < width:
            b = max(free, key=lambda b: (round(tie[b, part].sum(), 9), -b))
            part.append(b)
            free.discard(b)
        parts.append(sorted(part))
    return parts


def close_shares(p: np.ndarray, part: list[int]) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, ..., TAU bits of the part, its bits taken as independent."""
    dist = np.zeros(TAU + 1)
    dist[0] = 1
    for b in part:
        differ = 2 * p[b] * (1 - p[b])
        dist[1:] = dist[1:] * (1 - differ) + dist[:-1] * differ
        dist[0] *= 1 - differ
    return np.cumsum(dist).tolist()


def allocate(n: int, widths: list[int], shares: list[list[float]]) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost by dynamic programming over the parts: (cost, thresholds that add up to TAU - m + 1)."""
    m = len(widths)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, share in zip(widths, shares, strict=True):
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, TAU + 1):
                probes = sum(math.comb(width, d) for d in range(t + 1))
                step = cost + (PROBE_COST * n * probes + VERIFY_COST * n * n / 2 * share[t] if t >= 0 else 0.0)
                if total + t not in new or step < new[total + t][0]:
                    new[total + t] = (step, [*chosen, t])
        best = new
    return best[TAU - m + 1]


def keys_of(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """The part's bits, packed into the low bits of a long."""
    key = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(part):
        key |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return key.view(np.int64)


def filed(nodes: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, key, fp): each fingerprint under its own key, and under those within the part's threshold that are greater,
    which of two different keys is enough for one of the pair to come to the other."""
    masks = [np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(len(part)), d)], np.int64) for part, t in zip(parts, thresholds, strict=True)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        out = []
        for k, part in enumerate(parts):
            if thresholds[k] < 0:
                continue
            key = keys_of(fp.view(np.uint64), part)
            for mask in masks[k]:
                probe = key ^ mask
                use = probe >= key
                out.append((np.full(int(use.sum()), k, np.int32), probe[use], fp[use]))
        cols = [np.concatenate([o[j] for o in out]) for j in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "key", "fp"])

    return map_arrow(nodes.select("fp"), run, "part int, key long, fp long")


def plan(nodes: DataFrame) -> tuple[list[list[int]], list[int]]:
    """Split and thresholds for these fingerprints."""
    n, p, correlation = bit_statistics(nodes)
    options = []
    for m in range(2, TAU + 3):
        parts = split_bits(correlation, m)
        widths = [len(x) for x in parts]
        options.append((allocate(n, widths, [close_shares(p, x) for x in parts])[0], m, parts))
    _, _, parts = min(options)
    counts = filed(nodes, parts, [0] * len(parts)).groupBy("part", "key").agg(F.count("*").alias("c"))
    exact = {r.part: r.pairs for r in counts.groupBy("part").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).collect()}
    shares = []
    for k, part in enumerate(parts):  # equal keys are counted; the rest follows the estimate
        estimate = close_shares(p, part)
        equal = exact.get(k, 0.0) / max(n, 1) ** 2
        shares.append([min(1.0, e / max(estimate[0], 1e-30) * equal) for e in estimate])
    return parts, allocate(n, [len(x) for x in parts], shares)[1]


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _search(fp: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among fp: breadth first, each fingerprint against those not reached yet."""
    left, out = np.unique(fp), []
    while len(left):
        work, left = [left[0]], left[1:]
        while work and len(left):
            x = work.pop()
            near = np.bitwise_count(left ^ x) <= TAU
            if near.any():
                found = left[near]
                left = left[~near]
                out += [(int(x), int(y)) for y in found]
                work += list(found)
    return out


def _links(group: np.ndarray, fp: np.ndarray, wide: int = 64) -> list[tuple[int, int]]:
    """Spanning forest of the links within groups; group is sorted, fp unsigned."""
    edges = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(group)]])
    out: list[tuple[int, int]] = []
    small = np.repeat(ends - starts <= wide, ends - starts)
    g, x = group[small], fp[small]
    for d in range(1, wide):
        if len(g) <= d:
            break
        same = np.flatnonzero(g[:-d] == g[d:])
        if not len(same):
            break
        near = same[np.bitwise_count(x[same] ^ x[same + d]) <= TAU]
        out += zip(x[near].tolist(), x[near + d].tolist(), strict=True)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s > wide:
            out += _search(fp[s:e])
    return _forest(iter(out))


def links(nodes: DataFrame, parts: list[list[int]], thresholds: list[int], block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b: links that span each group of close fingerprints."""
    rows = materialise(filed(nodes, parts, thresholds))
    hot = rows.groupBy("part", "key").agg(F.count("*").alias("c")).where(F.col("c") > block)
    hot = materialise(hot.select("part", "key", F.ceil(F.col("c") / F.lit(block)).cast("int").alias("blocks")))
    if hot.isEmpty():
        dealt = rows.select("part", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        mine = F.pmod(F.xxhash64("fp"), F.coalesce(F.col("blocks"), F.lit(1))).cast("int")
        dealt = rows.join(hot, ["part", "key"], "left").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        dealt = dealt.select("part", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    group = F.xxhash64("part", "key", "i", "j")  # groups that share a hash are only compared in vain
    dealt = dealt.select(group.alias("g"), "fp").repartition("g").sortWithinPartitions("g", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, x = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

        for batch in batches:
            g = np.concatenate([g, batch.column(0).to_numpy(zero_copy_only=False)])
            x = np.concatenate([x, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(g) < 32 * 1024:
                continue
            last = int(np.searchsorted(g, g[-1]))  # the last group may go on; it holds at most two blocks
            if last and (found := _links(g[:last], x[:last])):
                yield out(found)
            g, x = g[last:], x[last:]
        if len(g) and (found := _links(g, x)):
            yield out(found)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge, root being the component's smallest node: large and small stars in turn."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last or not state[0]:
            break
        last = tuple(state)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        edges = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())  # large star
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")))
        hung = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct())  # small star
    else:
        raise RuntimeError("star contractions did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, h, h2) of all documents, and (fp, root, component_id) of all fingerprints, root being the component's own."""
    prints = materialise(fingerprints(docs))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts, thresholds = plan(nodes)
    member = components(links(nodes, parts, thresholds))
    member = materialise(member.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "rep"))
    least = materialise(member.groupBy("root").agg(F.min("rep").alias("least")))
    member = materialise(member.join(least, "root").select("fp", "root", "least"))
    classes = nodes.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id"))
    return prints, materialise(classes)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: fingerprint in hex and the smallest doc_id of its component."""
    prints, classes = grouped(docs)
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id, null being the last, and of different texts
    of that id the one of the smallest hash. Of rows that repeat that id and text one stays. Documents of different components
    stay, whether or not they share an id or have none."""
    prints, classes = grouped(docs)
    names = [fresh(n, docs) for n in ("kept_id", "kept_h", "kept_h2")]
    rows = prints.groupBy("doc_id", "h", "h2").agg(F.min("fp").alias("fp"), F.count("*").alias("rows"))
    best = rows.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h", "h2", "rows")).alias("best"))
    best = best.join(classes.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = materialise(best.select(*(F.col(f"best.{c}").alias(n) for c, n in zip(("doc_id", "h", "h2"), names, strict=True)), "best.rows"))
    once, more = (kept.where(f"rows {n}").select(*names) for n in ("= 1", "> 1"))
    same = F.expr(f"cast(doc_id as long) <=> {names[0]} and {_HASHES[0]} = {names[1]} and {_HASHES[1]} = {names[2]}")
    single = docs.join(once, same, "left_semi")
    if more.isEmpty():
        return single
    return single.unionByName(docs.join(more, same, "left_semi").dropDuplicates(["doc_id", "text"]))
