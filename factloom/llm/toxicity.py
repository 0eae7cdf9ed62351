"""Operator 2: toxicity by nearest labelled examples.

Terms are whole words (letters and digits, lower-cased) and, as further terms of BEGINNING times their weight, the words' first four
characters, so that inflected forms are alike too. A text is its TF-IDF vector over all terms of the examples: term frequency times
ln(examples / examples with the term), unit length. A block-max inverted index over the examples gives the exact k nearest by
cosine: rare terms are added up first, blocks are then visited by falling upper bound, a few and then twice as many at a time, the kth
score being raised in between, until no block can reach it; ties go to the smaller doc_id. Votes weighted by similarity, carried to a probability by a
logistic fit on leave-one-out votes, give the score; the nearest examples are the evidence. Labels decide votes and
calibration only, never terms or weights. Examples are a bounded sample (`max_examples`) of the labelled rows in the learning
folds; labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts, and texts that share no term with any example, have no neighbours and are scored as a
vote of 0; a null doc_id is not held out; repeated rows each get a row; other columns are ignored; without learning rows of
both classes every score is the share of class 1 (0.0 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.calibration import logistic
from factloom.llm.common import fold, label_sample, map_arrow, materialise, utf8

FOLDS, HELD_OUT, CUT = 3, 1, 0.7
BEGINNING, LENGTH = 5, 4
BLOCK, FIRST, TOGETHER, DENSE = 128, 8, 128, 16
#: Texts and examples whose cosines are worked out at once.
PAIRS = 4096
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, similarity array<double>"
_WORD = re.compile(r"[^\W_]+")
#: Latin-1 with a space in place of what no word has.
_LATIN = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def terms_of(text: str) -> dict[str, int]:
    """How often each term occurs: words, and the beginnings of words after a mark, which no word has."""
    words = Counter(words_of(text))
    out = dict(words)
    for w, n in words.items():
        begin = "^" + w[:LENGTH]
        out[begin] = out.get(begin, 0) + BEGINNING * n
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All of lo[0]:hi[0], lo[1]:hi[1], ... in one array."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)


def _alike(terms: list[np.ndarray], n_terms: int, block: int, among: int = 512, steps: int = 8) -> np.ndarray:
    """An order in which like examples follow one another: halved, down to a block, along the direction in which the `among` most
    frequent terms vary most. Any order gives the same results, a good one tighter bounds."""
    flat = np.concatenate(terms or [np.zeros(0, np.int64)])
    frequent = np.argsort(-np.bincount(flat, minlength=n_terms), kind="stable")[:among]
    place = np.full(n_terms, -1)
    place[frequent] = np.arange(len(frequent))
    has = np.zeros((len(terms), max(len(frequent), 1)), np.float32)
    at = place[flat]
    has[np.repeat(np.arange(len(terms)), [len(t) for t in terms])[at >= 0], at[at >= 0]] = 1
    out, work = [], [np.arange(len(terms))]
    while work:
        rows = work.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        x = has[rows] - has[rows].mean(axis=0)
        v = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(steps):
            v = x.T @ (x @ v)
            v /= max(float(np.sqrt(v @ v)), 1e-9)
        by = rows[np.argsort(x @ v, kind="stable")]
        half = -(-len(by) // (2 * block)) * block  # whole blocks, so that none holds parts of two halves
        work += [by[half:], by[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _placed(term: np.ndarray, sizes: np.ndarray, n_terms: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the examples, that of their terms by (term, place), and these places. term: the terms of all examples."""
    order = _alike(np.split(term, np.cumsum(sizes)[:-1]), n_terms, block)
    place = np.empty(len(sizes), np.int64)
    place[order] = np.arange(len(sizes))
    at = np.repeat(place, sizes)
    by = np.lexsort((at, term))
    return order, by, at[by]


def _small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x


class Vectors:
    """Texts to unit vectors over the terms of the examples."""

    def __init__(self, terms: list[str], df: np.ndarray, n: int):
        self.idf = np.log(n / df)
        self.words, self.begins = ({t[at:]: k for k, t in enumerate(terms) if t.startswith("^") == at} for at in (0, 1))

    def unit(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of a text, as terms_of() has them."""
        words = Counter(words_of(text))
        size, n = len(words), np.fromiter(words.values(), np.int64, len(words))
        own = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, size)
        begin = np.fromiter(map(self.begins.get, [w[:LENGTH] for w in words], repeat(-1)), np.int64, size)
        terms, n = np.concatenate([own, begin]), np.concatenate([n, BEGINNING * n])
        order = np.argsort(terms)
        terms, n = terms[order], n[order]
        first = np.flatnonzero(np.diff(terms, prepend=-1))  # terms of no example come before, as -1
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0)
        terms, n = terms[first], np.add.reduceat(n, first)
        w = n * self.idf[terms]
        keep = w > 0  # a term of every example tells nothing
        return terms[keep], np.round(w[keep] / max(np.sqrt((w * w).sum()), 1e-12), 9)


class BlockMaxIndex:
    """Postings by term and example. Terms that one example in `dense` has are kept as rows of each block's weights instead, in single
    precision, so that a product reads them for many texts, with the largest weight of each row; their exact weights lie by example.

    A text's rare terms are added up first, over all examples. A block's bound is the most that they give to one of its examples, and
    the text's frequent terms times their largest weights there. What single precision may take from a score is allowed for in all
    bounds; what may be among the k best is worked out in double precision."""

    def __init__(self, order: np.ndarray, postings: np.ndarray, at: np.ndarray, weight: np.ndarray, block: int = BLOCK, dense: int = DENSE):
        """order: the examples by place; postings: how many each term has; at, weight: their places and weights, by term and place."""
        self.block, self.n, self.order = block, len(order), order
        self.blocks = max(1, -(-self.n // block))
        often = postings * dense > self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        whole = np.repeat(often, postings)
        row, place, exact = np.repeat(self.row[often], postings[often]), at[whole].astype(np.int32), weight[whole]
        self.rows = np.zeros((self.blocks, int(often.sum()), block), np.float32)
        self.rows[place // block, row, place % block] = exact
        self.row_most = np.nextafter(self.rows.max(axis=2).T, np.float32(np.inf)).astype(float)
        self.slack = (self.rows.shape[1] + 8) * 2.0**-23 + 1e-9
        by = np.argsort(place, kind="stable")
        self.exact_row, self.exact = _small(row[by]), exact[by]
        self.exact_lo = np.append(0, np.cumsum(np.bincount(place, minlength=self.n)))
        self.lo = np.append(0, np.cumsum(np.where(often, 0, postings)))  # postings of a rare term
        self.at, self.weight = _small(at[~whole]), weight[~whole]
        self.read, self.asked = 0, 0  # blocks read, and all that could be

    @classmethod
    def of(cls, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        """The index of (terms, weights) of each example."""
        term, weight = (np.concatenate([v[j] for v in vectors]) for j in (0, 1))
        order, by, at = _placed(term, np.array([len(v[0]) for v in vectors]), n_terms, block)
        return cls(order, np.bincount(term, minlength=n_terms), at, weight[by], block)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines, exactly the k best by (cosine, smaller number); cosine 0 is no neighbour."""
        return self.nearest_of([(ids, weights)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of many."""
        out = []
        for first in range(0, len(queries), TOGETHER):
            out += self._search(queries[first : first + TOGETHER], k)
        return out

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        size, width = len(queries), self.blocks * self.block
        frequent, rare = np.zeros((size, self.rows.shape[1])), np.zeros((size, width))
        for n, (ids, w) in enumerate(queries):
            row = self.row[ids]
            frequent[n, row[row >= 0]] = w[row >= 0]
            lo, hi = self.lo[ids], self.lo[ids + 1]
            p = _ranges(lo, hi)
            rare[n] = np.bincount(self.at[p], np.repeat(w, hi - lo) * self.weight[p], width)
        bound = frequent @ self.row_most + rare.reshape(size, self.blocks, self.block).max(axis=2) + 1e-9
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        single, near = frequent.astype(np.float32), np.zeros((size, width), np.float32)
        best, done, step = np.zeros((size, k), np.float32), 0, FIRST
        open_ = np.arange(size)
        while len(open_) and done < self.blocks:
            blocks = order[open_, done : done + step]
            # bounds fall, so none after the first that can't hold one of the k best
            may = bound[open_, done : done + step] >= np.maximum(best[open_].min(axis=1, keepdims=True) - self.slack, 2e-9)
            open_, blocks, may = open_[may[:, 0]], blocks[may[:, 0]], may[may[:, 0]]
            found = np.zeros((len(open_), blocks.shape[1], self.block), np.float32)
            for b in np.unique(blocks[may]).tolist():
                of, nth = np.nonzero(may & (blocks == b))
                text, places = open_[of], slice(b * self.block, (b + 1) * self.block)
                found[of, nth] = near[text, places] = single[text] @ self.rows[b] + rare[text, places]
            self.read += int(may.sum())
            both = np.concatenate([best[open_], found.reshape(len(open_), blocks.shape[1] * self.block)], axis=1)
            best[open_] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            done, step = done + step, step * 2
        self.asked += size * self.blocks
        of, place = np.nonzero((near > 0) & (near >= best.min(axis=1, keepdims=True) - np.float32(2 * self.slack)))
        score = np.round(rare[of, place] + self._frequent(frequent, of, place), 9)
        of, place, score = (x[score >= 1e-9] for x in (of, place, score))
        example = self.order[place]
        by = np.lexsort((example, -score, of))
        ends = np.searchsorted(of, np.arange(size + 1))
        return [(example[i], score[i]) for i in (by[lo : min(hi, lo + k)] for lo, hi in zip(ends[:-1], ends[1:], strict=True))]

    def _frequent(self, frequent: np.ndarray, of: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What frequent terms give to text of[i] and the example at place[i]; a bounded number of pairs at once."""
        out = np.zeros(len(of))
        for first in range(0, len(of), PAIRS):
            part = slice(first, first + PAIRS)
            lo, hi = self.exact_lo[place[part]], self.exact_lo[place[part] + 1]
            p = _ranges(lo, hi)
            pair = np.repeat(np.arange(len(lo)), hi - lo)
            out[part] = np.bincount(pair, frequent[of[part][pair], self.exact_row[p]] * self.exact[p], len(lo))
        return out


def vote(similarity: np.ndarray, y: np.ndarray, power: int) -> float:
    w = similarity**power
    return float((w * y).sum() / w.sum()) if len(w) and w.sum() > 0 else 0.0


class Model:
    """Index of the examples, by rising doc_id; without one only the share of class 1. It travels as terms and counts, from which
    each worker makes the index."""

    def __init__(self, share: float, k: int, power: int):
        self.share, self.k, self.power, self.index, self.packed, self.cache = share, k, power, None, None, {}

    def fit(self, terms: list[str], ids: list[int], y: list[int], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """counts: terms and their numbers of each example."""
        self.ids, self.y = np.array(ids), np.array(y, float)
        term, n, sizes = np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts]), np.array([len(c[0]) for c in counts])
        df = np.bincount(term, minlength=len(terms))
        of = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        w = n * np.log(len(ids) / df)[term]
        norm = np.maximum(np.sqrt(np.bincount(of, w * w, len(ids))), 1e-12)
        keep = w > 0  # a term of every example tells nothing
        del w
        order, by, at = _placed(term[keep], np.bincount(of[keep], minlength=len(ids)), len(terms), BLOCK)
        self.packed = {"terms": "\n".join(terms), "df": _small(df), "order": _small(order), "postings": _small(np.bincount(term[keep], minlength=len(terms))), "at": _small(at), "n": _small(n[keep][by]), "norm": norm[order]}
        return self

    def _open(self) -> None:
        if self.packed:
            p = self.packed
            self.vectors = Vectors(p["terms"].split("\n"), p["df"].astype(float), len(p["order"]))
            postings, at = p["postings"].astype(np.int64), p["at"].astype(np.int64)
            weight = np.round(p["n"] * np.repeat(self.vectors.idf, postings) / p["norm"][at], 9)
            self.index = BlockMaxIndex(p["order"].astype(np.int64), postings, at, weight)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("vectors", "index", "cache")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state | {"index": None, "cache": {}})
        self._open()
        self.packed = None  # a worker needs the index only

    def left_out(self, ids: list[int], texts: list[str]) -> list[float]:
        """The vote on each example by all others."""
        votes = []
        for doc_id, (near, sim) in zip(ids, self.index.nearest_of([self.vectors.unit(t) for t in texts], self.k + 1), strict=True):
            rest = np.flatnonzero(self.ids[near] != doc_id)[: self.k]
            votes.append(vote(sim[rest], self.y[near[rest]], self.power))
        return votes

    def scores(self, texts: list[str], slope: float, shift: float) -> list[tuple[float, list[int], list[float]]]:
        """Score, nearest examples and their similarities of each text."""
        if self.index is None:
            return [(self.share, [], [])] * len(texts)
        units = [self.vectors.unit(t) for t in texts]
        keys = [(i.tobytes(), w.tobytes()) for i, w in units]
        new = {key: unit for key, unit in zip(keys, units, strict=True) if key not in self.cache}
        held = {key: self.cache[key] for key in keys if key in self.cache}
        for key, (near, sim) in zip(new, self.index.nearest_of(list(new.values()), self.k), strict=True):
            p = 1 / (1 + np.exp(-(slope * vote(sim, self.y[near], self.power) + shift)))
            held[key] = (float(p), self.ids[near[:5]].tolist(), sim[:5].tolist())
        if len(self.cache) > 500:
            self.cache.clear()
        self.cache.update(held)
        return [held[key] for key in keys]


def fit(docs: DataFrame, labels: DataFrame, *, max_examples: int = 8192, k: int = 7, power: int = 2) -> tuple[Broadcast, float, float]:
    """The model, and slope and shift of the calibration. The examples' texts go to the checkpoint folder; the driver gets their
    term counts, at most max_examples rows, and their votes; the model is broadcast once."""
    spark = docs.sparkSession
    sample = materialise(label_sample(docs, labels, "toxic", max_examples, lambda i: fold(i, FOLDS) != HELD_OUT))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms_of(t) for t in batch.column(1).to_pylist()]
        numbers = [np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in found]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array([" ".join(c) for c in found], pa.string()), pa.array(numbers, pa.binary())], ["doc_id", "y", "terms", "n"])

    rows = map_arrow(sample, count, "doc_id long, y int, terms string, n binary").toArrow().sort_by("doc_id")
    ids, y = rows["doc_id"].to_pylist(), rows["y"].to_pylist()
    model = Model(sum(y) / len(y) if y else 0.0, k, power)
    if len(set(y)) < 2:
        return spark.sparkContext.broadcast(model), 1.0, 0.0
    terms: dict[str, int] = {}
    counts = [(np.array([terms.setdefault(x, len(terms)) for x in t.as_py().split()], np.int32), np.frombuffer(n.as_py(), np.int32)) for t, n in zip(rows["terms"], rows["n"], strict=True)]
    del rows  # the counts hold what is needed
    shared = spark.sparkContext.broadcast(model.fit(list(terms), ids, y, counts))

    def left_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes = shared.value.left_out(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array(votes, pa.float64())], ["doc_id", "y", "vote"])

    votes = sorted(map_arrow(sample, left_out, "doc_id long, y int, vote double").collect(), key=lambda r: r.doc_id)
    return shared, *logistic(np.array([r.vote for r in votes]), np.array([r.y for r in votes], float), 0.05, (1.0, -1.0))


def score(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """One row for each document: score, verdict at the cut, nearest examples."""
    model, slope, shift = fit(docs, labels, **parameters)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = model.value.scores([t.decode() for t in utf8(batch.column(2))], slope, shift)
        p = np.array([r[0] for r in rows])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32)), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["doc_id", "held_out", "score", "predicted", "evidence", "similarity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return map_arrow(rows, run, SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents that the score does not reject, with all their columns."""
    model, slope, shift = fit(docs, labels, **parameters)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = model.value.scores([t.decode() for t in utf8(batch.column(at))], slope, shift)
        return batch.filter(pa.array([r[0] < CUT for r in rows], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
