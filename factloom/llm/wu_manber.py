"""Operator 13: benchmark decontamination by Wu-Manber multi-pattern search.

Texts are searched as bytes in one spelling: A-Z lower-cased, each word followed by one blank, a newline before each text. A window
of words is a pattern in the same spelling. Patterns go into classes by length, so that a short one does not shorten the steps of
the long ones. In a class of shortest length m, a table tells for each block of up to 8 bytes how far the search may move on when
the block stands at the end of the m bytes looked at: past all places at which no pattern can begin. Where it says 0, the bucket of
the block and of the pattern's first bytes names the patterns to test, and a comparison of all bytes confirms them. A batch of
texts is cut into lanes that step together.

Patterns are the distinct windows of `windows()`. They are cut by hash into shards of about SHARD_ROWS (window, item) pairs and
SHARD_BYTES bytes, each of which is broadcast for a pass of its own; the usual benchmark is one shard. A text passes whole.

Defined results: a null text has no words; an item of fewer words than a window, but not none, is one window; a null item id marks
words but is no item; items are counted once, whatever their repeats; every row of documents gets its row; other columns are
ignored; without items nothing is hit; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, prepare, utf8

WORDS = 10
SHARD_ROWS, SHARD_BYTES = 1 << 18, 32 << 20
LANE = 1024
CLASSES = (1, 8, 16, 32, 64)  # least lengths in bytes
MOST = 256  # bytes of a pattern that the tables look at
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK, _EDGE = 32, 10
_SPELLING = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else _BLANK for b in range(256))


def windows(benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """(pattern, item): the distinct windows of each item, spelt as texts are."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(f"({WORD})"), 1)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(begins, lambda i: F.concat(F.array_join(F.slice("words", i, n), " "), F.lit(" ")))).alias("pattern"))
    return rows.select("pattern", "item").distinct()


def spelt(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a newline before each and one at the end, then 8 zero bytes; and where these newlines are."""
    edges = np.cumsum([0] + [len(t) + 2 for t in texts])
    data = np.frombuffer((b"\n" + b" \n".join(texts) + b" \n").translate(_SPELLING) + bytes(8), np.uint8).copy()
    data[edges] = _EDGE
    blank = data == _BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1] & (data[:-1] != _EDGE)  # a blank stays after a word
    kept = np.add.reduceat(keep, edges, dtype=np.int64)
    return data[keep], np.cumsum(kept) - kept


class _Class:
    """The tables of the patterns of one class of lengths."""

    def __init__(self, patterns: list[bytes], numbers: np.ndarray):
        self.patterns, self.numbers = patterns, numbers
        self.m = m = min(MOST, *map(len, patterns), MOST)
        self.b = b = min(8, m)
        self.mask = np.uint64((1 << 8 * b) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns) + bytes(8), np.uint8)
        blocks = _words(heads) & self.mask
        at = np.arange(len(patterns)) * m
        self.bits = np.uint64(64 - max(12, min(22, (len(patterns) * (m - b + 1)).bit_length() + 3)))
        self.shift = np.full(1 << (64 - int(self.bits)), m - b + 1, np.uint16)
        for i in range(m - b + 1):
            np.minimum.at(self.shift, self._slot(blocks[at + i]), self.shift.dtype.type(m - b - i))
        key = _bucket(blocks[at + m - b], blocks[at])
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def search(self, data: np.ndarray, blocks: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(places, pattern numbers) of all occurrences that begin with a word. blocks: the 8 bytes at each place."""
        beyond = len(blocks) - self.m
        at, met = np.arange(0, max(beyond, 0), LANE), []
        stop = np.minimum(at + LANE, beyond)
        while len(at):
            step = self.shift[self._slot(blocks[at + (self.m - self.b)] & self.mask)]
            met.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        places = np.concatenate([np.zeros(0, np.int64), *met])
        places = places[data[places - 1] <= _BLANK]  # a blank or a newline is before a word; at 0 is a newline
        key = _bucket(blocks[places + (self.m - self.b)] & self.mask, blocks[places] & self.mask)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        found: list[tuple[int, int]] = []
        for place, a, z in zip(places[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            found += [(place, i) for i in self.order[a:z].tolist() if raw.startswith(self.patterns[i], place)]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], self.numbers[both[:, 1]]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place but the last 7 as numbers, without a copy."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def _bucket(end: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return end * np.uint64(0xC2B2AE3D27D4EB4F) ^ begin


class Patterns:
    """A shard of patterns, ready to search: numbers, their words and items."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        distinct = sorted({p for p, _ in pairs})
        number = {p: i for i, p in enumerate(distinct)}
        spelt_ = [p.encode() for p in distinct]
        self.words = np.array([p.count(b" ") for p in spelt_], np.int64)
        self.names = sorted({i for _, i in pairs if i is not None})
        name = {x: i for i, x in enumerate(self.names)}
        of = np.array(sorted((number[p], name[i]) for p, i in pairs if i is not None), np.int64).reshape(-1, 2)
        self.items, self.first = of[:, 1], np.searchsorted(of[:, 0], np.arange(len(distinct) + 1))
        lengths = np.searchsorted(np.array(CLASSES), np.array([len(p) for p in spelt_]), "right")
        self.classes = [_Class([spelt_[i] for i in at], at) for c in np.unique(lengths) for at in [np.flatnonzero(lengths == c)]]

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each text: its number of words, [begin, end) of hit words, merged, and the numbers of the items found."""
        data, edges = spelt(texts)
        n = np.add.reduceat(data == _BLANK, edges, dtype=np.int64)[:-1]
        spans, items = [np.zeros((0, 2), np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        raw, blocks = data.tobytes(), _words(data)
        hits = [c.search(data, blocks, raw) for c in self.classes]
        place, pattern = (np.concatenate([np.zeros(0, np.int64), *(h[j] for h in hits)]) for j in (0, 1))
        if not len(place):
            return n, spans, items
        order = np.argsort(place, kind="stable")
        place, pattern = place[order], pattern[order]
        text = np.searchsorted(edges, place, "right") - 1
        blanks = np.flatnonzero(data == _BLANK)
        begin = np.searchsorted(blanks, place) - np.searchsorted(blanks, edges[text])
        cuts = np.flatnonzero(np.diff(text, prepend=-1)).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(text)], strict=True):
            i = int(text[a])
            spans[i] = merged(begin[a:z], begin[a:z] + self.words[pattern[a:z]])
            items[i] = np.unique(np.concatenate([self.items[self.first[p] : self.first[p + 1]] for p in np.unique(pattern[a:z]).tolist()]))
        return n, spans, items


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint [begin, end) rows that cover the same places; begins ascend."""
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return np.stack([begin[new], reach[np.append(new[1:] - 1, len(begin) - 1)]], axis=1)


_SPANS = "array<struct<begin:long,end:long>>"
_READY: dict[str, Patterns] = {}


def _ready(name: str, pairs: Callable[[], list]) -> Patterns:
    """The tables of one shard, built once a Python worker."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Patterns(pairs())
    return _READY[name]


def _lists(spans: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros((0, 2), np.int64), *spans])
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), pairs)


def _pass(rows: DataFrame, pairs: list[tuple[str, str | None]], *, hits_only: bool) -> DataFrame:
    """One shard against all rows (doc_id, key, text); hits_only: without the rows in which nothing is found."""
    held, name = rows.sparkSession.sparkContext.broadcast(pairs), hashlib.sha256(repr(pairs).encode()).hexdigest()

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = _ready(name, lambda: held.value)
        n, spans, items = p.search(utf8(batch["text"]))
        names = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, items)]), pa.int32()), pa.array([p.names[i] for x in items for i in x.tolist()], pa.string()))
        out = pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(n), _lists(spans), names], ["doc_id", "key", "n_words", "spans", "items"])
        return out.filter(pa.array([len(s) > 0 for s in spans], pa.bool_())) if hits_only else out

    return map_arrow(rows, found, f"doc_id long, key string, n_words long, spans {_SPANS}, items array<string>")


def _tidy(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Spans that several shards gave, merged."""
    spans = []
    for s in batch["spans"].to_pylist():
        both = np.array([(x["begin"], x["end"]) for x in s], np.int64).reshape(-1, 2)
        both = both[np.argsort(both[:, 0], kind="stable")]
        spans.append(merged(both[:, 0], both[:, 1]) if len(both) else both)
    return pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], _lists(spans), batch["items"]], ["doc_id", "n_words", "spans", "items"])


def find(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): the words [begin, end) of each document that a window of the benchmark covers, and the
    items found, in the order of their ids as text. With several shards, the rows of one id and text have one result, which is
    found once a shard and put together."""
    prepare(docs.sparkSession)
    pairs = windows(benchmark, n)
    size = pairs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes")).first()
    shards = max(1, math.ceil(size.rows / shard_rows), math.ceil(size.bytes / shard_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.sha2("text", 256) if shards > 1 else F.lit("")).alias("key"), "text")
    shard = lambda i: [tuple(r) for r in pairs.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(shards)) == i).collect()]  # noqa: E731  bounded
    first = _pass(rows, shard(0), hits_only=False)
    if shards == 1:
        return first.drop("key")
    more = _pass(rows, shard(1), hits_only=True)
    for i in range(2, shards):
        more = more.unionAll(_pass(rows, shard(i), hits_only=True))
    more = more.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("spans").alias("s"), F.col("items").alias("i")).distinct()
    more = more.groupBy("d", "k").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("i")).alias("i"))
    both = first.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    plus = lambda own, other, kind: F.concat(own, F.coalesce(other, F.array().cast(kind)))
    both = both.select("doc_id", "n_words", plus("spans", "s", _SPANS).alias("spans"), F.array_sort(F.array_distinct(plus("items", "i", "array<string>"))).alias("items"))
    return map_arrow(both, _tidy, f"doc_id long, n_words long, spans {_SPANS}, items array<string>")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts of words, hit words and items of each document, and a digest of the items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    rows = find(docs, benchmark).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


_CUT = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_CUT} as w from documents),
b as (select item_id, {_CUT} as w from benchmark),
p as (select distinct item_id, least(len(w), {WORDS}) as l, array_to_string(w[s:s + {WORDS - 1}], ' ') as p from b, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) t(s) where len(w) > 0),
g as (select r, l, s, array_to_string(w[s:s + l - 1], ' ') as p from d, (select distinct l from p), unnest(range(1, len(w) - l + 2)) t(s)),
h as (select distinct r, s, l, item_id from g join p using (l, p)),
n as (select r, count(distinct s + j) as n_hit from h, unnest(range(0, l)) t(j) group by r),
i as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from h where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join n using (r) left join i using (r)"""
