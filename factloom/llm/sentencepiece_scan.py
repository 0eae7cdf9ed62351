"""Operator 6: SentencePiece (BPE) encoding and decoding of texts of any length.

A sequence of pieces is the encoding of a text exactly if every two neighbours are the encoding of their own concatenation:
merges never cross a border between final pieces, and on both sides of it they come in the same order as alone. So the
encoding is the one path of weight 0 through a lattice whose steps weigh 0 (neighbours fit) or minus infinity (they don't):
a max-plus product. Giant texts are cut into chunks. A boundary's states are the pieces that may lie across it. For each
chunk, on its own, the transfer matrix says which state at its start can lead to which at its end. The product of matrices is
associative: FAN neighbours are multiplied in a task, their products again, up a tree, and down the tree every boundary gets
its one state; then each chunk is traced back by itself.

No piece has a space after another character, so a space after a letter is a sure border. Where a chunk has such borders,
its matrix is the product of a column (states that fit before the first) and a row (states that follow the last), and what
lies between is encoded with the library; only head and tail, or chunks without spaces, walk the lattice.

Decoding joins the pieces' bytes and drops the leading space that encoding adds.

Defined results: null and empty texts have no tokens; repeated rows each get a row; a null doc_id stays null; other columns
are ignored; round_trip says whether decoding gives the text back (U+2581 in a text comes back as a space: false).

The model's path is a parameter or the session's spark.factloom.tokenizer; the driver ships the file to the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, materialise, prepare, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16384
#: Matrices that are multiplied in one task.
FAN = 64
SPACE = "▁"
_LOADED: dict[str, Pieces] = {}


class Pieces:
    """One model: encoding by the library, and the lattice of pieces."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(self.sp.vocab_size()) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in ordinary}
        self.rank = {piece: self.sp.get_score(i) for piece, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with inner spaces: spaces are no sure borders in this model")
        self.raw = [b"" if self.sp.is_control(i) or self.sp.is_unknown(i) else bytes([int(self.sp.id_to_piece(i)[3:5], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).encode() for i in range(self.sp.vocab_size())]
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pairs: dict[tuple[str | None, str], bool] = {}

    def encode(self, text: str) -> list[int]:
        """Token ids of a text that starts where a sure border is; the encoder's own leading space is not in it."""
        return self.sp.encode(text, num_threads=1)

    def decode(self, ids: list[int]) -> str:
        """The text of whole encodings; bytes that are no UTF-8 become U+FFFD."""
        return self.spelled(ids).decode("utf-8", "replace").replace(SPACE, " ")[1:]

    def spelled(self, ids: list[int]) -> bytes:
        """The pieces' bytes, spaces still marked."""
        return b"".join(map(self.raw.__getitem__, ids))

    def merged(self, s: str) -> list[str]:
        """Encoding of a short string: the best-ranked neighbours merge first, of equals the leftmost."""
        parts = list(s)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda k: (self.rank.get(parts[k] + parts[k + 1], -np.inf), -k))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, left: str | None, right: str) -> bool:
        """Whether right may follow left (None: a sure border)."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 100_000:
                self.pairs.clear()
            found = self.pairs[key] = self.merged((left or "") + right) == ([left, right] if left is not None else [right])
        return found

    def starting(self, text: str, at: int) -> Iterator[str]:
        """Pieces that may start at a place: those of the vocabulary, or a character that it lacks."""
        if text[at] not in self.ids:
            yield text[at]
        for n in range(1, min(self.longest, len(text) - at) + 1):
            if text[at : at + n] in self.ids:
                yield text[at : at + n]

    def across(self, text: str, border: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that may hold the character before the border."""
        return [(s, s + len(v)) for s in range(max(0, border - self.longest), border) for v in self.starting(text, s) if s + len(v) >= border and self.fits(None, v)]

    def walk(self, text: str, origins: list[tuple[int, int] | None], at: int, stop: int, trace: bool = False) -> tuple[dict[tuple[int, int], int], dict]:
        """From origins (a piece's (start, end), or None for a sure border at `at`) to all pieces that reach `stop`: which
        origins, as bits, lead to each, and with trace each piece's forerunner."""
        nodes: dict[int, dict[tuple[int, int] | None, int]] = {}
        for bit, o in enumerate(origins):
            nodes.setdefault(at if o is None else o[1], {})[o] = 1 << bit
        done: dict[tuple[int, int], int] = {o: m for end, here in nodes.items() if end >= stop for o, m in here.items() if o is not None}
        before: dict = {}
        for p in range(min(nodes, default=stop), stop):
            here = nodes.pop(p, None)
            if not here:
                continue
            for v in self.starting(text, p):
                bits = 0
                for u, m in here.items():
                    if self.fits(None if u is None else text[u[0] : u[1]], v):
                        bits |= m
                        if trace:
                            before[(p, p + len(v))] = u
                if bits:
                    to = done if p + len(v) >= stop else nodes.setdefault(p + len(v), {})
                    to[(p, p + len(v))] = to.get((p, p + len(v)), 0) | bits
        return done, before

    def borders(self, text: str, start: int, stop: int) -> tuple[int, int] | None:
        """First and last sure border in [start, stop]."""
        first = next((k for k in range(max(start, 1), stop + 1) if k < len(text) and text[k] == SPACE and text[k - 1] != SPACE), None)
        if first is None:
            return None
        last = next(k for k in range(min(stop, len(text) - 1), first - 1, -1) if text[k] == SPACE and text[k - 1] != SPACE)
        return first, last

    def transfer(self, text: str, start: int, stop: int, first: bool, final: bool) -> list[tuple[int, int]]:
        """Pairs (state at start, state at stop) of weight 0; see code(). text holds the chunk [start, stop) and what may lie across its ends."""
        ins = [None] if first else self.across(text, start)
        sure = self.borders(text, start, stop)
        at_end = {stop: "end"} if final else {}
        if sure is None:
            done, _ = self.walk(text, ins, start, stop)
            return [(code(o, start), code(e, stop)) for e, bits in done.items() if not at_end or e[1] == stop for b, o in enumerate(ins) if bits >> b & 1]
        if sure[0] == start:
            heads = [EDGE]
        else:
            done, _ = self.walk(text, ins, start, sure[0])
            heads = [code(o, start) for b, o in enumerate(ins) if any(e[1] == sure[0] and bits >> b & 1 for e, bits in done.items())]
        done, _ = self.walk(text, [None], sure[1], stop)
        tails = [code(e, stop) for e in done if not at_end or e[1] == stop] if sure[1] < stop else [EDGE]
        return [(h, t) for h in heads for t in tails]

    def back(self, text: str, start: int, stop: int, into: int, out: int) -> tuple[list[int], bool]:
        """Token ids between two known states, and whether they decode to what they stand for."""
        begin = start if into in (0, EDGE) else start + into % 64
        end = stop if out == EDGE else stop + out % 64
        origin = None if into in (0, EDGE) else (start - into // 64, begin)
        sure = self.borders(text, start, stop)
        ids: list[int] = []

        def path(o: tuple[int, int] | None, at: int, to: tuple[int, int] | int) -> list[int]:
            goal = to if isinstance(to, int) else to[1]
            done, before = self.walk(text, [o], at, goal if isinstance(to, int) else stop, trace=True)
            node = next(e for e in done if (e[1] == goal if isinstance(to, int) else e == to)) if goal > at else o
            parts = []
            while node != o:
                parts.append(text[node[0] : node[1]])
                node = before[node]
            return [i for piece in reversed(parts) for i in ([self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()])]

        last = (stop - out // 64, end) if out != EDGE else stop
        if sure is None:
            ids = path(origin, begin, last)
        else:
            if sure[0] > begin:
                ids = path(origin, begin, sure[0])
            if sure[1] > sure[0]:
                ids += self.encode(text[sure[0] + 1 : sure[1]].replace(SPACE, " "))
            if sure[1] < end:
                ids += path(None, sure[1], last)
        return ids, self.spelled(ids) == text[begin:end].encode()


#: State of a boundary that is known to be the edge of a piece.
EDGE = 1 << 20


def code(state: tuple[int, int] | None, border: int) -> int:
    """A state: how far the piece starts before the border and ends after it. A piece that ends at a sure border is any: EDGE
    is its state only where the border itself is sure; 0 is the text's start."""
    return 0 if state is None else (border - state[0]) * 64 + state[1] - border


def pieces(path: str = MODEL) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def shipped(spark: SparkSession, path: str | None) -> str:
    """The name under which executors find the model's file."""
    path = path or spark.conf.get("spark.factloom.tokenizer", MODEL)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _window(text: str, k: int, chunk: int, reach: int) -> tuple[str, int, int]:
    """Chunk k of a normalised text with `reach` characters to both sides, and the chunk's place in it."""
    a, b = k * chunk, min((k + 1) * chunk, len(text))
    low = max(0, a - reach)
    return text[low : b + reach], a - low, b - low


Matrix = list[tuple[int, int]]


def multiplied(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices, each given by its pairs of states of weight 0."""
    onward: dict[int, list[int]] = {}
    for i, o in b:
        onward.setdefault(i, []).append(o)
    return sorted({(i, o) for i, via in a for o in onward.get(via, ())})


def resolved(matrices: list[Matrix], into: int, out: int | None) -> list[tuple[int, int]]:
    """The state before and after each of the matrices, from `into` to `out` (None: the final state): forward, then back."""
    reach: list[dict[int, int]] = []
    now = {into}
    for pairs in matrices:
        step = {o: i for i, o in sorted(pairs, reverse=True) if i in now}
        reach.append(step)
        now = set(step)
    if not now or (out is not None and out not in now):
        raise RuntimeError("no path through the lattice: a chunk is missing or not the text's")
    at, states = max(now) if out is None else out, []
    for step in reversed(reach):
        states.append((step[at], at))
        at = step[at]
    return states[::-1]


def _in_out(matrices: list[Matrix]) -> list[pa.Array]:
    return [pa.array([[pair[j] for pair in pairs] for pairs in matrices], pa.list_(pa.int64())) for j in (0, 1)]


def _matrices(group: pa.Table) -> list[Matrix]:
    k = group["k"].to_pylist()
    if k != list(range(k[0], k[0] + len(k))):
        raise RuntimeError("a chunk is missing")
    return [list(zip(i, o, strict=True)) for i, o in zip(group["ins"].to_pylist(), group["outs"].to_pylist(), strict=True)]


def states(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(key, k, into, out) of (key, k, ins, outs): the states before and after each chunk of each text."""

    def product(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        found = reduce(multiplied, _matrices(group))
        ins, outs = _in_out([found])
        return pa.table({"key": group["key"].slice(0, 1), "k": pa.array([group["k"][0].as_py() // fan], pa.int64()), "ins": ins, "outs": outs})

    def resolve(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        found = resolved(_matrices(group), group["from"][0].as_py(), group["to"][0].as_py())
        return pa.table({"key": group["key"], "k": group["k"], "into": pa.array([x[0] for x in found], pa.int64()), "out": pa.array([x[1] for x in found], pa.int64())})

    part = F.floor(F.col("k") / F.lit(fan))
    most = matrices.agg(F.max("k")).first()[0] or 0
    levels = [matrices]
    while most >= fan:
        levels.append(materialise(levels[-1].groupBy("key", part.alias("part")).applyInArrow(product, "key string, k long, ins array<long>, outs array<long>")))
        most //= fan
    known = None
    for level in reversed(levels):
        rows = level.withColumn("part", part)
        if known is None:
            rows = rows.withColumns({"from": F.lit(0).cast("long"), "to": F.lit(None).cast("long")})
        else:
            rows = rows.join(known.select("key", F.col("k").alias("part"), F.col("into").alias("from"), F.col("out").alias("to")), ["key", "part"])
        known = rows.groupBy("key", "part").applyInArrow(resolve, "key string, k long, into long, out long")
    return known


def digest(ids: list[int] | np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()


def _listed(found: list[np.ndarray]) -> pa.ListArray:
    """An array of arrays, without a Python number for each token."""
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, *, model: str | None = None, chunk: int = CHUNK, fan: int = FAN, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip[, ids]); one row for each document. ids_sha256: of the ids as 32-bit little-endian."""
    spark = prepare(docs.sparkSession)
    file = shipped(spark, model)
    loaded = lambda: pieces(SparkFiles.get(file))
    schema = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    names = [x.split()[0] for x in schema.split(", ")]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def short(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, rows = loaded(), []
        for t in utf8(batch.column(1)):
            text = t.decode()
            found = p.encode(text)
            same = SPACE not in text and p.spelled(found) == (SPACE + text.replace(" ", SPACE)).encode() if text else True
            rows.append((len(found), digest(found), same, np.array(found, np.int32) if ids else None))
        kinds = [pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], kinds[j]) for j in range(3)), *([_listed([r[3] for r in rows])] if ids else [])], names)

    small = map_arrow(base.where(F.length("text") < chunk), short, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded()
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                key, text = hashlib.blake2b(t, digest_size=16).hexdigest(), t.decode()
                exact = SPACE not in text
                text = SPACE + text.replace(" ", SPACE)
                n = -(-len(text) // chunk)
                for k in range(n):
                    window, a, b = _window(text, k, chunk, p.longest)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "key": [key], "k": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64()), "a": pa.array([a], pa.int64()), "b": pa.array([b], pa.int64()), "exact": [exact], "piece": [window]})

    # the giant texts, read and cut once; all that follows reads the chunks
    chunks = materialise(base.where(F.length("text") >= chunk).mapInArrow(cut, "doc_id long, key string, k long, n long, a long, b long, exact boolean, piece string"))

    def transfers(batch: pa.RecordBatch, easy_only: bool) -> pa.RecordBatch:
        """Matrices where sure borders make them cheap; with easy_only other chunks go on with their text."""
        p, left, found = loaded(), [], []
        for r in batch.to_pylist():
            later = easy_only and p.borders(r["piece"], r["a"], r["b"]) is None
            left.append(r["piece"] if later else None)
            found.append([] if later else p.transfer(r["piece"], r["a"], r["b"], r["k"] == 0, r["k"] == r["n"] - 1))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "k", "n", "a", "b")), pa.array(left, pa.string()), *_in_out(found)], ["key", "k", "n", "a", "b", "piece", "ins", "outs"])

    columns = "key string, k long, n long, a long, b long, piece string, ins array<long>, outs array<long>"
    ends = materialise(map_arrow(chunks.select("key", "k", "n", "a", "b", "piece"), lambda batch: transfers(batch, True), columns).dropDuplicates(["key", "k"]))
    hard = ends.where("piece is not null").repartition("key", "k")  # walked through the lattice, spread over all tasks
    walked = map_arrow(hard.select("key", "k", "n", "a", "b", "piece"), lambda batch: transfers(batch, False), columns)
    known = states(materialise(ends.where("piece is null").unionAll(walked).select("key", "k", "ins", "outs")), fan)

    def trace(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, found, ok = loaded(), [], []
        columns = (batch.column(c).to_pylist() for c in ("exact", "piece", "a", "b", "into", "out"))
        for exact, *chunk_of in zip(*columns, strict=True):
            ids_, same = p.back(*chunk_of)
            found.append(np.array(ids_, np.int32))
            ok.append(exact and same)
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(ok), _listed(found)], ["key", "k", "ok", "ids"])

    # equal texts are traced once; one shuffle of the chunks serves this and the join
    once = chunks.drop("doc_id").dropDuplicates(["key", "k"])
    traced = map_arrow(once.join(known, ["key", "k"]).select("key", "k", "a", "b", "exact", "piece", "into", "out"), trace, "key string, k long, ok boolean, ids array<int>")
    whole = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.min("ok").alias("round_trip"))
    whole = whole.select("key", "round_trip", F.flatten(F.col("parts.ids")).alias("all_ids"))

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("all_ids").cast(pa.list_(pa.int32()))
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        found = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        cols = [batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([digest(x) for x in found], pa.string()), batch.column("round_trip")]
        return pa.RecordBatch.from_arrays([*cols, *([lists] if ids else [])], names)

    long = chunks.where("k = 0").select("doc_id", "key").join(whole, "key").select("doc_id", "round_trip", "all_ids")
    return small.unionByName(map_arrow(long, digests, schema))


def decode(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """encoded (with ids) and text, in place of a text that it has: what the ids spell; of null ids the empty text."""
    file = shipped(prepare(encoded.sparkSession), model)
    rows = encoded.drop("text")
    at, names, schema = rows.columns.index("ids"), [*rows.columns, "text"], rows.select("*", F.lit("").alias("text")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, lists = pieces(SparkFiles.get(file)), batch.column(at)
        texts = [p.decode(v.values.to_numpy().tolist() if v.is_valid else []) for v in lists]  # one list at a time
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return map_arrow(rows, run, schema)
