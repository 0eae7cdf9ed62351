"""Operator 11: fill-in-middle. A table-driven DFA over UTF-8 bytes counts units, then a second pass finds the cuts.

A unit is a run of A-Z and a-z or one other code point. The automaton reads bytes by class; its states are what the last bytes
were: outside a word, in a word, after `<`, after `<` and P, S or M, and one to three bytes of a code point still to come. Its
transitions emit counts: a unit begins, a code point begins, a sentinel ends. Every state is fixed by the few bytes before, so a
block's states are found by applying the table to all bytes at once until nothing changes, which is the sequential run.

The first pass goes through an Arrow batch in blocks of BLOCK bytes, keeps what each block enters with (state and counts), and gives
each text its units, code points and sentinels. The second scans again only the blocks in which a cut lies.

Defined results: a null text is empty; an empty text, one that holds a sentinel and those that the draw leaves are plain; a null
doc_id draws like an empty one; repeated rows each get their row; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow

BLOCK = 1 << 20
PLAIN_FROM, SPM_UNDER = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_OUT, _WORD, _OPEN, _NAMED, _ONE, _TWO, _THREE = range(7)
_OTHER, _LETTER, _NAME, _LESS, _MORE, _REST, _LEAD2, _LEAD3, _LEAD4 = range(9)
_WIDTH = 16  # classes a state, a power of two
_BEGIN, _POINT, _SENTINEL = 1, 2, 4


def _classes() -> np.ndarray:
    """The class of each byte."""
    c = np.full(256, _OTHER, np.uint8)
    for a, z, of in ((0x41, 0x5A, _LETTER), (0x61, 0x7A, _LETTER), (0x80, 0xBF, _REST), (0xC0, 0xDF, _LEAD2), (0xE0, 0xEF, _LEAD3), (0xF0, 0xFF, _LEAD4)):
        c[a : z + 1] = of
    c[[ord(x) for x in "PSM"]] = _NAME
    c[ord("<")], c[ord(">")] = _LESS, _MORE
    return c


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and what is emitted, by state * _WIDTH + class."""
    to, emit = np.zeros(7 * _WIDTH, np.uint8), np.zeros(7 * _WIDTH, np.uint8)
    for state in range(7):
        for of, next_ in ((_OTHER, _OUT), (_LETTER, _WORD), (_NAME, _NAMED if state == _OPEN else _WORD), (_LESS, _OPEN), (_MORE, _OUT), (_LEAD2, _ONE), (_LEAD3, _TWO), (_LEAD4, _THREE), (_REST, {_THREE: _TWO, _TWO: _ONE}.get(state, _OUT))):
            letter = of in (_LETTER, _NAME)
            on = of != _REST
            to[state * _WIDTH + of] = next_
            emit[state * _WIDTH + of] = on * _POINT + (on and not (letter and state in (_WORD, _NAMED))) * _BEGIN + (of == _MORE and state == _NAMED) * _SENTINEL
    return to, emit


_CLASS = _classes()
_TO, _EMIT = _tables()


def scan(data: np.ndarray, resets: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """What the automaton emits at each byte, and its last state. resets: places at which a text begins."""
    classes = _CLASS[data]
    before = np.full(len(data), _OUT, np.uint8)
    while True:
        before[0] = state
        before[resets] = _OUT
        at = before * np.uint8(_WIDTH) + classes
        after = _TO[at]
        if np.array_equal(before[1:], np.where(_starts(len(data), resets)[1:], _OUT, after[:-1])):
            return _EMIT[at], int(after[-1])
        before[1:] = after[:-1]


def _starts(n: int, resets: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[resets] = True
    return out


class Counted:
    """The counts of the texts of one buffer; offsets: where each begins, and where the last ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        self.data, self.offsets, self.block = data, offsets, block
        self.entered: list[tuple[int, int, int]] = []  # state, units and code points before each block
        state, units, points, sentinels = _OUT, 0, 0, 0
        at = np.zeros((len(offsets), 3), np.int64)
        for lo in range(0, len(data), block):
            self.entered.append((state, units, points))
            emitted, state = self._emitted(lo, state)
            inside = np.flatnonzero((offsets >= lo) & (offsets < lo + len(emitted)))
            for j, (bit, so_far) in enumerate(((_BEGIN, units), (_POINT, points), (_SENTINEL, sentinels))):
                at[inside, j] = so_far + np.concatenate([[0], np.cumsum(emitted & bit > 0)])[offsets[inside] - lo]
            units, points, sentinels = units + int((emitted & _BEGIN > 0).sum()), points + int((emitted & _POINT > 0).sum()), sentinels + int((emitted & _SENTINEL > 0).sum())
        at[offsets == len(data)] = units, points, sentinels
        self.at = at
        self.units, self.points, self.sentinels = np.diff(at, axis=0).T

    def _emitted(self, lo: int, state: int) -> tuple[np.ndarray, int]:
        part = self.data[lo : lo + self.block]
        inside = self.offsets[(self.offsets >= lo) & (self.offsets < lo + len(part))]
        return scan(part, inside - lo, state)

    def cuts(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte and the code point within the buffer at which a unit of a text begins; past the last unit, its end."""
        byte, point = self.offsets[text + 1].copy(), self.at[text + 1, 1].copy()
        inside = np.flatnonzero(unit < self.units[text])
        number = self.at[text[inside], 0] + unit[inside]
        block = np.searchsorted(np.array([e[1] for e in self.entered]), number, "right") - 1
        for b in np.unique(block):
            state, units, points = self.entered[b]
            emitted, _ = self._emitted(b * self.block, state)
            here = block == b
            local = np.flatnonzero(emitted & _BEGIN)[number[here] - units]
            byte[inside[here]] = local + b * self.block
            point[inside[here]] = points + np.concatenate([[0], np.cumsum(emitted & _POINT > 0)])[local]
        return byte, point


def _arranged(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch["text"].cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    found = Counted(data, offsets - offsets[0])
    h = np.array([batch[c].to_numpy() for c in ("h1", "h2", "h3", "h4")])
    n, rows = found.units, np.arange(len(texts))
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    first, first_point = found.cuts(rows, np.minimum(a, b))
    second, second_point = found.cuts(rows, np.maximum(a, b))
    plain = (n == 0) | (found.sentinels > 0) | (h[2] % 100 >= PLAIN_FROM)
    spm = ~plain & (h[3] % 100 < SPM_UNDER)
    begin, end = found.offsets[:-1], found.offsets[1:]
    raw, out = memoryview(data), []
    for i in rows.tolist():
        if plain[i]:
            out.append(bytes(raw[begin[i] : end[i]]))
            continue
        parts = raw[begin[i] : first[i]], raw[first[i] : second[i]], raw[second[i] : end[i]]
        p, m, s = parts
        out.append(b"".join((SUFFIX.encode(), s, PREFIX.encode(), p, MIDDLE.encode(), m) if spm[i] else (PREFIX.encode(), p, SUFFIX.encode(), s, MIDDLE.encode(), m)))
    counts = lambda x: pa.array(x, pa.int64(), mask=plain)
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
    columns = [batch["doc_id"], pa.array(n, pa.int64()), form, counts(first_point - found.at[:-1, 1]), counts(second_point - first_point), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text in units, and as the draw of its id rearranges it."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws)
    return map_arrow(rows, _arranged, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from what transform() made of it: a text that was rearranged holds no sentinel of its own."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def digests(docs: DataFrame) -> DataFrame:
    """The columns of transform() with digests of its output and of the text restored from it."""
    rows = transform(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_H = ", ".join(f"('0x' || substr(d, {8 * i + 1}, 8))::bigint as h{i + 1}" for i in range(4))
ORACLE = f"""
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as d from documents),
u as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, {_H} from t),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u),
p as (select *, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:], '') as s,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= {PLAIN_FROM} then 'plain' when h4 % 100 < {SPM_UNDER} then 'spm' else 'psm' end as form from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from p"""
