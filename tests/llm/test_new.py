"""Fill-in-middle, target encoding, decontamination."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from factloom.llm import fill_in_middle as fim
from factloom.llm import target_encoding as te
from factloom.llm import wu_manber as wm

ALPHABET = ["a", "Zq", "word", " ", "\n", "é", "梦", "😀", "<", ">", "P", "<P", "S>", "1", "\x00", "́"]


def rearranged(doc_id, text):
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_fill_in_middle_equals_plain(documents, monkeypatch, block):
    monkeypatch.setattr(fim.Counted.__init__, "__defaults__", (block,))
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(301, None), (302, ""), (303, "x<M>y"), (304, "<PP>><<S"), (305, "ab " * 40_000)]
    out = {r.doc_id: r for r in fim.transform(documents(rows)).collect()} if block > 100 else None
    if out is None:  # blocks that cut units, code points and sentinels; in this process, where the block is patched
        for i, t in rows[:-1]:
            data = np.frombuffer((t or "").encode(), np.uint8)
            c = fim.Counted(data, np.array([0, len(data)]), block)
            units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t or "")
            assert (c.units[0], c.points[0], c.sentinels[0]) == (len(units), len(t or ""), len(re.findall("<[PSM]>", t or ""))), repr(t)
            at = np.arange(len(units) + 1)
            byte, point = c.cuts(np.zeros(len(at), np.int64), at)
            assert [len("".join(units[:k]).encode()) for k in at] == byte.tolist() and [len("".join(units[:k])) for k in at] == point.tolist()
        return
    forms = Counter()
    for i, t in rows:
        r = out[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == rearranged(i, t or ""), repr(t)
        forms[r.form] += 1
    assert len(forms) == 3
    for r in fim.digests(documents(rows)).collect():
        assert r.restored_sha256 == hashlib.sha256((dict(rows)[r.doc_id] or "").encode()).hexdigest()


def shop(spark, lines, sales, items=(), vendors=(), clients=()):
    return (
        spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, flag string"), spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz"),
        spark.createDataFrame(list(items), "item_id long, kind string"), spark.createDataFrame(list(vendors), "vendor_id long, nation_id int"), spark.createDataFrame(list(clients), "client_id long, segment string"),
    )


def encoded(lines, sales, items, vendors, clients):
    """Every line against every other one."""
    sold = {s: (t, -1 if c is None else c) for s, c, t in sales if s is not None and t is not None}
    kind, nation, segment = dict(items), dict(vendors), dict(clients)
    rows = []
    for s, _, i, v, f in lines:
        if s in sold:
            i, c = -1 if i is None else i, sold[s][1]
            rows.append((s, i, v, f == "returned", sold[s][0], zlib.crc32(str(s).encode()) % 5, c, kind.get(i), nation.get(v), segment.get(c)))
    out = {}
    for r in rows:
        past = [x for x in rows if x[5] != r[5] and x[4] < r[4]]

        def rate(at, prior, past=past, r=r):
            same = [x[3] for x in past if at is None or x[at] == r[at]]
            return len(same), prior if not same else (1_000_000 * sum(same) + 50 * prior) // (len(same) + 50)

        every = rate(None, 500_000)[1]
        item, vendor, client = (rate(a, rate(b, every)[1]) for a, b in ((1, 7), (2, 8), (6, 9)))
        n, back = out.get(r[:3], (0, 0))[:2]
        out[r[:3]] = (n + 1, back + r[3], *item, *vendor, *client)
    return sorted((str(k), v) for k, v in out.items())


def test_target_encoding_equals_every_line_against_every_other(spark):
    rng = random.Random(6)
    start = datetime(2024, 3, 1)
    sales = [(i, rng.choice([1, 1, 2, 3, None, 77]), rng.choice([None, *[start + timedelta(seconds=rng.randint(0, 60)) for _ in range(9)]])) for i in range(150)]
    sales += [(None, 1, start)]
    line = lambda: (rng.choice([7, 7, rng.randint(0, 160), None]), 1, rng.choice([1, 1, 2, 3, 9, None]), rng.choice([4, 4, 5, 6, None]), rng.choice(["returned", "kept", None]))
    lines = [line() for _ in range(500)]
    lines += lines[:40]
    tables = lines, sales, [(1, "x"), (2, None), (3, "y"), (-1, "x")], [(4, 1), (5, None), (8, 2)], [(1, "s"), (2, "t"), (3, None), (-1, "t")]
    for ranges in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        try:
            got = te.encode(*shop(spark, *tables)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted((str((r.sale_id, r.item_id, r.vendor_id)), tuple(r)[3:]) for r in got) == encoded(*tables)


def test_target_encoding_odd_tables(spark):
    start = datetime(2024, 3, 1)
    assert te.encode(*shop(spark, [], [])).collect() == []
    assert te.encode(*shop(spark, [(1, 1, 1, 1, "kept"), (None, 1, 1, 1, "kept")], [(2, 1, start), (1, 1, None)])).collect() == []
    twice = shop(spark, [(1, 1, 1, 1, "returned"), (2, 1, 1, 1, "kept")], [(1, 5, start), (1, 4, start), (1, 1, start + timedelta(days=1)), (2, 5, start + timedelta(microseconds=1))], [(1, "b"), (1, "a"), (None, "c")])
    clash = [t.selectExpr("*", *(f"'clash' as {c}" for c in ("time", "fold", "level", "n", "s", "name", "back", "key") if c not in t.columns)) for t in twice]
    for tables in (twice, clash):
        rows = {r.sale_id: r for r in te.encode(*tables).collect()}
        assert rows[1].n_returned == 1 and rows[1].item_n == 0 and rows[1].item_rate == 500_000
        folds = [zlib.crc32(x) % 5 for x in (b"1", b"2")]
        assert rows[2].item_n == (folds[0] != folds[1]) and rows[2].client_n == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(docs, items, n=10):
    lower = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    pats = defaultdict(set)
    for i, t in items:
        w = lower(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            pats[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, which = lower(t), set(), set()
        for p, who in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    which |= {str(i) for i in who if i is not None}
        out.append((d, len(w), sorted(hit), sorted(which)))
    return out


def spread(rows):
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.begin, s.end)], list(r["items"])) for r in rows), key=str)


def test_wu_manber_equals_plain(spark, documents):
    rng = random.Random(3)
    vocabulary = ["a", "ab", "the", "thé", "梦", "x" * 70, "in", "ab1", "of", "one", "and"]
    text = lambda n: rng.choice(["", " ", "."]) + "".join(rng.choice([w, w.upper()]) + rng.choice([" ", ", ", "\n", "-", "\x00", "  "]) for w in (rng.choice(vocabulary) for _ in range(n)))
    items = [(i, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 25]))) for i in range(40)]
    items += [(41, items[7][1]), (7, text(12)), (None, text(14)), (42, None), (43, "one"), (44, "W" * 3000 + " end")]
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + text(rng.randint(0, 9))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "w" * 3000 + " END"), (None, docs[3][1]), (3, docs[3][1]), (3, docs[3][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(found(docs, items), key=str)
    assert spread(wm.find(documents(docs), table).collect()) == want
    assert spread(wm.find(documents(docs), table, shard_rows=25).collect()) == want  # many shards
    assert sum(bool(w[2]) for w in want) > 10
    for r in wm.digests(documents(docs), table).collect():
        assert r.contaminated == (r.n_hit > 0)


def test_shift_table_skips():
    """Most of a text without benchmark words is never looked at."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    patterns = wm.Patterns([(" ".join(word("abcdef") for _ in range(10)) + " ", "1") for _ in range(200)])
    (c,) = patterns.classes
    data, _ = wm.spelt([" ".join(word("uvwxyz") for _ in range(20_000)).encode()])
    looked = []

    class Blocks(np.ndarray):
        def __getitem__(self, at):
            looked.append(np.size(at))
            return np.asarray(self)[at]

    blocks = np.lib.stride_tricks.as_strided(np.frombuffer(data.tobytes(), np.uint8), (len(data) - 7,), (1,)).astype("<u8")
    blocks = np.array([int.from_bytes(data[i : i + 8].tobytes(), "little") for i in range(len(data) - 7)], "<u8").view(Blocks)
    place, _ = c.search(data, blocks, data.tobytes())
    assert len(place) == 0 and sum(looked) < len(data) / 30


def test_wu_manber_without_items_or_documents(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    out = wm.digests(documents(), none).collect()
    assert len(out) == 10 and all((r.n_hit, r.n_items, r.contaminated) == (0, 0, False) and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in out)
    assert wm.digests(documents([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


RUNS = {"op11": fim.digests, "op13": lambda d: wm.digests(d, d.selectExpr("doc_id as item_id", "substring(text, 1, 60) as text", "'clash' as words", "'clash' as item"))}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_clashing_columns(name, documents, clashing):
    plain = sorted(map(str, RUNS[name](documents()).collect()))
    assert len(plain) == 10 and sorted(map(str, RUNS[name](clashing(documents()).repartition(3)).collect())) == plain
    assert RUNS[name](documents([])).collect() == []
