import itertools
import random

import numpy as np
import xxhash

from factloom.llm import simhash_dedup as sh


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def classes(fp):
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(fp, 2):
        if (fp[a] ^ fp[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fp}


def test_fingerprints(spark):
    for text in ("One two THREE four", "a b", "x", "", "Ünï códe wörds here", "same same same same same"):
        assert sh.fingerprint(text.encode()) == plain(text)
    words = " ".join(random.Random(1).choice("abc") for _ in range(70_000))
    assert sh.fingerprint(words.encode()) == plain(words)
    assert spark.sql("select xxhash64('a b c') as h").first().h == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).view(np.int64)


def test_components_equal_brute_force(documents):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(5))
    rows = []
    for g in range(40):
        base = [word() for _ in range(120)]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(120)] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, "  "), (1002, rows[0][1])]
    out = {r.doc_id: r for r in sh.near_duplicates(documents(rows)).collect()}
    want = classes({i: plain(t or "") for i, t in rows})
    assert {i: r.component_id for i, r in out.items()} == want
    assert all(int(out[i].fingerprint, 16) == plain(t or "") and len(out[i].fingerprint) == 16 for i, t in rows)
    kept = [r.doc_id for r in sh.one_of_each(documents(rows)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def near(rng, n, flips):
    centre = rng.getrandbits(64)
    out = set()
    while len(out) < n:
        x = centre
        for b in rng.sample(range(16), rng.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_links_of_hot_keys_and_all_allocations(spark):
    rng = random.Random(6)
    prints = sorted(set(near(rng, 120, 8) + near(rng, 60, 3) + [rng.getrandbits(64) for _ in range(400)]))
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")
    want = classes(dict(enumerate(prints)))
    _, _, correlation = sh.bit_statistics(nodes)
    for m, thresholds in ((2, [1, 1]), (2, [0, 2]), (3, [1, 0, 0]), (4, [0, 0, 0, 0]), (4, [1, -1, 0, 0]), (5, [0, 0, 0, 0, -1])):
        for block in (16, 16384):
            found = sh.links(nodes, sh.split_bits(correlation, m), thresholds, block=block).collect()
            assert all((r.a ^ r.b).bit_count() <= 3 or bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in found)
            place = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(prints)}
            root = list(range(len(prints)))

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for r in found:
                x, y = find(place[r.a]), find(place[r.b])
                root[max(x, y)] = min(x, y)
            assert {i: find(i) for i in range(len(prints))} == want, (m, thresholds, block)
            if block == 16384:
                assert len(found) < 4 * 2 * len(prints)  # forests, not all pairs


def test_allocation_is_a_pigeonhole():
    for n in (10, 10**5, 10**10):
        for m in range(2, 6):
            widths = [64 // m] * m
            cost, t = sh.allocate(n, widths, [[2.0**-w * (1 + 2 * k) for k in range(4)] for w in widths])
            assert sum(t) == sh.TAU - m + 1 and cost >= 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (600, 500)]
    out = {r.node: r.root for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(201)) and {out[i] for i in (500, 501, 502, 600)} == {500}


def test_one_row_of_each_component_whatever_its_id(documents):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(80))
    t = [text() for _ in range(8)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (1, t[2]), (None, t[2]), (5, t[3]), (5, t[4]), (5, t[4]), (6, t[4]), (7, t[5]), (7, t[6]), (6, t[6]), (None, None), (None, ""), (None, t[7])]
    kept = sorted(((r.doc_id, r.text) for r in sh.one_of_each(documents(rows)).collect()), key=str)
    blank = [k for k in kept if not k[1]]
    assert len(blank) == 1 and blank[0][0] is None
    assert [k for k in kept if k[1]] == sorted([(None, t[0]), (None, t[1]), (1, t[2]), (5, t[3]), (5, t[4]), (7, t[5]), (6, t[6]), (None, t[7])], key=str)
