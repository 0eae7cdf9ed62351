import random
import zlib

import numpy as np

from factloom.llm import toxicity as tx


def test_index_equals_brute_force():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        i = np.sort(rng.choice(30, rng.integers(1, 8), replace=False))
        w = rng.integers(1, 4, len(i)).astype(float)  # ties are many
        vectors.append((i, np.round(w / np.sqrt((w * w).sum()), 9)))
    index = tx.BlockMaxIndex.of(vectors, 30)
    dense = np.zeros((300, 30))
    for n, (i, w) in enumerate(vectors):
        dense[n, i] = w
    for i, w in vectors[:100]:
        s = np.round(dense[:, i] @ w, 9)
        order = [k for k in sorted(range(300), key=lambda k: (-s[k], k)) if s[k] > 0][:15]
        near, sim = index.nearest(i, w, 15)
        assert np.allclose(sim, s[order]) and near.tolist() == order
    far = [(np.arange(8 * (n % 4), 8 * (n % 4) + 8), np.full(8, 0.353553391)) for n in range(4096)]  # four groups that share no term
    index = tx.BlockMaxIndex.of(far, 32, 64)
    near, sim = index.nearest(*far[1], 7)
    assert near.tolist() == [1, 5, 9, 13, 17, 21, 25] and index.read < 0.3 * index.asked


def test_bounds_add_up_what_rare_terms_give_to_one_example():
    """Each of 40 rare terms is in another example of every block; only block 0 has examples with all of them."""
    n, block, terms = 4096, 64, 40
    rows = [{e % block: 1.0} if e % block < terms else {terms + e: 1.0} for e in range(n)]
    for e in range(terms, terms + 8):
        rows[e] = dict.fromkeys(range(terms), round(terms**-0.5, 9))
    postings = sorted((t, e, w) for e, r in enumerate(rows) for t, w in r.items())
    term, at, weight = (np.array(x) for x in zip(*postings, strict=True))
    index = tx.BlockMaxIndex(np.arange(n), np.bincount(term), at, weight, block)
    near, sim = index.nearest(np.arange(terms), np.full(terms, round(terms**-0.5, 9)), 7)
    assert near.tolist() == list(range(terms, terms + 7)) and np.allclose(sim, 1) and index.read < 0.2 * index.asked


def test_single_precision_does_not_order_near_ties():
    """Frequent terms only; cosines differ in the eighth digit, below what single precision tells apart."""
    rng = np.random.default_rng(5)
    base = np.round(np.full(20, 20**-0.5) + 1e-7 * rng.random((400, 20)), 9)
    q = np.round(np.full(20, 20**-0.5), 9)
    index = tx.BlockMaxIndex.of([(np.arange(20), v) for v in base], 20)
    s = np.round(base @ q, 9)
    near, sim = index.nearest(np.arange(20), q, 7)
    assert near.tolist() == sorted(range(400), key=lambda e: (-s[e], e))[:7] and np.allclose(sim, np.sort(s)[::-1][:7], atol=0, rtol=1e-9)


def test_words_of_all_alphabets():
    text = "Straße_zwei naïve\xa0ÀÉ x²½ 12µm"
    for t in (text, text + " Ωμέγα слово", "", "\x85\x1c_"):
        assert tx.words_of(t) == tx._WORD.findall(t.lower())


def test_query_equals_brute_force(spark):
    """Evidence, similarities and scores of op2_toxicity by plain cosines over all terms of all learning examples."""
    import math
    import re
    from collections import Counter

    from factloom.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts}
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in texts.items()}
    count = {i: Counter(w) + Counter({("begins", b): 5 * n for b, n in Counter(x[:4] for x in w).items()}) for i, w in words.items()}
    df = Counter(t for i in toxic for t in count[i])

    def unit(c):
        v = {t: n * math.log(len(toxic) / df[t]) for t, n in c.items() if t in df}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else {}

    units = {i: unit(c) for i, c in count.items()}

    def nearest(i, but=None):
        s = [(-round(sum(x * units[e].get(t, 0.0) for t, x in units[i].items()), 6), e) for e in toxic if e != but]
        return [(e, -x) for x, e in sorted(s)[:7] if x < 0]

    def vote(near):
        w = sum(x * x for _, x in near)
        return sum(x * x * toxic[e] for e, x in near) / w if w else 0.0

    got = {r.doc_id: r for r in op2_toxicity(spark, sf).collect()}
    assert set(got) == set(texts) and len(set(toxic.values())) == 2
    curve = {}
    for i, r in got.items():
        near = nearest(i)
        assert np.allclose(r.similarity, [x for _, x in near[:5]], atol=2e-6)
        sims = [x for _, x in near]
        if len(set(np.round(sims, 4))) == len(sims):  # no near ties, which rounding orders
            assert r.evidence == [e for e, _ in near[:5]]
            curve[round(vote(near), 4)] = r.score
    votes = sorted(curve)
    assert len(votes) > 20 and all(curve[a] <= curve[b] + 1e-4 for a, b in zip(votes, votes[1:], strict=False))  # scores rise with votes
    most = Counter(tuple(r.evidence) for r in got.values()).most_common(1)[0][1]
    assert most <= 0.05 * len(got) + max(Counter(texts.values()).values())


def rows(n=900):
    rng = random.Random(4)
    bad = ["grom", "blarg", "snurf"]
    out = []
    for i in range(n):
        w = ["".join(rng.choice("etaoins") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        y = i % 7 == 0
        if y:
            for k in range(6):
                w[k * 9] = rng.choice(bad)
        out.append((i, " ".join(w), int(y)))
    return out


def test_held_out_accuracy_and_folds(documents, labels):
    data = rows()
    out = {r.doc_id: r for r in tx.score(documents([r[:2] for r in data]), labels([(i, 1, y) for i, _, y in data])).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in out)
    held = [(out[i].predicted, y) for i, _, y in data if out[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    assert all(not set(r.evidence) & {i for i in out if out[i].held_out} for r in out.values())
    flipped = tx.score(documents([r[:2] for r in data]), labels([(i, 1, 1 - y if out[i].held_out else y) for i, _, y in data]))
    assert {r.doc_id: r.score for r in flipped.collect()} == {i: r.score for i, r in out.items()}  # held-out labels are not read


def test_stage_drops_what_the_score_rejects(documents, labels):
    data = rows(400)
    d, x = documents([r[:2] for r in data]), labels([(i, 1, y) for i, _, y in data])
    kept = {r.doc_id for r in tx.score(d, x).collect() if r.predicted == 0}
    assert {r.doc_id for r in tx.without_toxic(d, x).collect()} == kept
