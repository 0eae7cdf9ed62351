import random
import re

import numpy as np

from factloom.llm import quality_qda, quality_rules
from factloom.llm import text_stats as ts

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é梦 ", "x#|> ", "\n", "\x1f\x85 ", " \t\x0b"]) for _ in range(rng.randint(0, 80)))
        assert ts.measure(text.encode())[:5] == plain(text), repr(text)


def texts(n):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(40, 120))]
        bad = i % 6 == 0
        rows.append((i, " ".join((x.upper() + "!!" if i % 12 == 0 else x + "###") if bad else x for x in w), int(not bad)))
    return rows


def test_forest_finds_labelled_anomalies(documents, labels):
    rows = texts(600)
    out = {r.doc_id: r for r in quality_rules.judge(documents([r[:2] for r in rows]), labels([(i, q, 0) for i, _, q in rows])).collect()}
    wrong = sum(out[i].kept != bool(q) for i, _, q in rows)
    assert wrong <= 12 and not any(r.base_failed for r in out.values())


def test_forest_scores_rise_with_isolation():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(500, 3)))
    forest = quality_rules.IsolationForest().fit(x)
    (far, near, third), cause = forest.score(np.array([[9.0, 9, 9], [0.5, 0.5, 0.5], [0.5, 0.5, 9]]))
    assert far > third > near and cause[2] == 2
    assert (forest.score(x)[0] == quality_rules.IsolationForest().fit(x).score(x)[0]).all()


def test_query_equals_paths_walked_one_by_one(spark):
    """Every anomaly, cause and verdict of op1_quality_rules by walking each tree for each document in plain Python."""
    from factloom.llm.queries import op1_quality_rules

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest, limits = quality_rules.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = op1_quality_rules(spark, sf).collect()
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        words, chars, symbols, dup, repeat = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, dup, repeat)
        lines = sum(bool(SPACE.search(x)) for x in texts[r.doc_id].split("\n"))
        x = [np.log(1 + words), np.log((chars + 50) / (words + 10)), np.log(1 + 20 * symbols / (words + 10)), dup / (lines + 1), repeat / (words + 10)]
        ascii_ = [c for c in texts[r.doc_id] if c.isascii() and c.isalpha()]
        x += [sum(c.isupper() for c in ascii_) / (len(ascii_) + 60), np.log(1 + 20 * texts[r.doc_id].count("!") / (words + 10))]
        total, earned = 0.0, np.zeros(7)
        for root in forest.roots:
            at = root
            while forest.children[at][0] != at:
                at = forest.children[at][int(x[forest.feature[at]] > forest.threshold[at])]
            total += forest.length[at]
            earned += forest.credit[at]
        assert np.isclose(r.anomaly, 2 ** (-total / len(forest.roots) / forest.norm), atol=1e-9)
        cause = quality_rules.STATISTICS.index(r.cause)
        assert earned[cause] >= earned.max() - 1e-6
        failed = words < 20 or 100 * repeat > 30 * words
        assert r.base_failed == failed and r.kept == (not failed and r.anomaly <= limits[cause])


def test_thresholds_lose_few_good_rows():
    rng = np.random.default_rng(3)
    good, cause = rng.random(4000) > 0.1, rng.integers(0, 5, 4000)
    scores = np.round(rng.random(4000) * 0.5 + np.where(~good & (cause == 2), 0.45, 0.0), 3)
    limits = quality_rules.thresholds(scores, cause, good, 0.01)
    rejected = scores > limits[cause]
    assert (rejected & good).sum() <= 0.02 * good.sum() and rejected[~good & (cause == 2)].mean() > 0.8
    assert np.isinf(quality_rules.thresholds(scores, cause, np.ones(4000, bool), 0.01)).all()


def test_every_labelled_row_sets_thresholds(documents, labels):
    """Thresholds of 24,000 labelled rows, more than were once sampled, equal those worked out in memory over all; the forest too
    depends on neither order nor partitioning."""
    rng = np.random.default_rng(4)
    words = ["ab", "cde", "fghij", "klmnopq", "RST", "u#v", "wx!", "Yz", "|", "word"]
    rows = []
    for i in range(24_000):
        few = rng.integers(0, 10, 28)
        bad = rng.random() < 0.15
        rows.append((i, " ".join(words[w] if not bad or w < 4 else words[w].upper() + "#!" for w in few) + (" \n a b" * int(rng.integers(0, 3))), int(not bad)))
    docs, marks = documents([r[:2] for r in rows]), labels([(i, q, 0) for i, _, q in rows])
    forest, limits = quality_rules.fit(docs, marks)
    m, good = ts.measure_all([t.encode() for _, t, _ in rows]), np.array([q == 1 for *_, q in rows])
    judged = ~quality_rules.base_failed(m)
    expected = quality_rules.thresholds(*forest.score(quality_rules.statistics(m[judged])), good[judged], 0.01)
    assert np.isfinite(expected).any() and limits.tolist() == expected.tolist()
    again, same = quality_rules.fit(docs.repartition(7), marks.repartition(5))
    assert same.tolist() == limits.tolist() and (again.threshold == forest.threshold).all() and (again.feature == forest.feature).all()


def test_spark_limits_equal_those_in_memory(spark):
    """Ties, whole buckets of scores, causes without gain, rows at the ends and every bound on lost rows."""
    rng = np.random.default_rng(8)
    for n, digits, share, max_lost in ((1, 3, 0.5, 0.1), (40, 1, 0.5, 0.2), (3000, 2, 0.1, 0.01), (3000, 9, 0.3, 0.05), (500, 5, 0.0, 0.1)):
        good, cause = rng.random(n) >= share, rng.integers(0, 6, n)
        scores = np.round(rng.random(n) * 0.6 + np.where(~good & (cause < 3), 0.3, 0.0), digits)
        rows = spark.createDataFrame(list(zip(cause.tolist(), scores.tolist(), good.astype(int).tolist(), strict=True)), "cause int, score double, good long")
        assert quality_rules.limits(rows, max_lost).tolist() == quality_rules.thresholds(scores, cause, good, max_lost).tolist()


def test_forest_is_grown_on_unlabelled_documents_too(documents, labels):
    rows = texts(600)
    forest, _ = quality_rules.fit(documents([r[:2] for r in rows]), labels([(i, q, 0) for i, _, q in rows[:20]]))
    assert forest.norm == quality_rules.IsolationForest().fit(np.zeros((256, 7))).norm


def test_qda_on_held_out_rows(documents, labels):
    rows = texts(800)
    out = {r.doc_id: r for r in quality_qda.classify(documents([r[:2] for r in rows]), labels([(i, q, 0) for i, _, q in rows])).collect()}
    held = [(out[i].predicted, q) for i, _, q in rows if out[i].held_out]
    assert len(held) > 100 and sum(p == q for p, q in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())


def test_qda_log_ratio_is_the_density_difference():
    rng = np.random.default_rng(1)
    x, y = np.vstack([rng.normal(size=(80, 2)), rng.normal(2, 2, (80, 2))]), np.repeat([1.0, 0.0], 80)
    q = quality_qda.Qda(0.0, 0.0).fit(x, y)
    z = (np.clip(x, q.low, q.high) - q.centre) / q.scale
    log = []
    for k in (0, 1):
        c = np.cov(z[y == k].T, bias=True)
        e = z - z[y == k].mean(axis=0)
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e) + np.log(np.linalg.det(c))))
    assert np.allclose(q.log_ratio(x), log[1] - log[0])


def plain_features(text):
    words, chars, symbols, dup, repeat = plain(text)
    w = SPACE.findall(text)
    count = lambda pattern: len(re.findall(pattern, text))
    lines = sum(bool(SPACE.search(x)) for x in text.split("\n"))
    a_word = lambda n: np.log(1 + 20 * n / (words + 10))
    same = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return [
        a_word(symbols), dup / (lines + 3), repeat / (words + 10), count("[A-Z]") / (count("[A-Za-z]") + 60), a_word(count("!")), same / (words + 10), count(r"\|") / (words + 10),
        np.log(1 + words), (chars + 100) / (words + 20), (len(set(w)) + 20) / (words + 20), a_word(count("[0-9]")), count("[!?.,;:]") / (words + 10),
    ]


def test_quality_query_equals_plain_densities(spark):
    """op7_quality_classifier by shrunken covariances, inverses and determinants of whole matrices."""
    import zlib

    from factloom.llm.queries import op7_quality_classifier

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    x = {i: np.array(plain_features(t)) for i, t in texts.items()}
    learn = sorted(quality)
    a, y = np.array([x[i] for i in learn]), np.array([quality[i] for i in learn])
    low, high = np.quantile(a, [0.002, 0.998], axis=0)
    shown = lambda v: (np.clip(v, low, high) - np.clip(a, low, high).mean(axis=0)) / (np.clip(a, low, high).std(axis=0) + 1e-6)
    z = shown(a)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).sum() for k, c in enumerate(own)) / len(z)
    parts = []
    for k in (0, 1):
        c = 0.8 * own[k] + 0.2 * pooled
        parts.append((z[y == k].mean(axis=0), 0.95 * c + 0.05 * np.trace(c) / len(c) * np.eye(len(c))))
    out = op7_quality_classifier(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        v = shown(x[r.doc_id])
        log = [-0.5 * ((v - m) @ np.linalg.solve(c, v - m) + np.linalg.slogdet(c)[1]) for m, c in parts]
        assert np.isclose(r.log_ratio, log[1] - log[0], rtol=1e-6, atol=1e-6)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    inside = [(r.log_ratio, np.log(r.score / (1 - r.score))) for r in out if 1e-9 < r.score < 1 - 1e-9]
    slope, shift = np.polyfit(*zip(*inside, strict=True), 1)
    assert slope > 0 and all(np.isclose(slope * a + shift, b, rtol=1e-5, atol=1e-5) for a, b in inside)
