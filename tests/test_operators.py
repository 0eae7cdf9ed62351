"""Verdicts, evidence, chunks, events, clusters, tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import chunking, events, evidence, tables, vectors, veracity


def test_segment_labels(spark):
    rows = [(1, "UNKNOWN", 0.9), (2, "MIXED", 1.0), (3, "SUPPORTED", 0.0), (3, "SUPPORTED", 0.2), (4, "SUPPORTED", 1.0), (4, "CONTRADICTED", 0.9), (5, "CONTRADICTED", 0.8)]
    out = {r.segment_id: r.label for r in veracity.segment_labels(spark.createDataFrame(rows, "segment_id int, label string, confidence double")).collect()}
    assert out == {1: "NOT_CHECKABLE", 2: "UNKNOWN", 3: "SUPPORTED", 4: "MIXED", 5: "CONTRADICTED"}


def fuse(rows, risk, told):
    rows = [r for r in rows if r[0]]
    if not rows:
        return ("UNKNOWN", 0.5, "PRIMARY_SOURCE_NOT_RETRIEVED" if told else "NO_RELEVANT_EVIDENCE")
    best = min(int(r[3][1]) for r in rows)
    if risk == "CRITICAL" and best > 2:
        return ("UNKNOWN", 0.3, "INSUFFICIENT_TIER_FOR_RISK")
    if risk == "HIGH" and best > 3:
        return ("UNKNOWN", 0.4, "INSUFFICIENT_TIER_FOR_RISK")
    free = [r for r in rows if r[2]]
    if not free:
        return ("UNKNOWN", 0.3, "CIRCULAR_ONLY")
    mean = lambda n: (lambda x: sum(x) / len(x) if x else None)([r[1] for r in free if r[0] == n])
    s, c, neutral = mean("ENTAILMENT"), mean("CONTRADICTION"), mean("NEUTRAL")
    yes = lambda: ("SUPPORTED", min(s, 0.6) if best >= 4 else s, None)
    no = lambda: ("UNKNOWN", c, "PRIMARY_SOURCE_NOT_RETRIEVED") if told else ("CONTRADICTED", c, None)
    if s is not None and c is not None:
        if min(s, c) >= 0.5 and abs(s - c) <= 0.25:
            return ("MIXED", max(s, c), "EVIDENCE_CONFLICT")
        if s >= c and s >= 0.5:
            return yes()
        if c > s and c >= 0.55:
            return no()
        return ("UNKNOWN", max(x for x in (s, c, neutral) if x is not None), "WEAK_CONFLICT")
    if c is not None:
        return ("UNKNOWN", c, "WEAK_CONTRADICTION") if c < 0.55 else no()
    if s is not None:
        return ("UNKNOWN", s, "WEAK_SUPPORT") if s < 0.5 else yes()
    return ("UNKNOWN", neutral if neutral is not None else 0.5, "NEUTRAL_ONLY")


def test_fusion_equals_plain_one(spark):
    rng, rows, want = random.Random(3), [], {}
    for claim in range(400):
        mine = [(rng.choice(["ENTAILMENT", "CONTRADICTION", "NEUTRAL", None]), rng.randint(1, 20) / 20, rng.random() < 0.8, f"T{rng.randint(1, 5)}") for _ in range(rng.randint(1, 5))]
        risk, told = rng.choice(["CRITICAL", "HIGH", "MEDIUM", "LOW"]), rng.random() < 0.2
        rows += [(claim, *r, risk, told) for r in mine]
        want[claim] = fuse(mine, risk, told)
    df = spark.createDataFrame(rows, "claim_id int, nli_label string, nli_confidence double, is_independent boolean, tier string, risk string, is_attribution boolean")
    for r in veracity.verdicts(df).collect():
        label, conf, reason = want[r.claim_id]
        assert (r.label, r.reason) == (label, reason) and r.confidence == pytest.approx(conf)


def test_scope_gate(spark):
    rows = [(1, "the army bombed Paris today", "cheese recipes online", 0.1, "ENTAILMENT", 0.9, True), (2, "the army bombed Paris today", "cheese recipes", 0.6, "ENTAILMENT", 0.9, True), (3, "x", "y", 0.1, "CONTRADICTION", 0.0, False)]
    df = spark.createDataFrame(rows, "id int, claim_text string, evidence_text string, sim double, nli_label string, nli_confidence double, is_independent boolean")
    out = {r.id: (r.nli_label, r.nli_confidence) for r in veracity.gated(df).collect()}
    assert out == {1: ("NEUTRAL", 0.55), 2: ("ENTAILMENT", 0.9), 3: ("CONTRADICTION", 0.5)}


def test_chunks(spark):
    sentence = "one two three four five six seven eight nine ten. "
    text = (sentence * 18).strip() + "\n\n" + "short tail here now."
    got = chunking.chunk(text)
    assert [n for _, n in got] == [196, 62] and got[1][0].endswith("short tail here now.")
    out = chunking.segments(spark.createDataFrame([("a", text), ("b", None), ("c", "few words")], "doc_id string, text string")).collect()
    assert [(r.document_id, r.position_index, r.token_count) for r in out] == [("a", 0, 196), ("a", 1, 62)]
    assert all("<!-- corpus-watermark:" in r.watermarked_text for r in out)


def test_neighbours_and_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(i, j) for i in range(300) for j in sorted((j for j in range(300) if j != i and s[i, j] > 0.25), key=lambda j: (-s[i, j], j))[:8]}
    assert {(r.left_id, r.right_id) for r in vectors.knn_join(df, df, 8, 0.25).collect()} == want
    assert {(r.src, r.dst) for r in vectors.pair_edges(df, 0.6).collect()} == {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.6}
    mean = vectors.centroids(df.withColumn("g", F.lit(1)), "g").first().centroid
    assert np.allclose(mean, v.astype(float).mean(axis=0))


def test_evidence_skips_come_before_the_cap(spark):
    near = [1.0, 0.05]
    seg = [(i, "p" if i < 3 else f"q{i}", None, f"https://www.reuters.com/{i}" if i == 9 else f"https://s.test/{min(i, 5)}", "same text" if i in (5, 6) else f"text {i}", [1.0, 0.01 * i]) for i in range(12)]
    segments = spark.createDataFrame(seg, "segment_id long, publisher string, category string, url string, text string, embedding array<double>")
    claims = spark.createDataFrame([(1, "p", "a claim", near)], "claim_id long, publisher string, text string, embedding array<double>")
    out = evidence.gather(claims, segments).collect()
    assert len(out) <= 5 and not {r.segment_id for r in out} & {0, 1, 2} and not {5, 6} <= {r.segment_id for r in out}
    assert {r.tier for r in out if r.segment_id == 9} <= {"T2"} and all(r.is_independent is False for r in out if r.sim >= 0.92)


def test_entities_and_keys(spark):
    rows = [(1, "U.S.", 0), (1, "America", 1), (1, "NATO", 2), (1, "x", 3), (1, "Zed", 4), (1, "abc", 5)]
    top = events.top_entities(spark.createDataFrame(rows, "document_id int, name string, position int"), 3).first().entities
    assert top == ["nato", "united states", "zed"]  # by number, then first seen; stored in alphabetical order


def test_crosswalk_and_resolution(spark):
    docs = [(1, "2024-01-02 00:00:00", [1.0, 0.0], ["a", "b"], "US", "WAR"), (2, "2024-01-20 00:00:00", [1.0, 0.0], ["a", "b"], "US", "WAR"), (3, "2024-01-02 00:00:00", [0.0, 1.0], ["c"], "US", "WAR")]
    d = spark.createDataFrame(docs, "doc_id long, at string, vec array<double>, entities array<string>, geo string, event_type string").withColumn("at", F.to_timestamp("at"))
    e = spark.createDataFrame([(7, "2024-01-01 06:00:00", [1.0, 0.1], ["a"], "US", "WAR", "k")], "event_id long, bucket string, vec array<double>, entities array<string>, geo string, event_type string, event_key string").withColumn("bucket", F.to_timestamp("bucket"))
    assert [(r.doc_id, r.event_id) for r in events.crosswalk(d, e).collect()] == [(1, 7)]
    how = {r.doc_id: r.how for r in events.resolve(d.withColumn("published_at", F.col("at")), e).collect()}
    assert how == {1: "crosswalk", 2: "new", 3: "new"}


def test_greedy_clusters(spark):
    s = np.zeros((6, 6))
    for a, b, x in ((0, 1, 0.9), (0, 2, 0.8), (1, 2, 0.9), (2, 3, 0.7), (0, 3, 0.65), (1, 3, 0.7), (3, 4, 0.6)):
        s[a, b] = s[b, a] = x
    got = events.greedy_clusters(list(range(10, 16)), s)
    assert sorted(g[1] for g in got) == [10, 11, 12, 13] and len({g[0] for g in got}) == 1
    rows = spark.createDataFrame([(i, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)], "doc_id long, at long, vec array<double>")
    out = events.story_clusters(rows).collect()
    assert all(r.score == pytest.approx(1.0) for r in out) and max(sum(1 for q in out if q.cluster == c) for c in {r.cluster for r in out}) == 15


def test_story_clusters_take_whole_vectors_in_their_window(spark):
    import numpy as np

    from factloom.plans.vectors import cluster_greedy

    segments = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [2.0, 2.0]), (1, 3, [9.0, 0.0]), (2, 0, None), (2, 2, [1.0, 1.0])]
    got = events.document_vectors(spark.createDataFrame(segments, "document_id long, position_index int, embedding array<double>")).collect()
    assert {r.document_id: r.vec for r in got} == {1: [1.0, 1.0], 2: [1.0, 1.0]}
    rows = spark.createDataFrame([(i, 100 + i * 86_400, [1.0, 0.0]) for i in range(6)], "doc_id long, at long, vec array<double>")
    assert sorted(r.doc_id for r in events.story_clusters(rows).collect()) == [2, 3, 4, 5]
    sf = "/root/testdata/sf0.001"
    e = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None]
    last = max(r.vec_id for r in e)
    e = sorted((r for r in e if r.vec_id >= last - 144), key=lambda r: -r.vec_id)[:200]
    v = np.array([r.embedding for r in e], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = events.greedy_clusters([r.vec_id for r in e], np.round(u @ u.T, 9))
    assert sorted((r.cluster, r.doc_id) for r in cluster_greedy(spark, sf).collect()) == sorted((c, i) for c, i, _ in want)


def test_tables(spark):
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string"), spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "k int, v int, x string")
    assert sorted((r.k, r.x) for r in tables.upsert(old, new, ["k"], F.col("v")).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.k, r.x) for r in tables.insert_if_absent(old, new, "k").collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(r.x for r in tables.replace_groups(old, new, "k").collect()) == ["a", "c", "d"]
    child = spark.createDataFrame([(10, 1), (11, 2)], "c int, k int")
    grand = spark.createDataFrame([(100, 10), (101, 11)], "g int, c int")
    left = tables.cascade(old.where("k = 1").select("k"), [(child, "c", "k"), (grand, "g", "c")])
    assert [r.c for r in left[0].collect()] == [11] and [r.g for r in left[1].collect()] == [101]
    docs = spark.createDataFrame([(1, "s", 0.5, 0.5, "aggregated", 2), (2, None, None, None, "pending", 1), (3, "s", 0.1, 0.1, "aggregated", 3)], "id int, strip string, grounding_score double, integrity_score double, pipeline_status string, created_at int")
    claims = spark.createDataFrame([(1, "SUPPORTED"), (3, "MIXED")], "document_id int, veracity_label string")
    d, c, report = tables.rescore_reset(docs, claims, 1)
    assert {r.id: (r.strip, r.pipeline_status) for r in d.collect()} == {1: (None, "verifying"), 2: (None, "pending"), 3: ("s", "aggregated")}
    assert {r.document_id: r.veracity_label for r in c.collect()} == {1: None, 3: "MIXED"} and tuple(report.first()) == (1, 1, True, False)


def test_overwrite_of_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "p int, x string"), path, "p")
    tables.overwrite(spark.createDataFrame([(2, "c")], "p int, x string"), path, "p")
    assert sorted((r.p, r.x) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_feed_rows_and_seed(spark):
    schema = "id int, url string, source_category string, polling_interval_minutes int, is_active boolean"
    feeds = tables.feed_insert(spark.createDataFrame([(1, "a", "fringe", 5, True)], schema), spark.createDataFrame([(2, "a", None, None, None), (3, "b", None, None, None)], schema))
    assert sorted(map(tuple, feeds.collect())) == [(1, "a", "fringe", 5, True), (3, "b", "mainstream", 15, True)]
    assert tables.feed_update(feeds, 3, {"is_active": False}).where("not is_active").count() == 1 and tables.feed_delete(feeds, 1).count() == 1
    from factloom.operators import ideology

    assert ideology.seed_bank(spark).count() == 50


def test_flow_scores_lie_in_their_range(spark):
    from factloom.plans.flow import score_documents

    text = " ".join(f"statement number {i} about the same thing was made in town yesterday by many people." for i in range(12))
    docs = spark.createDataFrame([(str(i), f"p{i}", "mainstream", f"https://s{i}.test", text + f" {i}") for i in range(5)] + [("9", "p", "x", "u", None)], "doc_id string, publisher string, category string, url string, text string")
    out = score_documents(docs).collect()
    assert {r.document_id for r in out} == set("01234")
    assert all(0 <= x <= 1 for r in out for x in (r.grounding_score, r.integrity_score, r.one_sidedness) if x is not None)


def test_document_stories_equal_brute_force(spark):
    """Chunks, embeddings, means of the first three segments and greedy clusters, each by plain Python."""
    import hashlib
    import math
    import re

    import numpy as np

    from factloom.plans.vectors import document_stories

    sf = "/root/testdata/sf0.001"

    def chunks(text):
        out = []
        for paragraph in re.split(r"\n\s*\n", text.strip()):
            held = []
            size = lambda parts: sum(math.ceil(len(p.split()) * 1.33) for p in parts)
            for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", paragraph)):
                if not s:
                    continue
                if held and size(held) >= 80 and size([*held, s]) > 200:
                    out.append(held)
                    held = []
                held = [*held, s]
            if held and size(held) < 50 and out and size(out[-1]) < 180:
                out[-1] = out[-1] + held
            elif held:
                out.append(held)
        return [" ".join(p) for p in out if size(p) >= 30] if out else []

    def vector(text):
        v = np.zeros(64)
        for w in text.lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            v[h % 64] += 1 if h >> 16 & 1 else -1
        return v / np.linalg.norm(v)

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    last = max(r.doc_id for r in docs)
    first = {r.doc_id: chunks(r.text or "")[:3] for r in docs if r.doc_id >= last - 144}
    mean = {i: np.mean([vector(t) for t in texts], axis=0) for i, texts in first.items() if texts}
    ids = sorted(mean, reverse=True)[:200]
    unit = np.array([mean[i] / np.linalg.norm(mean[i]) for i in ids])
    sim = np.round(unit @ unit.T, 9)
    place, free, want = {i: n for n, i in enumerate(ids)}, set(ids), []
    near = {i: [j for j in ids if j != i and sim[place[i], place[j]] >= 0.6] for i in ids}
    for seed in sorted(ids, key=lambda i: (-len(near[i]), i)):
        members = [seed]
        for c in sorted((j for j in near[seed] if j in free), key=lambda j: (-sim[place[seed], place[j]], j)) if seed in free else ():
            if len(members) < 15 and sum(c in near[m] for m in members) / len(members) >= 0.35:
                members.append(c)
        if len(members) >= 2:
            free -= set(members)
            want.append(sorted(members))
    got = {}
    for r in document_stories(spark, sf).collect():
        got.setdefault(r.cluster, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(want) and len(want) > 3
