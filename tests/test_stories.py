"""Story clusters of every window, against the greedy order one seed after another."""

import numpy as np

from factloom.operators import stories
from factloom.operators.events import greedy_clusters


def test_equals_the_greedy_order(spark, monkeypatch):
    monkeypatch.setattr(stories, "STEP", 5)
    monkeypatch.setattr(stories, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for window, n in ((3, 60), (4, 45), (7, 3), (8, 1)):
        centres = rng.normal(size=(max(1, n // 12), 6))
        v = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 6)) * 0.55
        v[: n // 3] = v[0]  # a hot vector: more copies than a cluster may hold
        ids = rng.permutation(1000)[:n].tolist()
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        for number, i, score in greedy_clusters(ids, np.round(u @ u.T, 9)):
            want.add((window, number, i, round(score, 6)))
        rows += [(window, i, x) for i, x in zip(ids, v.tolist(), strict=True)]
    rows += [(3, 5000, None), (None, 5001, [1.0] * 6)]
    got = stories.window_clusters(spark.createDataFrame(rows, "window long, id long, vec array<double>").repartition(3)).collect()
    groups = lambda found: {(w, frozenset((i, s) for a, b, i, s in found if (a, b) == (w, c))) for w, c, _, _ in found}
    assert groups({(r.window, r.cluster, r.doc_id, round(r.score, 6)) for r in got}) == groups(want)
    assert len(want) > 60 and all(r.cluster in {x.doc_id for x in got if x.cluster == r.cluster} for r in got)


def test_without_links(spark):
    one = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "window long, id long, vec array<double>")
    assert stories.window_clusters(one).collect() == [] and stories.window_clusters(one.where("false")).collect() == []


def test_windows_of_one_task_need_no_rounds(spark, monkeypatch):
    """Before, every window went through rounds of jobs over all windows. Both ways give the same clusters."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 6))
    v = centres[rng.integers(0, 9, 300)] + rng.normal(size=(300, 6)) * 0.5
    docs = spark.createDataFrame([(i % 4, i, x) for i, x in enumerate(v.tolist())], "window long, id long, vec array<double>")
    key = lambda rows: sorted((r.window, r.cluster, r.doc_id, round(r.score, 6)) for r in rows)
    in_rounds = key(stories._in_rounds(docs).collect())
    monkeypatch.setattr(stories, "links", None)
    assert key(stories.window_clusters(docs).collect()) == in_rounds and len(in_rounds) > 50
