"""Cosine joins whose blocks are pruned, against all pairs."""

import numpy as np
import pytest

from factloom.operators import vectors as V


def clustered(n, clusters, spread, seed=3, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    v = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * spread
    v[:20] = v[0]  # copies
    v[20] = 0
    return v


@pytest.fixture(scope="module")
def table(spark):
    v = clustered(3000, 24, 0.2)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (None, v[0].tolist())]
    u = np.divide(v, np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=np.linalg.norm(v, axis=1, keepdims=True) > 0)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), np.round(u @ u.T, 9)


def test_pairs_equal_all_pairs_and_few_blocks_meet(table, monkeypatch):
    monkeypatch.setattr(V, "_block_size", lambda n, cores: 64)
    df, sim = table
    for least in (0.8, 0.95):
        got = {(r.src, r.dst) for r in V.pair_edges(df, least).collect()}
        i, j = np.nonzero(np.triu(sim >= least, 1))
        assert got == set(zip(i.tolist(), j.tolist(), strict=True))
    blocks, _, met = V.meeting_blocks(df, df, 0.95)
    assert met.count() < 0.2 * blocks.select("block").distinct().count() ** 2
    assert V.meeting_blocks(df, df, -0.1)[2].count() == blocks.select("block").distinct().count() ** 2


def test_neighbours_equal_all_pairs(table, monkeypatch):
    monkeypatch.setattr(V, "_block_size", lambda n, cores: 64)
    df, sim = table
    for above in (0.7, -0.2):
        got = sorted((r.left_id, r.right_id, r.rank) for r in V.knn_join(df.where("vec_id % 10 = 0"), df, 3, above).collect())
        want = []
        for i in range(0, 3000, 10):
            near = sorted((-s, j) for j, s in enumerate(sim[i].tolist()) if j != i and s > above)[:3]
            want += [(i, j, n + 1) for n, (_, j) in enumerate(near)]
        assert got == sorted(want)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert V.pair_edges(none, 0.5).collect() == [] and V.knn_join(one, none, 2, 0.1).collect() == [] and V.knn_join(none, one, 2, 0.1).collect() == []


def test_neighbours_of_many_copies_repeated_ids_and_odd_numbers(monkeypatch):
    monkeypatch.setattr(V, "_ROWS", 7)
    monkeypatch.setattr(V, "_COLUMNS", 32)
    monkeypatch.setattr(V, "_PAIRS", 16)
    v = clustered(300, 3, 0.3, dims=8)
    v[100:220] = v[100]
    v[250] = np.nan
    u = np.divide(v, np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=np.linalg.norm(v, axis=1, keepdims=True) != 0)
    ids = np.random.default_rng(2).permutation(300) // 2  # every id twice
    sim = np.round(u @ u.T, 9)
    for k, above, own in ((4, 0.3, True), (1, -0.5, False), (200, 0.9, True)):
        p, q, s = V.nearest(ids, u, ids, u, k, above, own)
        got = sorted(zip(p.tolist(), q.tolist(), s.tolist(), strict=True))
        want, fewest = [], []
        for i in range(300):
            near = sorted((-x, j) for j, x in zip(ids.tolist(), sim[i].tolist(), strict=True) if x > above and not (own and j == ids[i]))
            want += [(ids[i], j, -x) for x, j in near[:k]]
        if k < 200:  # of equal rows the k + 1 smallest ids are kept, each with all its rows
            assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=2e-9)
        else:
            assert len(got) == len(want)


def test_a_row_is_dealt_by_groups_not_by_blocks(table, monkeypatch):
    """Each row goes to one task for each group of blocks of the other side; before, for each of its blocks."""
    monkeypatch.setattr(V, "_block_size", lambda n, cores: 64)
    df, _ = table
    (a, of_a, n), _, pivots = V._both(df, df, "vec_id", "vec_id", "embedding")
    ours = V._grouped(of_a, n, 4)
    groups = len(set(ours["of"].to_pylist()))
    assert len(ours) > 40 and groups <= 4
    assert V._dealt(a, ours, ours, np.arccos(np.clip(pivots @ pivots.T, -1, 1)), -0.1, ("g", "h")).count() == n * groups


def test_single_precision_stays_so_in_shuffles(table):
    """Vectors of single precision travel as such, before in twice the bytes; those of double precision keep it."""
    df, _ = table
    for kind in ("float", "double"):
        vectors = df.select("vec_id", df["embedding"].cast(f"array<{kind}>").alias("embedding"))
        (a, of_a, n), _, pivots = V._both(vectors, vectors, "vec_id", "vec_id", "embedding")
        ours = V._grouped(of_a, n, 4)
        dealt = V._dealt(a, ours, ours, np.arccos(np.clip(pivots @ pivots.T, -1, 1)), -0.1, ("g", "h"))
        assert dealt.schema["embedding"].dataType.simpleString() == f"array<{kind}>"


def test_exact_cosines_are_few_a_row(monkeypatch):
    """Single precision keeps little more than k a row; before, some dozens a row were worked out exactly."""
    rng, asked = np.random.default_rng(5), []
    exact = V.exact_cosines
    monkeypatch.setattr(V, "exact_cosines", lambda u, v, row, col: asked.append(len(row)) or exact(u, v, row, col))
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(600, 32)), rng.normal(size=(20011, 32))))
    ids = rng.permutation(20011)
    p, q, s = V.nearest(np.arange(600), u, ids, v, 8, 0.25, True)
    assert sum(asked) < 10 * 600
    sim = np.round(u @ v.T, 9)
    sim[np.arange(600), np.argsort(ids)[:600]] = -1
    near = np.argsort(-sim, axis=1)[:, :8]
    assert sorted(zip(p.tolist(), q.tolist(), strict=True)) == sorted((i, int(ids[j])) for i in range(600) for j in near[i]) and s.min() > 0.25


def test_as_many_tasks_as_groups_meet(table):
    """Meetings are spread over as many tasks; before, over the session's partitions, some of which had most."""
    df, _ = table
    plan = V.knn_join(df, df, 3, -0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
