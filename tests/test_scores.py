"""Scores: contract table and hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from factloom.functions import scores as S
from factloom.operators import ideology

#: S, C, M, U, total, grounding, integrity
CONTRACT = [(2, 2, 0, 0, 4, 1, 0.5), (1, 1, 0, 0, 2, 1, 0.515), (2, 0, 0, 4, 8, 0.25, 0.697), (0, 0, 0, 5, 5, 0, 0.545), (0, 3, 0, 0, 3, 1, 0), (3, 0, 0, 0, 3, 1, 1)]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_contract_table(spark):
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in CONTRACT], "s double, c double, m double, u double, t double, g double, i double")
    s, c, m, u, t = (F.col(x) for x in "scmut")
    for r in df.select(S.round3(S.grounding(s, c, m, t)).alias("g0"), S.round3(S.integrity(s, c, m, u)).alias("i0"), "g", "i").collect():
        assert (r.g0, r.i0) == (pytest.approx(r.g), pytest.approx(r.i))


@pytest.mark.parametrize(("counts", "want"), [({"T1": 5}, 1.0), ({"T1": 2, "T4": 1}, 0.817), ({"T1": 1}, 0.333), ({}, 0.0), ({"T9": 3}, 0.2)])
def test_sourcing(spark, counts, want):
    assert one(spark, S.round3(S.sourcing({t: F.lit(n) for t, n in counts.items()})).alias("x")).x == pytest.approx(want)


@pytest.mark.parametrize(("args", "want"), [((0.5, 0, 0.5), 0.2), ((0, 0, 0), 0), ((1, 1, 0), 1), ((0.5, -0.3, 0.5), 0.305)])
def test_one_sidedness(spark, args, want):
    assert one(spark, S.one_sidedness(*(F.lit(float(a)) for a in args)).alias("x")).x == pytest.approx(want)


@pytest.mark.parametrize(("args", "want"), [((0, 1, 1, 0), 1), ((1, 0, 0, 1), 0), ((1, 0.5, 0.5, 0.5), 0.3)])
def test_factuality(spark, args, want):
    assert one(spark, S.factuality(*(F.lit(float(a)) for a in args)).alias("x")).x == pytest.approx(want)


def test_rounding_goes_up_at_half(spark):
    r = one(spark, S.round3(F.lit(-0.0025)).alias("a"), S.round3(F.lit(0.0025)).alias("b"))
    assert (r.a, r.b) == (-0.002, 0.003)


def test_badges_cosine_and_buckets(spark):
    r = one(
        spark, S.ideology_badge(F.lit(3.0)).alias("a"), S.ideology_badge(F.lit(-6.0)).alias("b"), S.score_badge(F.lit(0.6)).alias("c"), S.sentiment_badge(F.lit(-0.1)).alias("d"),
        S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("e"), S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("f"),
        S.iso_bucket(F.lit("2024-05-01 13:59:59").cast("timestamp")).alias("g"), S.crosswalk(F.lit(1.0), F.lit(1.0), F.lit(True), F.lit("A"), F.lit("OTHER")).alias("h"),
    )
    assert (r.a, r.b, r.c, r.d, r.f, r.g) == ("lean right", "left", "good", "negative", 0.0, "2024-05-01T12:00:00.000Z")
    assert r.e == pytest.approx(math.sqrt(0.5)) and r.h == pytest.approx(0.95)


def newton(votes):
    theta = h = 0.0
    for _ in range(10):
        p = [1 / (1 + math.exp(-(theta - b))) for _, b in votes]
        g = sum(y - q for (y, _), q in zip(votes, p, strict=True)) - theta
        h = -sum(q * (1 - q) for q in p) - 1
        d = max(-2.0, min(2.0, g / min(h, -0.01)))
        theta -= d
        if abs(d) < 0.001:
            break
    return theta, h


def test_ability_equals_plain_newton(spark):
    sets = {1: [(1.0, 0.0), (1.0, 0.0), (0.0, 0.0)], 2: [(1.0, -2.0)] * 9, 3: [(0.0, 1.5), (1.0, -0.5)], 4: [(1.0, 0.0)]}
    rows = [(k, n, y, b) for k, v in sets.items() for n, (y, b) in enumerate(v)]
    out = {r.document_id: r for r in ideology.estimate(spark.createDataFrame(rows, "document_id int, proposition_id int, y double, b double")).collect()}
    for k in (1, 2, 3):
        theta, h = newton(sets[k])
        assert out[k].theta_raw == pytest.approx(theta, abs=6e-5) and out[k].score == pytest.approx(math.tanh(theta / 2), abs=6e-5) and out[k].se == pytest.approx(math.sqrt(-1 / min(h, -0.01)), abs=6e-5)
    assert out[1].theta_raw == pytest.approx(0.2865, abs=1e-4) and out[4].score is None


def test_domain_cap(spark):
    rows = [(1, i, "a" if i < 8 else "b", float(i % 3)) for i in range(10)] + [(2, i, None, 0.5) for i in range(4)]
    out = ideology.cap_domains(spark.createDataFrame(rows, "document_id int, idx int, domain string, confidence double")).collect()
    kept = sorted(r.idx for r in out if r.document_id == 1)
    assert kept == [2, 4, 5, 7, 8, 9] and sum(r.document_id == 2 for r in out) == 4


def test_stances_and_axes(spark):
    bank = spark.createDataFrame([("p", "labor", True, 0.0), ("q", "immigration", False, 0.0)], "proposition_id string, domain string, liberal_is_pro boolean, difficulty_b double")
    s = spark.createDataFrame([("p", "PRO", 0.9, True), ("p", "PRO", 0.4, True), ("q", "ANTI", 0.8, True), ("q", "ANTI", 0.8, False), ("z", "PRO", 0.9, True), ("p", "ANTI", 0.2, True)], "proposition_id string, stance string, confidence double, quote_ok boolean")
    used = ideology.usable_stances(s, bank).select("proposition_id", ideology.vote(F.col("stance"), F.col("liberal_is_pro")).alias("y")).collect()
    assert sorted((r.proposition_id, r.y) for r in used) == [("p", 1.0), ("q", 1.0)]
    votes = spark.createDataFrame([(1, "a", "labor", 1.0, 0.0), (1, "b", "fiscal_policy", 1.0, 0.0), (1, "c", "immigration", 0.0, 0.0)], "document_id int, proposition_id string, domain string, y double, b double")
    r = ideology.axes(votes).first()
    assert r.economic > 0 and r.social == pytest.approx(math.floor(r.score * 1000 + 0.5) / 100)
