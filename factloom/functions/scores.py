"""Scores, Column to Column. S, C, M, U: supported, contradicted, mixed and unknown counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import constants as K


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def percent(part: Column, whole: Column) -> Column:
    return F.floor(100 * part / F.nullif(whole, F.lit(0)) + 0.5)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def grounding(s: Column, c: Column, m: Column, total: Column) -> Column:
    return F.when(total > 0, (s + c + m) / total).otherwise(F.lit(0.0))


def integrity(s: Column, c: Column, m: Column, u: Column) -> Column:
    raw = (s - K.INTEGRITY_CONTRADICT * c + K.INTEGRITY_MIXED * m) / F.greatest(s + c + m + u, F.lit(K.MIN_SCORED))
    return clamp((raw + K.INTEGRITY_CONTRADICT) / (1 + K.INTEGRITY_CONTRADICT))


def sourcing(counts: dict[str, Column]) -> Column:
    """counts by tier; other names weigh like T5."""
    n = sum(counts.values(), F.lit(0))
    mean = sum((c * K.TIER_WEIGHT.get(t, 0.2) for t, c in counts.items()), F.lit(0.0)) / F.nullif(n, F.lit(0))
    return F.coalesce(F.when(n < K.MIN_EVIDENCE, mean * n / K.MIN_EVIDENCE).otherwise(mean), F.lit(0.0))


def one_sidedness(opinion: Column, sentiment: Column, factual: Column) -> Column:
    return clamp(0.40 * opinion + 0.35 * F.abs(sentiment) + 0.25 * F.abs(opinion - factual))


def factuality(contradiction: Column, sourced: Column, grounded: Column, one_sided: Column) -> Column:
    return clamp(0.40 * (1 - contradiction) + 0.25 * sourced + 0.25 * grounded + 0.10 * (1 - one_sided))


def contradiction_rate(s: Column, c: Column, m: Column) -> Column:
    return F.coalesce(c / F.nullif(s + c + m, F.lit(0)), F.lit(0.0))


def score_badge(x: Column) -> Column:
    return F.when(x >= 0.8, "high").when(x >= 0.6, "good").when(x >= 0.4, "mixed").otherwise("low")


def sentiment_badge(x: Column) -> Column:
    return F.when(x > 0.05, "positive").when(x < -0.05, "negative").otherwise("neutral")


def ideology_badge(x: Column) -> Column:
    """Positive reads as right, whatever the scale's own sign says."""
    side = F.when(x > 0, "right").otherwise("left")
    return F.when(F.abs(x) < 2, "center").when(F.abs(x) < 5, F.concat(F.lit("lean "), side)).otherwise(side)


def bucket_6h(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 21600) * 21600)


def iso_bucket(ts: Column) -> Column:
    return F.date_format(bucket_6h(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def event_key(kind: Column, place: Column, ts: Column, entities: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind, place, iso_bucket(ts), F.array_join(F.array_sort(entities), ",")), 256)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length; 0 for other lengths and for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def crosswalk(sim: Column, entity_jaccard: Column, same_geo: Column, kind: Column, other_kind: Column) -> Column:
    """How well a document fits a known event."""
    kinds = F.when(kind == other_kind, 1.0).when((kind != "OTHER") & (other_kind != "OTHER"), 0.5).otherwise(0.0)
    return K.EVENT_SIM * sim + K.EVENT_JACCARD * entity_jaccard + K.EVENT_GEO * same_geo.cast("double") + K.EVENT_TYPE * kinds


def map_ability(votes: Column) -> Column:
    """Maximum a posteriori ability of votes array<struct(b double, y double, n long)>, y the sum of n votes of difficulty b,
    unit normal prior: struct(theta, h, iterations) after up to ten capped Newton steps. h belongs to the theta before the last step."""

    def step(state: Column, _: Column) -> Column:
        p = lambda v: 1 / (1 + F.exp(-(state["theta"] - v["b"])))
        g = F.aggregate(votes, F.lit(0.0), lambda s, v: s + v["y"] - v["n"] * p(v)) - state["theta"]
        h = F.aggregate(votes, F.lit(0.0), lambda s, v: s - v["n"] * p(v) * (1 - p(v))) - 1.0
        delta = F.greatest(F.lit(-K.IRT_MAX_STEP), F.least(F.lit(K.IRT_MAX_STEP), g / F.least(h, F.lit(K.IRT_FLOOR))))
        moved = F.struct((state["theta"] - delta).alias("theta"), h.alias("h"), (state["iterations"] + 1).alias("iterations"), (F.abs(delta) < K.IRT_TOL).alias("done"))
        return F.when(state["done"], state).otherwise(moved)

    start = F.struct(F.lit(0.0).alias("theta"), F.lit(0.0).alias("h"), F.lit(0).alias("iterations"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(K.IRT_STEPS)), start, step)


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def sparkline(values: Column) -> Column:
    """Array of values on a scale of 0 to 1, by their own range (at least .1); null under two values."""
    low, high = F.array_min(values), F.array_max(values)
    spread = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(0.1))
    return F.when(F.size(values) >= 2, F.transform(values, lambda v: (v - low) / spread))


def same_periods(grounding_a: Column, grounding_b: Column, integrity_a: Column, integrity_b: Column, n_a: Column, n_b: Column) -> Column:
    """Whether the longer period says nothing that the shorter one doesn't."""
    return grounding_a.eqNullSafe(grounding_b) & integrity_a.eqNullSafe(integrity_b) & n_a.eqNullSafe(n_b)


def category_rank(category: Column) -> Column:
    return F.when(category == "mainstream", 0).when(category == "partisan", 1).when(category == "fringe", 2).when(category == "reference", 3).otherwise(4)
