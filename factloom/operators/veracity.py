"""Verdicts of claims from labelled evidence, and labels of segments from verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import text as T


def scope_fails(claim: Column, evidence: Column, sim: Column) -> Column:
    """Whether evidence is about something else; its reason, null where it isn't."""
    overlap = T.jaccard(T.scope_tokens(claim), T.scope_tokens(evidence))
    close = F.coalesce(sim, F.lit(0.0)) >= K.SCOPE_SIM
    too_far = lambda o: (
        F.when(o < K.SCOPE_JACCARD, "LOW_PROPOSITION_OVERLAP")
        .when((o < K.SCOPE_LEGAL) & T.is_legal(claim), "LEGAL_CLAIM_SCOPE_MISMATCH")
        .when((o < K.SCOPE_EVENT) & T.is_event(claim), "GEOPOLITICAL_EVENT_SCOPE_MISMATCH")
    )
    return F.when(close, None).otherwise(T.once(overlap, too_far))


def gated(evidence: DataFrame) -> DataFrame:
    """evidence with (nli_label, nli_confidence) after the scope gate on independent rows that entail or contradict. Needs
    claim_text, evidence_text, sim, is_independent. A confidence of 0 counts as 0.5."""
    conf = F.coalesce(F.nullif("nli_confidence", F.lit(0.0)), F.lit(0.5))
    fails = F.coalesce("is_independent", F.lit(True)) & F.col("nli_label").isin("ENTAILMENT", "CONTRADICTION") & scope_fails(F.col("claim_text"), F.col("evidence_text"), F.col("sim")).isNotNull()
    both = T.once(fails, lambda f: F.struct(F.when(f, F.least(conf, F.lit(K.SCOPE_FAIL_CAP))).otherwise(conf).alias("conf"), F.when(f, "NEUTRAL").otherwise(F.col("nli_label")).alias("label")))
    return evidence.withColumn("_gate", both).withColumns({"nli_confidence": F.col("_gate.conf"), "nli_label": F.col("_gate.label")}).drop("_gate")


def verdicts(evidence: DataFrame, key: str = "claim_id", also: tuple[Column, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """One verdict a claim, and named aggregates to carry along, from gated rows (nli_label, nli_confidence, is_independent, tier, risk, is_attribution). The risk
    gate comes first, then fusion, then attribution protection and the cap for low tiers. Where an order is named, a claim's confidences are added in it, one
    after another by one task that holds none of them, so that means do not depend on partitions."""
    if order:
        evidence = evidence.repartition(key).sortWithinPartitions(key, *order)
    free = F.coalesce("is_independent", F.lit(True))
    mean = lambda label: F.avg(F.when(free & (F.col("nli_label") == label), F.col("nli_confidence")))
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for t in range(1, 6) for x in (f"T{t}", t))), F.col("tier")), F.lit(5))
    labelled = F.col("nli_label").isNotNull()
    rows = evidence.groupBy(key).agg(
        F.count_if(labelled).alias("n"), F.count_if(labelled & free).alias("free"), F.min(F.when(labelled, rank)).alias("best"),
        mean("ENTAILMENT").alias("s"), mean("CONTRADICTION").alias("c"), mean("NEUTRAL").alias("neutral"),
        F.max("risk").alias("risk"), F.bool_or("is_attribution").alias("is_attribution"), F.struct(F.lit(0).alias("_"), *also).alias("also"),
    )
    return rows.select(key, *fused(), "also").select(key, "v.*", "also.*").drop("_")


def fused() -> list[Column]:
    """struct v(label, confidence, reason) over columns n, free, best, s, c, neutral, risk, is_attribution."""
    out = lambda label, conf, reason: F.struct(F.lit(label).alias("label"), conf.cast("double").alias("confidence"), F.lit(reason).cast("string").alias("reason"))
    n, free, best, s, c, neutral = (F.col(x) for x in ("n", "free", "best", "s", "c", "neutral"))
    told = F.coalesce("is_attribution", F.lit(False))
    both, apart = s.isNotNull() & c.isNotNull(), F.abs(s - c)
    weak = F.greatest(s, c, neutral)
    support = F.when(best >= K.LOW_TIER_RANK, F.least(s, F.lit(K.LOW_TIER_CAP))).otherwise(s)
    against = F.when(told, out("UNKNOWN", c, "PRIMARY_SOURCE_NOT_RETRIEVED")).otherwise(out("CONTRADICTED", c, None))
    v = (
        F.when((n == 0) & told, out("UNKNOWN", F.lit(0.5), "PRIMARY_SOURCE_NOT_RETRIEVED"))
        .when(n == 0, out("UNKNOWN", F.lit(0.5), "NO_RELEVANT_EVIDENCE"))
        .when((F.col("risk") == "CRITICAL") & (best > K.CRITICAL_RANK), out("UNKNOWN", F.lit(K.CRITICAL_CONF), "INSUFFICIENT_TIER_FOR_RISK"))
        .when((F.col("risk") == "HIGH") & (best > K.HIGH_RANK), out("UNKNOWN", F.lit(K.HIGH_CONF), "INSUFFICIENT_TIER_FOR_RISK"))
        .when(free == 0, out("UNKNOWN", F.lit(0.3), "CIRCULAR_ONLY"))
        .when(both & (F.least(s, c) >= K.MIXED_MIN) & (apart <= K.MIXED_DELTA), out("MIXED", F.greatest(s, c), "EVIDENCE_CONFLICT"))
        .when(both & (s >= c) & (s >= K.SUPPORT_MIN), out("SUPPORTED", support, None))
        .when(both & (c > s) & (c >= K.CONTRADICT_MIN), against)
        .when(both, out("UNKNOWN", weak, "WEAK_CONFLICT"))
        .when(c.isNotNull() & (c < K.CONTRADICT_MIN), out("UNKNOWN", c, "WEAK_CONTRADICTION"))
        .when(c.isNotNull(), against)
        .when(s.isNotNull() & (s < K.SUPPORT_MIN), out("UNKNOWN", s, "WEAK_SUPPORT"))
        .when(s.isNotNull(), out("SUPPORTED", support, None))
        .otherwise(out("UNKNOWN", F.coalesce(neutral, F.lit(0.5)), "NEUTRAL_ONLY"))
    )
    return [v.alias("v")]


def segment_labels(claims: DataFrame, key: str = "segment_id", also: tuple[Column, ...] = ()) -> DataFrame:
    """Label of each segment from its claims (label, confidence). One MIXED claim nets to UNKNOWN; only UNKNOWN claims make
    NOT_CHECKABLE."""
    w = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))
    is_ = lambda x: F.col("label") == x
    total = lambda *pairs: F.sum(sum((F.when(is_(x), w * f).otherwise(0.0) for x, f in pairs), F.lit(0.0)))
    rows = claims.groupBy(key).agg(
        total(("SUPPORTED", K.VOTE_SUPPORT), ("MIXED", K.VOTE_MIXED)).alias("pos"), total(("CONTRADICTED", K.VOTE_CONTRADICT), ("MIXED", K.VOTE_MIXED)).alias("neg"),
        F.count_if(F.col("label").isin("SUPPORTED", "CONTRADICTED", "MIXED")).alias("judged"), F.struct(F.lit(0).alias("_"), *also).alias("also"),
    )
    net = F.round(F.col("pos") - F.col("neg"), 9)
    label = F.when(F.col("judged") == 0, "NOT_CHECKABLE").when((F.col("pos") >= K.MIXED_MASS) & (F.col("neg") >= K.MIXED_MASS), "MIXED").when(net >= K.VOTE_CUT, "SUPPORTED").when(net <= -K.VOTE_CUT, "CONTRADICTED").otherwise("UNKNOWN")
    return rows.select(key, label.alias("label"), "also.*").drop("_")


def sentiment_means(rows: DataFrame, key: str, sentiment: str) -> DataFrame:
    """(key, one mean a component) of a struct column: rows without it don't count, a component that is missing counts as 0."""
    parts = rows.schema[sentiment].dataType.names
    return rows.where(F.col(sentiment).isNotNull()).groupBy(key).agg(*((F.floor(F.avg(F.coalesce(F.col(f"{sentiment}.{p}"), F.lit(0.0))) * 1000 + 0.5) / 1000).alias(p) for p in parts))
