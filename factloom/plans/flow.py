"""Documents to scores, stage after stage, each DataFrame to DataFrame.

The order is fixed: evidence before verdicts, sentiment before aggregation, so no stage sees what another has not written yet.
Model steps are stand-ins; pass other functions for real ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import scores as S
from factloom.functions import text as T
from factloom.operators import chunking, evidence, veracity
from factloom.plans.registry import query
from factloom.session import checkpointed, table
from factloom.sources import providers


def score_documents(docs: DataFrame, classify=providers.stub_class, infer=None) -> DataFrame:
    """docs (doc_id string, publisher, category, url, text) to one row a document that has segments: strip counts and scores. The stand-in
    for inference goes by the overlap of words that evidence comes with."""
    segs = providers.with_embedding(chunking.segments(docs), "text_content")
    segs = segs.withColumn("segment_id", F.xxhash64("document_id", "position_index")).withColumn("classification", classify(F.col("text_content")))
    segs = segs.join(docs.select(F.col("doc_id").alias("document_id"), "publisher", "category", "url"), "document_id")
    segs = segs.withColumn("sentiment", (F.size(F.split("text_content", "!")) - 1) / F.size(T.words(F.col("text_content"))))
    segs = checkpointed(segs)  # chunked and embedded once; five branches go on from here
    corpus = segs.select("segment_id", "publisher", "category", "url", F.col("watermarked_text").alias("text"), "embedding")
    claims = segs.where("classification = 'FACTUAL_CLAIM'").select(F.col("segment_id").alias("claim_id"), "publisher", F.col("text_content").alias("text"), "embedding")
    asked = claims.select("claim_id", F.col("text").alias("claim_text"), T.claim_risk(F.col("text")).alias("risk"), T.is_attribution(F.col("text")).alias("is_attribution"))
    found = evidence.gather(claims, corpus).join(checkpointed(asked), "claim_id")  # patterns are sought once a claim, not once a piece of evidence
    pair = F.col("claim_text"), F.col("evidence_text")
    found = found.withColumn("nli", infer(*pair) if infer else providers.stub_nli(*pair, F.col("overlap"))).withColumns({"nli_label": F.col("nli.label"), "nli_confidence": F.col("nli.confidence")})
    found = checkpointed(veracity.gated(found).select("claim_id", "nli_label", "nli_confidence", "is_independent", "tier", "risk", "is_attribution"))  # judged once a row: the sums below name the labels many times
    tiers = tuple(F.count_if(F.col("tier") == t).alias(t) for t in K.TIER_WEIGHT)
    judged = veracity.verdicts(found, also=tiers).select(F.col("claim_id").alias("segment_id"), "label", "confidence", *K.TIER_WEIGHT)
    checked = claims.select(F.col("claim_id").alias("segment_id")).join(judged, "segment_id", "left").withColumn("label", F.coalesce("label", F.lit("UNKNOWN")))
    verdict = veracity.segment_labels(checked, also=tuple(F.sum(t).alias(t) for t in K.TIER_WEIGHT))
    rows = segs.join(verdict, "segment_id", "left").withColumn("label", F.coalesce("label", providers.initial_label(F.col("classification")), F.lit("OTHER")))
    is_ = lambda *x: F.count_if(F.col("label").isin(*x))
    g = rows.groupBy("document_id").agg(
        is_("SUPPORTED").alias("s"), is_("CONTRADICTED").alias("c"), is_("MIXED").alias("m"), is_("UNKNOWN").alias("u"), is_("OTHER", "OPINION", "NOT_CHECKABLE", "NEUTRAL").alias("excluded"), F.count("*").alias("n"),
        (F.count_if(F.col("classification") == "OPINION_ANALYSIS") / F.count("*")).alias("opinion"), (F.count_if(F.col("classification") == "FACTUAL_CLAIM") / F.count("*")).alias("fact"), F.avg(F.coalesce("sentiment", F.lit(0.0))).alias("mood"),
        *(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in K.TIER_WEIGHT),
    )
    s, c, m, u = (F.col(x) for x in "scmu")
    counts = {t: F.col(t) for t in K.TIER_WEIGHT}
    g = g.withColumns({"grounding_score": S.round3(S.grounding(s, c, m, F.col("n") - F.col("excluded"))), "integrity_score": S.round3(S.integrity(s, c, m, u)), "one_sidedness": S.round3(S.one_sidedness(F.col("opinion"), F.col("mood"), F.col("fact"))), "sourcing_quality": F.when(sum(counts.values(), F.lit(0)) > 0, S.round3(S.sourcing(counts)))})
    return g.select("document_id", F.col("n").alias("segments"), s, c, m, u, "grounding_score", "integrity_score", "sourcing_quality", "one_sidedness", S.round3(S.factuality(S.contradiction_rate(s, c, m), F.col("sourcing_quality"), F.col("grounding_score"), F.col("one_sidedness"))).alias("factuality_score"))


@query()
def news_flow(spark: SparkSession, d: str) -> DataFrame:
    """The whole flow over conversation turns as documents."""
    turns = table(spark, d, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return score_documents(turns.select(key.alias("doc_id"), F.col("role").alias("publisher"), F.lit("mainstream").alias("category"), F.concat(F.lit("https://site.test/"), key).alias("url"), "text"))
