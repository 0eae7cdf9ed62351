"""Evidence of claims: neighbours, same-publisher skip, first of equal texts, independence, tier, cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import text as T
from factloom.operators.vectors import knn_join


def gather(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """claims (claim_id, publisher, text, embedding), segments (segment_id, publisher, category, url, text, embedding), ids long.
    Up to EVIDENCE_KEEP rows a claim, by falling similarity, with the overlap of words; the skips come before the cap."""
    near = knn_join(claims, segments, K.EVIDENCE_FETCH, K.EVIDENCE_SIM, left_id="claim_id", right_id="segment_id", exclude_equal=False)
    rows = near.select(F.col("left_id").alias("claim_id"), F.col("right_id").alias("segment_id"), "sim", "rank")
    rows = rows.join(claims.select("claim_id", F.col("publisher").alias("own"), F.col("text").alias("claim_text")), "claim_id")
    url, text = F.col("url"), F.col("text")  # what depends on the segment alone is worked out once a segment
    found = segments.select("segment_id", "publisher", "category", "url", text.alias("evidence_text"), F.sha2(T.canonical_key(url, text), 256).alias("key"), T.evidence_tier(url, F.col("category")).alias("tier"))
    rows = rows.join(found, "segment_id").where(~F.coalesce(F.col("own") == F.col("publisher"), F.lit(False)))
    rows = first_wins(rows, ["claim_id", "key"], "rank")
    rows = top_k(rows, ["claim_id"], [F.desc("sim"), F.col("segment_id")], K.EVIDENCE_KEEP)
    rows = rows.withColumn("overlap", T.word_jaccard(F.col("claim_text"), F.col("evidence_text")))
    rows = rows.withColumn("is_independent", (F.col("overlap") < K.NEAR_DUPLICATE) & (F.col("sim") < K.NEAR_DUPLICATE))
    return rows.select("segment_id", "claim_id", "sim", "publisher", "category", "url", "evidence_text", "is_independent", "tier", "overlap")


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(by)).where(F.col("_nth") <= k).drop("_nth")
