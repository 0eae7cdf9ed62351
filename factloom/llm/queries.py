"""Queries of the training-data operators: opN_<name>(spark, sf_dir), production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import cube_mixing, fill_in_middle, quality_qda, quality_rules, secret_scan, sentencepiece_scan, simhash_dedup, target_encoding, topk_search, toxicity, url_filter, warc, wu_manber
from factloom.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, base verdict and the forest's verdict of every document; texts without words fail the base rules."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score, verdict and nearest labelled examples of every document; texts without known terms score as a vote of 0."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of plain secrets, and spans of plain and encoded ones, of every document; none in null texts."""
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words share fingerprint zero."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; without "://" host and path are empty and no rule fits."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids, their number and digest, whether they spell the text, and the digest of the text decoded from them, of every
    document; none for empty texts."""
    decoded = sentencepiece_scan.decode(sentencepiece_scan.encode(table(spark, sf_dir, "documents")))
    return decoded.withColumn("decoded_sha256", F.sha2("text", 256)).drop("text")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and verdict of every document; texts without words are scored as such."""
    return quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document; null sources come last, texts without words take nothing."""
    return cube_mixing.choose(table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other rows for every twentieth id; vectors with null or non-finite parts take no part."""
    return topk_search.top_of_every(table(spark, sf_dir, "embeddings"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's not-modified answer, resolved to the response that it stands for; pages without an address have none."""
    return warc.page_revisits(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form, cuts and digests of every document's rearranged text; null texts are empty and plain."""
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History counts and rates of item, vendor and client of every sale's lines; lines without a sale or time are dropped."""
    return target_encoding.encode(*(table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


def op13_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of benchmark items cover, and which items; texts without words have none."""
    return wu_manber.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (op1_quality_rules, op2_toxicity, op3_secret_scan, op4_simhash_dedup, op5_url_filter, op6_sentencepiece, op7_quality_classifier, op8_cube_mixing, op9_topk_search, op10_warc_revisits, op11_fill_in_middle, op12_target_encoding, op13_wu_manber)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op5_url_filter": url_filter.oracle(), "op9_topk_search": topk_search.ORACLE, "op10_warc_revisits": warc.ORACLE, "op11_fill_in_middle": fill_in_middle.ORACLE, "op12_target_encoding": target_encoding.ORACLE, "op13_wu_manber": wu_manber.ORACLE}
