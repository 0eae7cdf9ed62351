"""From raw documents to token ids: toxic documents go, one of each group of near duplicates stays, secrets are masked,
sources are mixed to their target weights, texts become SentencePiece ids.

Each stage reads the Parquet that the one before wrote in the session's shared folder; what a stage has read is removed once
its own output is written, the rest when Python ends.

Defined results, for every stage: an empty table gives an empty table; null ids, null, empty and very long texts, repeated rows
and extra columns of any name are kept as they are but for what the stage decides; all stages but the last return the columns
they get, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import cube_mixing, secret_scan, sentencepiece_scan, simhash_dedup, toxicity
from factloom.llm.common import prepare, table
from factloom.session import remove, scratch_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic. Null and empty texts stay unless most examples are toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-equal fingerprints: the smallest id's, null ids last. Texts without words are one component."""
    return simhash_dedup.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret, plain or encoded, and n_chars counted anew; null texts stay null."""
    return secret_scan.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, none to three times; a null source is a source, rows without words are taken by number."""
    return cube_mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip, ids) of each row; null and empty texts have no tokens."""
    return sentencepiece_scan.encode(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("sentencepiece", encode)]

#: SQL can't express the nearest-neighbour votes, the recursive decoding, the balanced draws or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; the rows of the last one."""
    prepare(spark)
    folder = scratch_folder(spark, "pipeline")  # what is left in it goes when Python ends
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:  # read no more
            remove(spark, last)
        last = path
    return docs
