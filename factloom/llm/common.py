"""Shared plumbing of the training-data operators: tables, checkpoints, Arrow maps, label samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import checkpoint_folder, checkpointed, ship, table  # noqa: F401  table is for the operators' queries

#: Arrow batches sent to Python hold at most this many rows and bytes, so one batch of long texts stays small.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches, by rows and bytes, and make sure that checkpoint() has a folder that all executors reach.
    The bounds stay for later queries of the session: Spark reads them when a query runs, not when it is made."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    checkpoint_folder(spark)
    return spark


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; survives the loss of executors."""
    prepare(df.sparkSession)
    return checkpointed(df)


def map_arrow(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run per_batch on each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = per_batch(batch)
            if out is not None and out.num_rows:
                yield out

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, at_most: int, train: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, text, y) of at most `at_most` labelled rows, those whose hashed ids are smallest: a bounded sample that
    depends on neither partitioning nor order. A document with several labels takes the largest, an id with several texts the
    smallest; null labels and ids are none."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if train is not None:
        rows = rows.where(train(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(rows), "doc_id")  # at_most rows bound what is broadcast
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
