"""Documents to segments: greedy packing of sentences, paragraph by paragraph."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import text as T
from factloom.session import ship

_SENTENCE, _PARAGRAPH = re.compile(r"(?<=[.!?])\s+"), re.compile(r"\n\s*\n")


def tokens(text: str) -> int:
    return math.ceil(len(text.split()) * K.TOKENS_A_WORD)


def chunk(text: str) -> list[tuple[str, int]]:
    """(text, tokens) of the segments. A short rest of a paragraph joins the last segment if that has room."""
    out: list[list] = []
    for paragraph in _PARAGRAPH.split(text):
        held, size = [], 0
        for s in filter(None, map(str.strip, _SENTENCE.split(paragraph))):
            n = tokens(s)
            if size + n > K.CHUNK_MAX and size >= K.CHUNK_MIN_FLUSH:
                out.append([" ".join(held), size])
                held, size = [], 0
            held.append(s)
            size += n
        if not held:
            continue
        if size < K.CHUNK_SMALL and out and out[-1][1] < K.CHUNK_JOIN_BELOW:
            out[-1] = [out[-1][0] + " " + " ".join(held), out[-1][1] + size]
        else:
            out.append([" ".join(held), size])
    return [(t, n) for t, n in out if n >= K.CHUNK_DROP]


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(document_id, position_index, text_content, token_count, watermarked_text) of cleaned texts; null texts have none."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, t, n) for i, x in zip(*map(pa.Array.to_pylist, batch.columns), strict=True) for k, (t, n) in enumerate(chunk(x or ""))]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(4)], ["document_id", "position_index", "text_content", "token_count"])

    made = docs.select(F.col(id_col).cast("string").alias("document_id"), T.clean_content(F.col(text_col)).alias("t")).mapInArrow(run, "document_id string, position_index int, text_content string, token_count int")
    mark = T.watermark_hash(F.col("document_id"), F.col("position_index"), F.col("text_content"))
    return made.withColumn("watermarked_text", F.concat("text_content", F.lit("\n\n<!-- corpus-watermark:"), mark, F.lit("-->")))
