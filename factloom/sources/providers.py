"""Model steps as providers: deterministic stand-ins, and validators of what a model returns. The stand-ins claim no accuracy."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import constants as C
from factloom.functions import text as T
from factloom.session import ship

CLASSES = ("FACTUAL_CLAIM", "OPINION_ANALYSIS", "CONTEXT", "OTHER")
NLI = ("ENTAILMENT", "CONTRADICTION", "NEUTRAL")


@lru_cache(1 << 16)
def _place(word: str, dims: int) -> int:
    """The place that a word adds 1 to, or, from dims on, takes 1 from."""
    h = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4], "big")
    return h % dims + (0 if h >> 16 & 1 else dims)


def hashed_vectors(texts: list[str], dims: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length of hashed words, each of which adds +1 or -1 to one place; and which texts have any length."""
    places = [[_place(w, dims) for w in t.lower().split()] for t in texts]
    at = np.repeat(np.arange(len(texts)) * 2 * dims, [len(row) for row in places]) + np.array([x for row in places for x in row], np.int64)
    n = np.bincount(at, minlength=2 * dims * len(texts)).reshape(-1, 2, dims)
    v = (n[:, 0] - n[:, 1]).astype(float)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))  # whole numbers: exact in any order
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0), norm[:, 0] > 0


def hashed_vector(text: str, dims: int = 64) -> list[float] | None:
    """Unit vector of hashed words. Null for texts without words."""
    v, some = hashed_vectors([text], dims)
    return v[0].tolist() if some[0] else None


def with_embedding(rows: DataFrame, text: str, dims: int = 64, out: str = "embedding") -> DataFrame:
    ship(rows.sparkSession)
    names, at = rows.columns, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, some = hashed_vectors([x or "" for x in batch.column(at).to_pylist()], dims)
            ends = pa.array(np.append(0, np.cumsum(some) * dims), pa.int32(), mask=np.append(~some, False))  # a null has no values
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(v[some].ravel()))], [*names, out])

    return rows.mapInArrow(run, rows.withColumn(out, F.lit(None).cast("array<double>")).schema)


def stub_class(text: Column) -> Column:
    """Stand-in for the classifier."""
    return F.when(text.rlike(r"[!?]"), "OPINION_ANALYSIS").when(F.length(text) < 120, "CONTEXT").otherwise("FACTUAL_CLAIM")


def stub_nli(claim: Column, evidence: Column, overlap: Column | None = None) -> Column:
    """Stand-in for the inference model: by shared words, which may have been counted before, and a hash."""
    side = F.pmod(F.xxhash64(claim, evidence), F.lit(10))

    def judged(shared: Column) -> Column:
        return F.struct(F.when(shared < 0.05, "NEUTRAL").when(side < 6, "ENTAILMENT").otherwise("CONTRADICTION").alias("label"), F.least(F.lit(1.0), 0.5 + shared).alias("confidence"))

    return T.once(T.word_jaccard(claim, evidence) if overlap is None else overlap, judged)


def with_model(rows: DataFrame, call: Callable[[list[str]], list[str | None]], text: str, out: str) -> DataFrame:
    """rows with the answers of a provider, called once a batch; a failed batch gives nulls."""
    ship(rows.sparkSession)
    names, at = rows.columns, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                answers = call([x or "" for x in batch.column(at).to_pylist()])
            except (RuntimeError, OSError, ValueError):
                answers = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], [*names, out])

    return rows.mapInArrow(run, rows.withColumn(out, F.lit(None).cast("string")).schema)


def _echo(texts: list[str]) -> list[str]:
    """Stand-in for models that write: the first sentence."""
    return [t.split(".")[0] for t in texts]


def _named(answer: str) -> Callable[[list[str]], list[str]]:
    return lambda texts: [answer] * len(texts)


@dataclass(frozen=True)
class Provider:
    """A model by its key: the stage that asks it, the version of its prompt, and what answers a batch of texts."""

    key: str
    stage: str
    call: Callable[[list[str]], list[str | None]]
    version: int = 1


_PROVIDERS = (
    Provider("normalizer", "NORMALIZE", _echo), Provider("classifier", "CLASSIFY", _named('{"classification":"CONTEXT"}')), Provider("extractor", "EXTRACT", _named("[]")),
    Provider("veracity-nli", "VERACITY", _named('{"label":"NEUTRAL","confidence":0.5}')), Provider("veracity-web", "VERACITY", _named("[]")), Provider("sentiment", "SENTIMENT", _named("0")),
    Provider("synthesis", "SYNTHESIS", _echo), Provider("feed-description", "COLLECT", _echo), Provider("story-clusterer", "CLUSTER", _echo), Provider("stance", "IDEOLOGY", _named("[]")),
    Provider("event-classifier", "ENRICH", _named("OTHER")),
)
#: Every model that a stage asks; `registered` puts another in a stand-in's place.
REGISTRY = {p.key: p for p in _PROVIDERS}


def registered(provider: Provider) -> None:
    """From now on this provider answers for its key."""
    REGISTRY[provider.key] = provider


def ask(rows: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """rows with the answers of the registered model."""
    return with_model(rows, REGISTRY[key].call, text, out)


def missing_embeddings(segments: DataFrame, n: int = 500) -> DataFrame:
    """The next segments without a vector, oldest first."""
    return segments.where("embedding is null").orderBy("id").limit(min(n, 500))


def valid_class(json: Column) -> Column:
    """classification of a model's answer: unknown names are OTHER; sarcasm or a rhetorical device make it an opinion."""

    def judged(x: Column) -> Column:
        name = T.once(F.upper(x["classification"]), lambda n: F.when(n.isin(*CLASSES), n).otherwise("OTHER"))
        return F.when(F.coalesce(x["sarcasm"], F.lit(False)) | F.coalesce(x["rhetorical"], F.lit(False)), "OPINION_ANALYSIS").otherwise(name)

    return T.once(F.from_json(T.clean_json(json), "classification string, sarcasm boolean, rhetorical boolean"), judged)


def valid_event_type(answer: Column) -> Column:
    """One of the twenty event types; whatever else is said, and nothing, is OTHER."""
    name = F.regexp_replace(F.upper(T.trimmed(answer)), r"[ -]+", "_")
    return F.when(name.isin(*C.EVENT_TYPES), name).otherwise("OTHER")


def initial_label(classification: Column) -> Column:
    return F.when(classification == "OPINION_ANALYSIS", "OPINION").when(classification == "CONTEXT", "NEUTRAL").when(classification == "OTHER", "OTHER")


def valid_claims(json: Column) -> Column:
    """Claims of over ten characters; their type is always DIRECT."""
    claims = F.from_json(T.clean_json(json), "array<struct<claim_text:string,is_checkable:boolean>>")
    made = F.transform(claims, lambda c: F.struct(T.trimmed(c["claim_text"]).alias("claim_text"), F.coalesce(c["is_checkable"], F.lit(True)).alias("is_checkable"), F.lit("DIRECT").alias("claim_type")))
    return F.filter(made, lambda c: F.length(c["claim_text"]) > 10)


def valid_nli(json: Column) -> Column:
    def judged(x: Column) -> Column:
        label = F.when(F.upper(x["label"]).isin(*NLI), F.upper(x["label"])).otherwise("NEUTRAL")
        conf = F.coalesce(F.nullif(x["confidence"], F.lit(0.0)), F.lit(0.5))
        return F.struct(label.alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"))

    return T.once(F.from_json(T.clean_json(json), "label string, confidence double"), judged)


def web_sources(json: Column, n: int = 5) -> Column:
    """Up to five sources of distinct URLs; a stance becomes an NLI label."""

    def source(r: Column) -> Column:
        label = F.when(F.lower(r["stance"]).isin("supports", "support"), "ENTAILMENT").when(F.lower(r["stance"]).isin("contradicts", "contradict"), "CONTRADICTION").otherwise("NEUTRAL")
        return F.struct(r["url"].alias("url"), label.alias("nli_label"), T.web_tier(r["url"]).alias("tier"), r["quote"].alias("quote"))

    def kept(rows: Column) -> Column:
        urls = F.transform(rows, lambda r: r["url"])
        first = T.once(urls, lambda us: F.filter(rows, lambda r, i: (F.coalesce(r["url"], F.lit("")) != "") & (F.array_position(us, r["url"]) == i + 1)))
        return F.transform(F.slice(first, 1, n), source)

    return T.once(F.from_json(T.clean_json(json), "array<struct<url:string,stance:string,quote:string>>"), kept)


def prompt(sections: list[str], values: dict[str, str]) -> str:
    """Sections in order; {{NAME}} is replaced where a value is known and stays otherwise."""
    out = "\n\n".join(s for s in sections if s)
    for name, value in values.items():
        out = out.replace("{{" + name + "}}", value)
    return out


def prompt_column(sections: list[str], values: dict[str, Column]) -> Column:
    """prompt() for each row: the values are columns."""
    out = F.lit("\n\n".join(s for s in sections if s))
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out
