"""Vector queries over `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import scores as S
from factloom.functions import text as T
from factloom.operators import arrivals, chunking, events, evidence, ideology, stories
from factloom.operators import vectors as V
from factloom.plans.registry import query
from factloom.session import scratch_table, table
from factloom.sources import providers

_E = "e as (select vec_id, list_transform(embedding, lambda x: x::double) as v, label from embeddings)"


@query(f"with {_E}, q as (select v as qv from e where vec_id = 0) select vec_id, round(list_cosine_similarity(v, qv), 6) as sim from e, q where vec_id <> 0 and list_cosine_similarity(v, qv) > 0.0 order by round(list_cosine_similarity(v, qv), 9) desc, vec_id limit 10")
def knn(spark: SparkSession, d: str) -> DataFrame:
    """One vector's ten nearest: a scan beside one row, and a top-k. Without that vector there are none."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    rows = e.where("vec_id <> 0 and embedding is not null").join(F.broadcast(q)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 9).alias("s")).where("s > 0")  # one row
    return rows.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("sim"))


@query(f"""with {_E}, p as (select a.vec_id as left_id, b.vec_id as right_id, round(list_cosine_similarity(a.v, b.v), 9) as sim from e a join e b on a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by left_id order by sim desc, right_id) as rank from p where sim > {K.EVIDENCE_SIM})
 select left_id, right_id, round(sim, 6) as sim, rank::int as rank from r where rank <= {K.EVIDENCE_FETCH}""")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.knn_join(e, e, K.EVIDENCE_FETCH, K.EVIDENCE_SIM).select("left_id", "right_id", F.round("sim", 6).alias("sim"), "rank")


@query(f"with {_E} select a.vec_id as src, b.vec_id as dst, round(list_cosine_similarity(a.v, b.v), 6) as sim from e a join e b on a.vec_id < b.vec_id where round(list_cosine_similarity(a.v, b.v), 9) >= 0.45")
def pair_edges(spark: SparkSession, d: str) -> DataFrame:
    return V.pair_edges(table(spark, d, "embeddings"), 0.45).select("src", "dst", F.round("sim", 6).alias("sim"))


@query("with x as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings where label is not null) select label, (i - 1)::int as place, round(avg(x), 6) as mean from x group by label, i")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    c = V.centroids(table(spark, d, "embeddings").where("label is not null"), "label")
    return c.select("label", F.posexplode("centroid").alias("place", "mean")).select("label", "place", F.round("mean", 6).alias("mean"))


@query()
def cluster_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Of the newest 200 vectors within 72 hours, half an hour apart by id; each is the one segment of its document."""
    e = table(spark, d, "embeddings")
    vecs = events.document_vectors(e.select(F.col("vec_id").alias("document_id"), F.lit(0).alias("position_index"), "embedding"))
    return events.story_clusters(vecs.select(F.col("document_id").alias("doc_id"), F.timestamp_seconds(1_700_000_000 + F.col("document_id") * 1800).alias("at"), "vec"))


@query()
def document_stories(spark: SparkSession, d: str) -> DataFrame:
    """Stories among the newest documents of 72 hours, half an hour apart by id: mean vectors of their first three segments."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 1800).alias("at"))
    newest = docs.agg(F.max("at").alias("last"))
    recent = docs.join(F.broadcast(newest)).where(F.col("at") >= F.col("last") - F.expr(f"interval {K.CLUSTER_HOURS} hours")).drop("last")  # one row
    vecs = events.document_vectors(providers.with_embedding(chunking.segments(recent), "text_content"))
    return events.story_clusters(recent.select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "at").join(vecs, "document_id"))


@query()
def story_windows(spark: SparkSession, d: str) -> DataFrame:
    """Stories of every window of 72 hours, of all its documents, half an hour apart by id: mean vectors of their first three segments."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    vecs = events.document_vectors(providers.with_embedding(chunking.segments(docs), "text_content"))
    window = F.floor((1_700_000_000 + F.col("doc_id") * 1800) / (K.CLUSTER_HOURS * 3600))
    rows = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("id"), window.alias("window")).join(vecs, "document_id")
    return stories.window_clusters(scratch_table(rows.select("window", "id", "vec"), "stories")).withColumn("score", F.round("score", 6))


@query(f"""with {_E}, c as (select vec_id, v, (vec_id % 9)::varchar as publisher, 'https://a.test/' || (vec_id % 50) as url, 'statement ' || label || ' number ' || (vec_id % 50) as text, list_distinct(['statement', label::varchar, 'number', (vec_id % 50)::varchar]) as words from e),
 p as (select a.vec_id as claim_id, b.vec_id as segment_id, round(list_cosine_similarity(a.v, b.v), 9) as sim, a.publisher as own, b.publisher, b.url, b.text, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) as overlap from c a join c b on true),
 r as (select *, row_number() over (partition by claim_id order by sim desc, segment_id) as rank from p where sim > {K.EVIDENCE_SIM}),
 f as (select *, row_number() over (partition by claim_id, url, text order by rank) as nth from r where rank <= {K.EVIDENCE_FETCH} and own <> publisher),
 t as (select *, row_number() over (partition by claim_id order by sim desc, segment_id) as n from f where nth = 1)
 select claim_id, segment_id, round(sim, 6) as sim, publisher, 'mainstream' as category, url, text as evidence_text, overlap < {K.NEAR_DUPLICATE} and sim < {K.NEAR_DUPLICATE} as is_independent, 'T4' as tier from t where n <= {K.EVIDENCE_KEEP}""")
def evidence_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Claims of one half of the vectors, segments of all; texts by label."""
    e = table(spark, d, "embeddings")
    name = F.concat(F.lit("statement "), F.col("label").cast("string"), F.lit(" number "), (F.col("vec_id") % 50).cast("string"))
    segments = e.select(F.col("vec_id").alias("segment_id"), (F.col("vec_id") % 9).cast("string").alias("publisher"), F.lit("mainstream").alias("category"), F.concat(F.lit("https://a.test/"), (F.col("vec_id") % 50).cast("string")).alias("url"), name.alias("text"), "embedding")
    claims = e.select((F.col("vec_id")).alias("claim_id"), (F.col("vec_id") % 9).cast("string").alias("publisher"), name.alias("text"), "embedding")
    return evidence.gather(claims, segments).drop("overlap").withColumn("sim", F.round("sim", 6))


_CROSSWALK = f"""d as (select vec_id, v, 1700000000 + vec_id * 1800 as at, list_distinct([label::varchar, (vec_id % 3)::varchar]) as names, case when label % 2 = 0 then 'POLICY' else 'OTHER' end as kind from e where v is not null),
 p as (select a.vec_id as doc_id, b.vec_id as event_id, round(list_cosine_similarity(a.v, b.v), 9) as sim, len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names))) as overlap, a.kind = b.kind as same
  from d a join d b on a.vec_id <> b.vec_id and abs(a.at - b.at // 21600 * 21600) <= {K.EVENT_HOURS * 3600}),
 n as (select *, row_number() over (partition by doc_id order by sim desc, event_id) as near from p where sim > {K.EVENT_KNN_SIM}),
 s as (select *, {K.EVENT_SIM} * sim + {K.EVENT_JACCARD} * overlap + {K.EVENT_GEO} + case when same then {K.EVENT_TYPE} else 0 end as score from n where near <= {K.EVENT_KNN}),
 b as (select *, row_number() over (partition by doc_id order by score desc, sim desc, event_id) as best from s),
 found as (select doc_id, event_id, score from b where best = 1 and score >= {K.EVENT_ACCEPT} and overlap >= {K.EVENT_MIN_JACCARD})"""


def _documents_and_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every vector is a document and a known event, half an hour apart by id."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    at = F.timestamp_seconds(1_700_000_000 + F.col("vec_id") * 1800)
    common = [F.array(F.col("label").cast("string"), (F.col("vec_id") % 3).cast("string")).alias("entities"), F.lit("US").alias("geo"), F.when(F.col("label") % 2 == 0, "POLICY").otherwise("OTHER").alias("event_type"), F.col("embedding").alias("vec")]
    return e.select(F.col("vec_id").alias("doc_id"), at.alias("at"), at.alias("published_at"), *common), e.select(F.col("vec_id").alias("event_id"), S.bucket_6h(at).alias("bucket"), at.alias("published_at"), *common)


@query(f"with {_E}, {_CROSSWALK} select doc_id, event_id, round(score, 6) as score from found")
def event_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """The best known event of each document, its own id aside."""
    docs, known = _documents_and_events(spark, d)
    return events.crosswalk(docs, known, exclude_equal=True).withColumn("score", F.round("score", 6))


_KEY = "sha256(d.kind || '|US|' || strftime(make_timestamp((d.at // 21600 * 21600 * 1000000)::bigint), '%Y-%m-%dT%H:%M:%S.000Z') || '|' || array_to_string(list_sort([label::varchar, (vec_id % 3)::varchar]), ','))"


@query(f"""with {_E}, {_CROSSWALK}, k as (select d.vec_id, {_KEY.replace("label", "e.label").replace("vec_id", "d.vec_id")} as key from d join e on e.vec_id = d.vec_id), x as (select key, min(vec_id) as exact from k where vec_id % 4 > 0 group by key)
 select k.vec_id as doc_id, coalesce(exact::varchar, f.event_id::varchar, k.key) as event_id, case when exact is not null then 'exact' when f.event_id is not null then 'crosswalk' else 'new' end as how
 from k left join x using (key) left join (select doc_id, event_id from found) f on f.doc_id = k.vec_id""")
def event_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Documents to events: by key where a known event has it (those of every fourth vector have none), else by crosswalk, else new."""
    docs, known = _documents_and_events(spark, d)
    keyed = events.keyed(known).withColumn("event_key", F.when(F.col("event_id") % 4 > 0, F.col("event_key")))
    return events.resolve(docs, keyed, exclude_equal=True)


@query()
def event_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The same documents, in the order of their arrival and without a known event: each meets what those before it made."""
    docs, _ = _documents_and_events(spark, d)
    found, after = arrivals.resolve_arrivals(docs)
    return found.join(after.select("event_id", "n"), "event_id").select("doc_id", "event_id", "how", F.col("n").alias("documents"))


_MEANS = "m as (select label, i, avg(x) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e where label is not null) group by label, i), bank as (select label as prop, list(x order by i) as pv from m group by label)"
_TOPICS = ("Immigration", "Tax", "Regulation", "Abortion", "Police")


@query(f"""with {_E}, {_MEANS}, s as (select vec_id, vec_id // 10 as doc, vec_id % 10 as pos, v, ['immigration', 'fiscal_policy', 'regulation', 'social_policy', 'criminal_justice'][vec_id % 5 + 1] as mine, (vec_id % 7)::varchar as word from e where v is not null and vec_id % 11 > 0),
 p as (select vec_id, doc, pos, prop, round(list_cosine_similarity(v, pv), 9) as sim, mine <> ['immigration', 'fiscal_policy', 'regulation', 'social_policy', 'criminal_justice'][prop % 5 + 1] as other, word = (prop % 7)::varchar as hit from s, bank),
 a as (select *, round(sim - case when other then {K.CROSS_DOMAIN} else 0 end + case when hit then {K.KEYWORD_BOOST} else 0 end, 9) as adjusted from p),
 t as (select *, row_number() over (partition by vec_id order by adjusted desc, prop) as n from a where adjusted >= case when hit then {K.PROP_SIM_KEYWORD} else {K.PROP_SIM_PLAIN} end),
 b as (select doc, vec_id, pos, max(adjusted) as best from t where n <= {K.PROP_TOP} group by all), c as (select *, row_number() over (partition by doc order by floor(best * 1000) desc, pos, vec_id) as n from b)
 select t.doc as document_id, t.vec_id as segment_id, t.prop as proposition_id, round(t.sim, 6) as sim, round(t.adjusted, 6) as adjusted from t join c using (vec_id) where t.n <= {K.PROP_TOP} and c.n <= {K.PROP_SEGMENTS}""")
def small_side_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Segments against a bank of propositions: the mean vectors of the labels. Ten segments a document; every eleventh is too short."""
    e = table(spark, d, "embeddings")
    i = F.col("vec_id")
    names = F.array(*map(F.lit, _TOPICS))
    text = F.concat(F.lit("it is "), (i % 7).cast("string"), F.lit(" or so"))
    segments = e.select((F.floor(i / 10)).alias("document_id"), i.alias("segment_id"), (i % 10).alias("position_index"), text.alias("text"), F.when(i % 11 > 0, 20).otherwise(19).alias("token_count"), F.element_at(names, (i % 5 + 1).cast("int")).alias("classification"), "embedding")
    bank = V.centroids(e.where("label is not null"), "label")
    p = F.col("label")
    domains = F.transform(names, lambda n: T.policy_domain(n))
    bank = bank.select(p.alias("proposition_id"), F.element_at(domains, p % 5 + 1).alias("domain"), F.array(F.concat(F.lit("is_not "), (p % 7).cast("string"))).alias("keywords"), F.col("centroid").alias("embedding"))
    return ideology.match_propositions(segments, bank).withColumns({"sim": F.round("sim", 6), "adjusted": F.round("adjusted", 6)})
