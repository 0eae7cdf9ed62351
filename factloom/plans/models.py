"""What models are asked and answer, and what is made of stances, votes and means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import scores as S
from factloom.functions import text as T
from factloom.operators import events, ideology, veracity
from factloom.plans.inputs import _pick, _picked, _text
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources import providers


@query("""with w as (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '')) as w from benchmark), h as (select item_id, ('0x' || substr(md5(w), 1, 8))::bigint as h from w),
 p as (select item_id, h % 64 as place, sum(case when (h >> 16) & 1 = 1 then 1.0 else -1.0 end) as x from h group by all), n as (select item_id, sqrt(sum(x * x)) as n from p group by item_id)
 select item_id, place::int as place, round(x / n, 6) as x from p join n using (item_id) where x <> 0""")
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in for an embedding model, by places that are not zero."""
    rows = providers.with_embedding(table(spark, d, "benchmark").select("item_id", "text"), "text")
    return rows.select("item_id", F.posexplode("embedding").alias("place", "x")).where("x <> 0").withColumn("x", F.round("x", 6))


@query("select vec_id as id from embeddings where vec_id % 3 = 0 order by id limit 100")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The next hundred to embed, where every third vector is not there yet."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    return providers.missing_embeddings(e, 100).select("id")


_MODELS = ", ".join(f"('{p.key}', {p.version}, '{p.stage}')" for p in providers.REGISTRY.values())


@query(f"select key, version, stage, (select count(*) from benchmark) as answers from (values {_MODELS}) t(key, version, stage)")
def registered_models(spark: SparkSession, d: str) -> DataFrame:
    """Every registered model asked about every item by its stand-in."""
    b = table(spark, d, "benchmark").select(F.lit(1).alias("one"), "text")
    asked = [providers.ask(b, p.key, "text", "answer").agg(F.count("answer").alias("answers")).select(F.lit(p.key).alias("key"), F.lit(p.version).alias("version"), F.lit(p.stage).alias("stage"), "answers") for p in providers.REGISTRY.values()]
    out = asked[0]
    for more in asked[1:]:
        out = out.unionAll(more)
    return out


@query("select item_id, 'You judge claims.' || chr(10) || chr(10) || 'Text ' || item_id || ': ' || text || ' {{LATER}}' as prompt from benchmark")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Sections in order, empty ones left out; names without a value stay."""
    b = table(spark, d, "benchmark")
    made = providers.prompt_column(["You judge claims.", "", "Text {{ID}}: {{TEXT}} {{LATER}}"], {"ID": F.col("item_id").cast("string"), "TEXT": F.col("text")})
    return b.select("item_id", made.alias("prompt"))


_ANSWERS = ['```json\n{"classification":"context"}\n```', '{"classification":"FACTUAL_CLAIM","sarcasm":true}', '{"classification":"factual_claim"}', '{"classification":"poem"}', "rubbish", '{"classification":"OTHER","rhetorical":true}', '{"classification":"opinion_analysis","sarcasm":false}']
_CLASSES = ["CONTEXT", "OPINION_ANALYSIS", "FACTUAL_CLAIM", "OTHER", "OTHER", "OPINION_ANALYSIS", "OPINION_ANALYSIS"]
_LABELS = ["NEUTRAL", "OPINION", None, "OTHER", "OTHER", "OPINION", "OPINION"]
_NLI = ['{"label":"entailment","confidence":0.9}', '```\n{"label":"CONTRADICTION","confidence":7}\n```', '{"label":"maybe"}', '{"label":"neutral","confidence":0}', "nothing", '{"label":"Contradiction","confidence":-2}']
_NLI_LABELS, _NLI_CONF = ["ENTAILMENT", "CONTRADICTION", "NEUTRAL", "NEUTRAL", "NEUTRAL", "CONTRADICTION"], ["0.9", "1.0", "0.5", "0.5", "0.5", "0.0"]
_CLAIMS = ['[{"claim_text":" short "},{"claim_text":"  a claim of some length "}]', '[{"claim_text":"exactly 10"},{"claim_text":"exactly 11.","is_checkable":false}]', "[]", '```json\n[{"claim_text":"fenced but long enough"}]\n```']
_CLAIM_TEXTS = ["a claim of some length:true:DIRECT", "exactly 11.:false:DIRECT", "", "fenced but long enough:true:DIRECT"]
_WEB = ['[{"url":"https://apnews.com/1","stance":"supports"},{"url":"https://apnews.com/1","stance":"contradicts"},{"url":""},{"url":"https://x.test/","stance":"Contradicts"}]',
        "[" + ",".join(f'{{"url":"https://u{n}.gov.test/","stance":"neutral"}}' for n in range(7)) + "]", '[{"url":"https://www.who.int/a","stance":"support"}]']
_WEB_SEEN = ["https://apnews.com/1=ENTAILMENT=T2,https://x.test/=CONTRADICTION=T4", ",".join(f"https://u{n}.gov.test/=NEUTRAL=T4" for n in range(5)), "https://www.who.int/a=ENTAILMENT=T1"]


@query(f"""select event_id, {_picked("event_id", _CLASSES)} as class, {_picked("event_id", _LABELS)} as label, {_picked("event_id", _NLI_LABELS)} as nli, cast({_picked("event_id", _NLI_CONF)} as double) as confidence,
 {_picked("event_id", _CLAIM_TEXTS)} as claims, {_picked("event_id", _WEB_SEEN)} as web from events""")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """What the validators make of answers: wrong names, fences, confidences out of bounds, short claims, repeated addresses."""
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", _pick(i, _ANSWERS).alias("a"), _pick(i, _NLI).alias("n"), _pick(i, _CLAIMS).alias("c"), _pick(i, _WEB).alias("w"))
    joined = lambda rows, by, *parts: F.array_join(F.transform(rows, lambda r: F.concat_ws(by, *(r[p].cast("string") for p in parts))), ",")
    rows = e.select("event_id", providers.valid_class(F.col("a")).alias("class"), providers.valid_nli(F.col("n")).alias("nli"), providers.valid_claims(F.col("c")).alias("claims"), providers.web_sources(F.col("w")).alias("web"))
    return rows.select("event_id", "class", providers.initial_label(F.col("class")).alias("label"), F.col("nli.label").alias("nli"), F.col("nli.confidence").alias("confidence"), joined(F.col("claims"), ":", "claim_text", "is_checkable", "claim_type").alias("claims"), joined(F.col("web"), "=", "url", "nli_label", "tier").alias("web"))


_TYPED = [" military_action ", "ELECTION", "Science_Tech", "sports", "", None, "OTHER", "social_cultural", "natural disaster", "DIPLOMACY"]
_VALID = ["MILITARY_ACTION", "ELECTION", "SCIENCE_TECH", "OTHER", "OTHER", "OTHER", "OTHER", "SOCIAL_CULTURAL", "NATURAL_DISASTER", "DIPLOMACY"]


@query(f"select {_picked('event_id', _VALID)} as kind, count(*) as n from events group by 1")
def event_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    kind = providers.valid_event_type(_pick(F.col("event_id"), _TYPED))
    return table(spark, d, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_K = "cast(json_extract_string(props, '$.k') as int)"
_STANCES = "stances as (select user_id, event_id, case event_type when 'view' then 'PRO' when 'click' then 'ANTI' when 'purchase' then 'PRO' when 'signup' then 'ANTI' else 'UNCLEAR' end as stance, " + _K + " / 100.0::double as confidence, event_id % 6 <> 0 as quote_ok, event_id % 13 as prop from events)"


def _stances(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    side = F.when(F.col("event_type").isin("view", "purchase"), "PRO").when(F.col("event_type").isin("click", "signup"), "ANTI").otherwise("UNCLEAR")
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("idx"), side.alias("stance"), (k / 100.0).cast("double").alias("confidence"), (F.col("event_id") % 6 != 0).alias("quote_ok"), (F.col("event_id") % 13).alias("proposition_id"))


def _bank(spark: SparkSession) -> DataFrame:
    """Ten propositions; the stances name thirteen."""
    i = F.col("id")
    return spark.range(10).select(i.alias("proposition_id"), _text("d", i % 3).alias("domain"), (i % 2 == 0).alias("liberal_is_pro"), ((i - 5) / 5.0).alias("difficulty_b"))


@query(f"with {_STANCES} select event_id as idx, user_id as document_id, prop as proposition_id, stance, 'd' || prop % 3 as domain from stances where confidence >= 0.5 and quote_ok and stance in ('PRO', 'ANTI') and prop < 10")
def stance_filter(spark: SparkSession, d: str) -> DataFrame:
    """Stances that vote: known proposition, sure enough, quote found, for or against."""
    return ideology.usable_stances(_stances(spark, d), _bank(spark)).select("idx", "document_id", "proposition_id", "stance", "domain")


@query(f"""with {_STANCES}, v as (select user_id, confidence, case when (stance = 'PRO') = (prop % 2 = 0) then 1 else -1 end as side from stances where confidence >= 0.3 and stance in ('PRO', 'ANTI') and prop < 10)
 select user_id as document_id, count(*) as n, case when count(*) >= 2 then floor(tanh(1.5 * sum(side * confidence) / sum(confidence)) * 10000 + 0.5) / 10000 end as score, case when count(*) >= 2 then floor(sum(side * confidence) / sum(confidence) * 10000 + 0.5) / 10000 end as raw from v group by user_id""")
def stance_proxy(spark: SparkSession, d: str) -> DataFrame:
    rows = _stances(spark, d).join(_bank(spark).select("proposition_id", "liberal_is_pro"), "proposition_id")
    return ideology.proxy(rows).select("document_id", "n", "score", "raw")


_VERBS = ", ".join(f"({n}, '{v}')" for n, v in enumerate(ideology.VERBS))
_DOMAINS = ", ".join(f"('{name}', '{K.DIMENSIONS[name]}')" for name, _ in K.POLICY_WORDS)


@query(f"""select name || '-' || n as proposition_id, name as domain, dim as dimension, case when dim = 'economic' then 'economic' else 'social' end as axis, 'The state should ' || v || ' ' || replace(name, '_', ' ') as text, n in (0, 3, 4) as liberal_is_pro
 from (values {_DOMAINS}) d(name, dim), (values {_VERBS}) v(n, v)""")
def proposition_seed(spark: SparkSession, d: str) -> DataFrame:
    """An empty bank is filled; a full one stays."""
    seed = ideology.seeded(ideology.seed_bank(spark).where("false"))
    return ideology.seeded(seed).select("proposition_id", "domain", "dimension", "axis", "text", "liberal_is_pro")


@query("""with v as (select user_id, list(value order by ts, event_id) as v from events group by user_id having user_id % 4 > 0 or count(*) > 0), c as (select user_id, case when user_id % 4 = 0 then v[1:1] when user_id % 4 = 1 then [v[1], v[1]] else v end as v from v)
 select user_id, case when len(v) >= 2 then array_to_string(list_transform(v, lambda x: floor((x - list_min(v)) / coalesce(nullif(list_max(v) - list_min(v), 0), 0.1) * 1000 + 0.5)::bigint), ',') end as line from c""")
def sparklines(spark: SparkSession, d: str) -> DataFrame:
    """Users' values in order, on their own scale; equal values and single ones too."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"]).alias("v"))
    u, v = F.col("user_id") % 4, F.col("v")
    some = F.when(u == 0, F.slice(v, 1, 1)).when(u == 1, F.array(v[0], v[0])).otherwise(v)
    return rows.select("user_id", F.array_join(F.transform(S.sparkline(some), lambda x: F.floor(x * 1000 + 0.5).cast("string")), ",").alias("line"))


@query("select source, cast(floor(100.0 * count(*) filter (lang = 'de') / count(*) + 0.5) as bigint) as de, cast(floor(100.0 * count(*) filter (lang = 'en') / count(*) + 0.5) as bigint) as en, cast(floor(100.0 * count(*) filter (lang = 'de') / nullif(count(*) filter (lang = 'xx'), 0) + 0.5) as bigint) as nothing from documents group by source")
def percent_bars(spark: SparkSession, d: str) -> DataFrame:
    n = lambda x: F.count_if(F.col("lang") == x)
    g = table(spark, d, "documents").groupBy("source").agg(n("de").alias("a"), n("en").alias("b"), n("xx").alias("x"), F.count("*").alias("n"))
    return g.select("source", S.percent(F.col("a"), F.col("n")).alias("de"), S.percent(F.col("b"), F.col("n")).alias("en"), S.percent(F.col("a"), F.col("x")).alias("nothing"))


@query("""with p as (select user_id, round(avg(value) filter (event_id % 2 = 0), 4) as a, round(avg(value), 4) as b, count(*) filter (event_id % 2 = 0) as n, count(*) as m from events group by user_id)
 select user_id, a is not distinct from b and n = m as hidden from p""")
def hidden_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Users all of whose events are even ones: the longer period says nothing new."""
    even = F.col("event_id") % 2 == 0
    g = table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(F.when(even, F.col("value"))), 4).alias("a"), F.round(F.avg("value"), 4).alias("b"), F.count_if(even).alias("n"), F.count("*").alias("m"))
    return g.select("user_id", S.same_periods(F.col("a"), F.col("b"), F.col("a"), F.col("b"), F.col("n"), F.col("m")).alias("hidden"))


@query("select source, coalesce(case when lang <> 'fr' then case when regexp_matches(text, '[!?]') then 'OPINION_ANALYSIS' when length(text) < 120 then 'CONTEXT' else 'FACTUAL_CLAIM' end end, 'OTHER') as classification, count(*) as n from documents group by all")
def classification_histogram(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lang") != "fr", providers.stub_class(F.col("text")))
    return table(spark, d, "documents").groupBy("source", F.coalesce(kind, F.lit("OTHER")).alias("classification")).agg(F.count("*").alias("n"))


@query(f"""select user_id as document_id, floor(avg(case when {_K} % 3 > 0 then value else 0 end) * 1000 + 0.5) / 1000 as positive, floor(avg(coalesce(case when {_K} % 4 > 0 then -value end, 0)) * 1000 + 0.5) / 1000 as negative from events where {_K} % 10 > 0 group by user_id""")
def sentiment_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over the segments that have a sentiment; a component that is missing counts as 0."""
    k = F.get_json_object("props", "$.k").cast("int")
    parts = F.struct(F.when(k % 3 > 0, F.col("value")).alias("positive"), F.when(k % 4 > 0, -F.col("value")).alias("negative"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.when(k % 10 > 0, parts).alias("sentiment"))
    return veracity.sentiment_means(rows, "document_id", "sentiment")


@query("with x as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i, from embeddings where label is not null), n as (select label, count(*) as n from embeddings where label is not null group by label) select label as event_id, n.n, (i - 1)::int as place, round(avg(x), 6) as mean from x join n using (label) group by label, i, n.n")
def running_centroids(spark: SparkSession, d: str) -> DataFrame:
    arrivals = table(spark, d, "embeddings").where("label is not null").select(F.col("label").alias("event_id"), F.col("embedding").alias("vec"))
    return events.running_centroids(arrivals).select("event_id", "n", F.posexplode("centroid").alias("place", "mean")).withColumn("mean", F.round("mean", 6))
