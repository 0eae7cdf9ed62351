"""Scores over `documents` and `labels`: a document is a segment of its source, labelled CONTRADICTED (toxic), SUPPORTED
(quality) or UNKNOWN; unlabelled ones count as OTHER."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import scores as S
from factloom.functions import text as T
from factloom.operators import ideology, veracity
from factloom.plans.registry import query
from factloom.session import table


def segments(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "CONTRADICTED").when(F.col("quality") == 1, "SUPPORTED").when(F.col("quality").isNotNull(), "UNKNOWN").otherwise("OTHER")
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "lang", "n_chars", label.alias("label"))


SEGMENTS = "segs as (select doc_id, source, lang, n_chars, case when toxic = 1 then 'CONTRADICTED' when quality = 1 then 'SUPPORTED' when quality is not null then 'UNKNOWN' else 'OTHER' end as label from documents left join labels using (doc_id))"


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    is_ = lambda x: F.count_if(F.col("label") == x)
    return rows.groupBy(*keys).agg(is_("SUPPORTED").alias("s"), is_("CONTRADICTED").alias("c"), is_("MIXED").alias("m"), is_("UNKNOWN").alias("u"), F.count("*").alias("n"), F.count_if(F.col("label").isin("OTHER", "OPINION", "NOT_CHECKABLE", "NEUTRAL")).alias("excluded"))


COUNTED = SEGMENTS + ", counted as (select source, count(*) filter (label = 'SUPPORTED') as s, count(*) filter (label = 'CONTRADICTED') as c, 0 as m, count(*) filter (label = 'UNKNOWN') as u, count(*) as n, count(*) filter (label = 'OTHER') as excluded from segs group by source)"


@query(f"with {SEGMENTS} select source, label, count(*) as n from segs group by all")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("source", "label").agg(F.count("*").alias("n"))


_SCORES = """round3g as (select *, case when n - excluded > 0 then (s + c + m) / (n - excluded)::double else 0 end as g0,
  greatest(0, least(1, ((s - 1.2 * c + 0.25 * m)::double / greatest(s + c + m + u, 3) + 1.2) / 2.2)) as i0, greatest(0, least(1, 0.25 * (1 - excluded / n::double))) as o0 from counted)"""


@query(f"""with {COUNTED}, {_SCORES} select source, n as segments, floor(g0 * 1000 + 0.5) / 1000 as grounding_score, floor(i0 * 1000 + 0.5) / 1000 as integrity_score, floor(o0 * 1000 + 0.5) / 1000 as one_sidedness,
 case when s + c + m + u < 3 then 'low_sample' else 'ok' end as integrity_status, case when s + c + m < 3 then 'low_sample' else 'ok' end as factuality_status from round3g""")
def document_scores(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: labels to a strip's counts to scores, one shuffle by source."""
    x = counted(segments(spark, d), "source")
    s, c, m, u, total = F.col("s"), F.col("c"), F.col("m"), F.col("u"), F.col("n") - F.col("excluded")
    factual = 1 - F.col("excluded") / F.col("n")
    low = lambda k: F.when(k < K.MIN_SCORED, "low_sample").otherwise("ok")
    return x.select(
        "source", F.col("n").alias("segments"), S.round3(S.grounding(s, c, m, total)).alias("grounding_score"), S.round3(S.integrity(s, c, m, u)).alias("integrity_score"),
        S.round3(S.one_sidedness(F.lit(0.0), F.lit(0.0), factual)).alias("one_sidedness"), low(s + c + m + u).alias("integrity_status"), low(s + c + m).alias("factuality_status"),
    )


_TIERS = "tiers as (select source, count(*) filter (lang = 'en') as t1, count(*) filter (lang = 'de') as t2, count(*) filter (lang = 'fr') as t4, count(*) filter (lang not in ('en', 'de', 'fr')) as t5 from documents group by source)"


@query(f"""with {_TIERS} select source, t1 + t2 + t4 + t5 as evidence, floor(coalesce((t1 * 1.0 + t2 * 0.85 + t4 * 0.45 + t5 * 0.2)::double / nullif(t1 + t2 + t4 + t5, 0), 0) * least(1, (t1 + t2 + t4 + t5) / 3::double) * 1000 + 0.5) / 1000 as sourcing_quality from tiers""")
def sourcing_quality(spark: SparkSession, d: str) -> DataFrame:
    tier = lambda c: F.count_if(c)
    x = table(spark, d, "documents").groupBy("source").agg(tier(F.col("lang") == "en").alias("T1"), tier(F.col("lang") == "de").alias("T2"), tier(F.col("lang") == "fr").alias("T4"), tier(~F.col("lang").isin("en", "de", "fr")).alias("T5"))
    counts = {t: F.col(t) for t in ("T1", "T2", "T4", "T5")}
    return x.select("source", sum(counts.values(), F.lit(0)).cast("long").alias("evidence"), S.round3(S.sourcing(counts)).alias("sourcing_quality"))


@query(f"""with {COUNTED}, {_TIERS}, x as (select source, c / nullif(s + c + m, 0)::double as cr, floor((t1 * 1.0 + t2 * 0.85 + t4 * 0.45 + t5 * 0.2)::double / nullif(t1 + t2 + t4 + t5, 0) * least(1, (t1 + t2 + t4 + t5) / 3::double) * 1000 + 0.5) / 1000 as src,
  floor(case when n - excluded > 0 then (s + c + m) / (n - excluded)::double else 0 end * 1000 + 0.5) / 1000 as gr, floor(0.25 * (1 - excluded / n::double) * 1000 + 0.5) / 1000 as os from counted join tiers using (source))
 select source, round(greatest(0, least(1, 0.40 * (1 - coalesce(cr, 0)) + 0.25 * src + 0.25 * gr + 0.10 * (1 - os))), 6) as factuality_score from x""")
def factuality(spark: SparkSession, d: str) -> DataFrame:
    x = counted(segments(spark, d), "source").join(sourcing_quality(spark, d), "source")
    s, c, m, total = F.col("s"), F.col("c"), F.col("m"), F.col("n") - F.col("excluded")
    rate, gr = S.contradiction_rate(s, c, m), S.round3(S.grounding(s, c, m, total))
    os = S.round3(S.one_sidedness(F.lit(0.0), F.lit(0.0), 1 - F.col("excluded") / F.col("n")))
    return x.select("source", F.round(S.factuality(rate, F.col("sourcing_quality"), gr, os), 6).alias("factuality_score"))


@query("""with periods(period, days) as (values ('7d', 7), ('30d', 30)), m as (select max(ts) as top from events),
 x as (select event_type as publisher_name, period, case when event_id % 5 > 0 then value end as score, user_id % 3 = 0 as contradicted from events, periods, m where ts > top - to_days(days))
 select publisher_name, period, count(*) as document_count, round(avg(coalesce(score, 0)), 6) as avg_score, round(avg(score), 6) as avg_scored, floor(count(*) filter (contradicted) / count(*)::double * 1000 + 0.5) / 1000 as contradiction_share from x group by all""")
def publisher_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Baselines of 7 and 30 days up to the newest row, by publisher: both in one pass, recent rows counted for both."""
    rows = table(spark, d, "events")
    rows = rows.join(F.broadcast(rows.agg(F.max("ts").alias("top"))))  # one row
    within = lambda days: F.col("ts") > F.col("top") - F.expr(f"interval {days} days")
    rows = rows.where(within(30)).withColumn("period", F.explode(F.when(within(7), F.array(F.lit("7d"), F.lit("30d"))).otherwise(F.array(F.lit("30d")))))
    scored = F.when(F.col("event_id") % 5 > 0, F.col("value"))
    return rows.groupBy(F.col("event_type").alias("publisher_name"), "period").agg(F.count("*").alias("document_count"), F.round(F.avg(F.coalesce(scored, F.lit(0.0))), 6).alias("avg_score"), F.round(F.avg(scored), 6).alias("avg_scored"), S.round3(F.count_if(F.col("user_id") % 3 == 0) / F.count("*")).alias("contradiction_share"))


_EVIDENCE = """ev as (select user_id as claim_id, event_id, case event_type when 'view' then 'ENTAILMENT' when 'signup' then 'ENTAILMENT' when 'click' then 'CONTRADICTION' when 'purchase' then 'NEUTRAL' end as nli_label,
  (k % 100) / 100.0::double as conf, event_id % 4 <> 0 as free, 1 + (k % 5) as rank, case user_id % 4 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as risk, user_id % 7 = 0 as told
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.when(F.col("event_type").isin("view", "signup"), "ENTAILMENT").when(F.col("event_type") == "click", "CONTRADICTION").when(F.col("event_type") == "purchase", "NEUTRAL")
    named = F.create_map(*(F.lit(x) for i, r in enumerate(("CRITICAL", "HIGH", "MEDIUM", "LOW")) for x in (i, r)))
    return table(spark, d, "events").select(F.col("user_id").alias("claim_id"), "event_id", label.alias("nli_label"), ((k % 100) / 100.0).cast("double").alias("nli_confidence"), (F.col("event_id") % 4 != 0).alias("is_independent"), F.concat(F.lit("T"), (1 + k % 5).cast("string")).alias("tier"), F.element_at(named, (F.col("user_id") % 4).cast("int")).alias("risk"), (F.col("user_id") % 7 == 0).alias("is_attribution"))


#: Doubles are added by rising event.
_IN_TURN = ("event_id", "nli_confidence")
_FUSED = """agg as (select claim_id, count(nli_label) as n, count(*) filter (nli_label is not null and free) as f, min(case when nli_label is not null then rank end) as best,
  avg(conf) filter (free and nli_label = 'ENTAILMENT') as s, avg(conf) filter (free and nli_label = 'CONTRADICTION') as c, avg(conf) filter (free and nli_label = 'NEUTRAL') as neutral, max(risk) as risk, bool_or(told) as told from ev group by claim_id),
 fused as (select claim_id, case when n = 0 then struct_pack(l := 'UNKNOWN', q := 0.5::double) when risk = 'CRITICAL' and best > 2 then struct_pack(l := 'UNKNOWN', q := 0.3::double) when risk = 'HIGH' and best > 3 then struct_pack(l := 'UNKNOWN', q := 0.4::double)
  when f = 0 then struct_pack(l := 'UNKNOWN', q := 0.3::double)
  when s is not null and c is not null and least(s, c) >= 0.5 and abs(s - c) <= 0.25 then struct_pack(l := 'MIXED', q := greatest(s, c))
  when s is not null and c is not null and s >= c and s >= 0.5 then struct_pack(l := 'SUPPORTED', q := case when best >= 4 then least(s, 0.6) else s end)
  when s is not null and c is not null and c > s and c >= 0.55 then struct_pack(l := case when told then 'UNKNOWN' else 'CONTRADICTED' end, q := c)
  when s is not null and c is not null then struct_pack(l := 'UNKNOWN', q := greatest(s, c, neutral))
  when c is not null and c < 0.55 then struct_pack(l := 'UNKNOWN', q := c) when c is not null then struct_pack(l := case when told then 'UNKNOWN' else 'CONTRADICTED' end, q := c)
  when s is not null and s < 0.5 then struct_pack(l := 'UNKNOWN', q := s) when s is not null then struct_pack(l := 'SUPPORTED', q := case when best >= 4 then least(s, 0.6) else s end)
  else struct_pack(l := 'UNKNOWN', q := coalesce(neutral, 0.5)) end as v from agg)"""


@query(f"with {_EVIDENCE}, {_FUSED} select claim_id, v.l as label, round(v.q, 6) as confidence from fused")
def verdict_fusion(spark: SparkSession, d: str) -> DataFrame:
    return veracity.verdicts(_evidence(spark, d), order=_IN_TURN).select("claim_id", "label", F.round("confidence", 6).alias("confidence"))


@query("""with c as (select event_id, user_id, case event_type when 'view' then 'SUPPORTED' when 'click' then 'CONTRADICTED' when 'purchase' then 'MIXED' else 'UNKNOWN' end as label, (k % 100) / 100.0::double as q from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)),
 w as (select event_id // 4 as segment_id, label, coalesce(nullif(q, 0), 0.5) as w from c),
 v as (select segment_id, sum(case label when 'SUPPORTED' then w when 'MIXED' then 0.1 * w else 0 end) as pos, sum(case label when 'CONTRADICTED' then 1.2 * w when 'MIXED' then 0.1 * w else 0 end) as neg, count(*) filter (label <> 'UNKNOWN') as judged from w group by segment_id)
 select segment_id, case when judged = 0 then 'NOT_CHECKABLE' when pos >= 0.9 and neg >= 0.9 then 'MIXED' when round(pos - neg, 9) >= 0.6 then 'SUPPORTED' when round(pos - neg, 9) <= -0.6 then 'CONTRADICTED' else 'UNKNOWN' end as label from v""")
def segment_vote(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.when(F.col("event_type") == "view", "SUPPORTED").when(F.col("event_type") == "click", "CONTRADICTED").when(F.col("event_type") == "purchase", "MIXED").otherwise("UNKNOWN")
    claims = table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("segment_id"), label.alias("label"), ((k % 100) / 100.0).cast("double").alias("confidence"))
    return veracity.segment_labels(claims)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the answer that follows it: a claim and its evidence."""
    c = table(spark, d, "conversations")
    claim = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("claim"))
    return claim.join(c.where("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"])


_TURNS = "turns as (select u.conv_id, u.turn, u.text as claim, a.text as answer from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 and u.role = 'user' and a.role <> 'user')"
_NORM = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_SCOPE = lambda c: f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 3 and t not in ({', '.join(map(repr, K.STOP_WORDS))})))"


@query(f"with {_TURNS}, n as (select conv_id, turn, list_distinct(string_split({_NORM('claim')}, ' ')) as a, list_distinct(string_split({_NORM('answer')}, ' ')) as b from turns) select conv_id, turn, round(case when a = [''] or b = [''] then 0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double end, 6) as overlap from n")
def text_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", F.round(T.word_jaccard(F.col("claim"), F.col("answer")), 6).alias("overlap"))


@query(f"""with {_TURNS}, n as (select conv_id, turn, claim, {_SCOPE("claim")} as a, {_SCOPE("answer")} as b from turns), j as (select *, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::double, 0) as jac from n)
 select conv_id, turn, case when jac < 0.12 then 'LOW_PROPOSITION_OVERLAP' when regexp_matches(claim, '(?i){K.LEGAL_CLAIM}') and jac < 0.18 then 'LEGAL_CLAIM_SCOPE_MISMATCH'
 when regexp_matches(claim, '(?i){K.EVENT_CLAIM}') and regexp_matches(claim, '{K.PROPER_NOUN}') and jac < 0.15 then 'GEOPOLITICAL_EVENT_SCOPE_MISMATCH' end as reason from j""")
def scope_gate(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", veracity.scope_fails(F.col("claim"), F.col("answer"), F.lit(0.0)).alias("reason"))


@query(f"""with {SEGMENTS}, x as (select source, count(*) filter (label = 'UNKNOWN') as u, count(*) filter (label = 'SUPPORTED') as s, count(*) filter (label = 'CONTRADICTED') as c, count(*) as n from segs where label <> 'OTHER' group by source)
 select source, round(u / n::double, 6) as unknown_rate, round(coalesce(c / nullif(s + c, 0)::double, 0), 6) as contradiction_rate, round((s + c) / n::double, 6) as claim_grounding, n < 3 as low_sample, case when (s + c) / n::double >= 0.75 then 'high' when (s + c) / n::double >= 0.55 then 'medium' else 'low' end as band from x""")
def article_insights(spark: SparkSession, d: str) -> DataFrame:
    x = counted(segments(spark, d).where("label <> 'OTHER'"), "source")
    share = (F.col("s") + F.col("c") + F.col("m")) / F.col("n")
    band = F.when(share >= 0.75, "high").when(share >= 0.55, "medium").otherwise("low")
    return x.select("source", F.round(F.col("u") / F.col("n"), 6).alias("unknown_rate"), F.round(S.contradiction_rate(F.col("s"), F.col("c"), F.col("m")), 6).alias("contradiction_rate"), F.round(share, 6).alias("claim_grounding"), (F.col("n") < 3).alias("low_sample"), band.alias("band"))


@query("select doc_id, badge from (select doc_id, case when (doc_id % 11 - 5) > -2 and (doc_id % 11 - 5) < 2 then 'center' when abs(doc_id % 11 - 5) < 5 then case when doc_id % 11 > 5 then 'lean right' else 'lean left' end when doc_id % 11 > 5 then 'right' else 'left' end as badge from documents)")
def ideology_badges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.ideology_badge(F.col("doc_id") % 11 - 5).alias("badge"))


_DOMAIN_AXES = ", ".join(f"({n}, '{x}')" for n, x in enumerate(K.DIMENSIONS.values()))
_SHOWN = "floor(coalesce({}.score, o.score) * 1000 + 0.5) / 100"


@query(f"""with recursive dims(place, dim) as (values {_DOMAIN_AXES}), cast_votes as (select user_id as key, event_id as proposition_id, case when event_type in ('view', 'purchase') then 1.0::double else 0 end as y, 0.0::double as b, dim from events left join dims on place = cast(json_extract_string(props, '$.k') as int) % {len(K.DIMENSIONS)}),
 votes as (select key, 'overall' as axis, proposition_id, y, b from cast_votes union all select key, case dim when 'economic' then 'economic' else 'social' end, proposition_id, y, b from cast_votes where dim in ('economic', 'social', 'executive')), {ideology.ESTIMATE_SQL}
 select o.key as document_id, o.score, o.se, o.n_propositions, {_SHOWN.format("e")} as economic, {_SHOWN.format("s")} as social from estimates o left join estimates e on e.key = o.key and e.axis = 'economic' left join estimates s on s.key = o.key and s.axis = 'social' where o.axis = 'overall'""")
def ideology_axes(spark: SparkSession, d: str) -> DataFrame:
    """Displays by axis of each user: events vote on propositions of domains by k."""
    k = F.get_json_object("props", "$.k").cast("int")
    domains = F.array(*map(F.lit, K.DIMENSIONS))
    votes = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("proposition_id"), F.element_at(domains, 1 + k % len(K.DIMENSIONS)).alias("domain"), F.col("event_type").isin("view", "purchase").cast("double").alias("y"), F.lit(0.0).alias("b"))
    return ideology.axes(votes)
