"""Reviews of documents and publishers with all their parts: tiers, baselines of every day, insights, nested exports, gates, badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import scores as S
from factloom.operators import tables, veracity
from factloom.plans.registry import query
from factloom.plans.scoring import _EVIDENCE, _FUSED, _IN_TURN, _TURNS, _SCOPE, SEGMENTS, _evidence, _turns, segments
from factloom.session import table

_TIERS = tuple(f"T{t}" for t in range(1, 6))


@query(f"""with {_EVIDENCE}, t(tier) as (values {", ".join(f"('{t}')" for t in _TIERS)}), n as (select claim_id // 10 as document_id, 'T' || rank as tier, count(*) as n from ev group by all), d as (select document_id, sum(n) as total from n group by document_id)
 select d.document_id, t.tier, coalesce(n, 0)::bigint as n, floor(100 * coalesce(n, 0) / total + 0.5)::bigint as pct from d cross join t left join n on n.document_id = d.document_id and n.tier = t.tier""")
def evidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a document's claims by tier, all five of them, with whole percentages. Ten claims a document."""
    claims = table(spark, d, "events").select(F.col("user_id").alias("claim_id")).distinct().withColumn("document_id", F.floor(F.col("claim_id") / 10))
    counts = _evidence(spark, d).select("claim_id", "tier").join(claims, "claim_id").groupBy("document_id").agg(*(F.count_if(F.col("tier") == t).alias(t) for t in _TIERS), F.count("*").alias("total"))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.col(t).alias("n")) for t in _TIERS)))
    return counts.select("document_id", "total", each.alias("x")).select("document_id", "x.tier", "x.n", S.percent(F.col("x.n"), F.col("total")).alias("pct"))


_DAYS = """rated as (select event_type as publisher_name, epoch(date_trunc('day', ts))::bigint // 86400 as day, case when event_id % 5 > 0 then value end as score,
 case user_id % 4 when 0 then 'SUPPORTED' when 1 then 'CONTRADICTED' when 2 then 'UNKNOWN' else 'OPINION' end as label from events)"""


def baselines_of_days(rows: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(publisher_name, day, period, document_count, avg_score, avg_scored, contradiction_share, labels): baselines of each period up to
    every day that has documents. rows: publisher_name, day (a number), score (or null), label. A pane a publisher and day holds
    sums and a map of label counts; a period is a frame over panes, whose maps are merged, so no row is copied for the days it
    counts for."""
    labels = rows.groupBy("publisher_name", "day", "label").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.sum(F.coalesce(F.round("score", 6).cast("decimal(20,6)"), F.lit(0))).alias("sum"))
    panes = labels.groupBy("publisher_name", "day").agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.sum("sum").alias("sum"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels"))
    out = []
    for days in periods:
        w = Window.partitionBy("publisher_name").orderBy("day").rangeBetween(-(days - 1), 0)
        out.append(F.struct(F.lit(f"{days}d").alias("period"), F.sum("n").over(w).alias("n"), F.sum("scored").over(w).alias("scored"), F.sum("sum").over(w).alias("sum"), F.collect_list("labels").over(w).alias("maps")))
    every = panes.select("publisher_name", "day", F.array(*out).alias("xs")).select("publisher_name", "day", F.explode("xs").alias("x")).select("publisher_name", "day", "x.*")
    merged = F.aggregate("maps", F.create_map().cast("map<string,bigint>"), _plus)
    total = every.withColumn("labels", merged)
    share = lambda n: S.round3(n / F.col("n"))
    return total.select(
        "publisher_name", "day", "period", F.col("n").alias("document_count"), S.round3(F.col("sum").cast("double") / F.col("n")).alias("avg_score"), S.round3(F.col("sum").cast("double") / F.nullif("scored", F.lit(0))).alias("avg_scored"),
        share(F.coalesce(F.try_element_at("labels", F.lit("CONTRADICTED")), F.lit(0))).alias("contradiction_share"), F.transform_values("labels", lambda _, n: share(n)).alias("labels"),
    )


def _plus(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


@query(f"""with {_DAYS}, days as (select distinct publisher_name, day from rated), periods(period, days) as (values ('7d', 7), ('30d', 30)),
 x as (select a.publisher_name, a.day, period, r.score, r.label from days a cross join periods join rated r on r.publisher_name = a.publisher_name and r.day between a.day - days + 1 and a.day),
 l as (select publisher_name, day, period, label, count(*) as c from x group by all), t as (select publisher_name, day, period, sum(c) as n from l group by all),
 s as (select publisher_name, day, period, string_agg(label || '=' || (floor(c / n * 1000 + 0.5))::bigint, ',' order by label) as labels from l join t using (publisher_name, day, period) group by all)
 select publisher_name, day, period, count(*) as document_count, floor(sum(coalesce(round(score, 6), 0)::decimal(20,6))::double / count(*) * 1000 + 0.5) / 1000 as avg_score, floor(sum(round(score, 6)::decimal(20,6))::double / nullif(count(score), 0) * 1000 + 0.5) / 1000 as avg_scored,
 floor(count(*) filter (label = 'CONTRADICTED') / count(*) * 1000 + 0.5) / 1000 as contradiction_share, any_value(labels) as labels from x join s using (publisher_name, day, period) group by publisher_name, day, period""")
def baselines_daily(spark: SparkSession, d: str) -> DataFrame:
    """7 and 30 days up to every day, with the pooled distribution of labels in thousandths."""
    i = F.col("user_id") % 4
    label = F.when(i == 0, "SUPPORTED").when(i == 1, "CONTRADICTED").when(i == 2, "UNKNOWN").otherwise("OPINION")
    rows = table(spark, d, "events").select(F.col("event_type").alias("publisher_name"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("score"), label.alias("label"))
    entries = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("long").cast("string")))
    return baselines_of_days(rows).withColumn("labels", F.array_join(entries, ","))


@query(f"""with {_EVIDENCE}, {_FUSED}, c as (select claim_id // 10 as document_id, v.l as label, v.q as q, n > 0 and ((risk = 'CRITICAL' and best > 2) or (risk = 'HIGH' and best > 3)) as thin from fused join agg using (claim_id)),
 x as (select document_id, count(*) as n, count(*) filter (label = 'UNKNOWN') as u, count(*) filter (label = 'CONTRADICTED') as c, count(*) filter (label in ('SUPPORTED', 'CONTRADICTED', 'MIXED')) as judged, avg(q) as q, bool_or(thin) as thin from c group by document_id)
 select document_id, n as claims, round(u / n, 6) as unknown_rate, round(coalesce(c / nullif(judged, 0), 0), 6) as contradiction_rate, round(q, 6) as mean_confidence, thin as insufficient_tier, round(judged / n, 6) as claim_grounding,
 n < 3 as low_sample, case when judged / n >= 0.75 then 'high' when judged / n >= 0.55 then 'medium' else 'low' end as band from x""")
def claim_insights(spark: SparkSession, d: str) -> DataFrame:
    """What the page of a document says about its claims, ten a document: rates, mean confidence, and whether the evidence of some
    claim is of too low a tier for its risk."""
    c = veracity.verdicts(_evidence(spark, d), order=_IN_TURN).withColumn("document_id", F.floor(F.col("claim_id") / 10))
    in_turn = F.array_sort(F.collect_list(F.struct("claim_id", "confidence")))  # ten at most
    mean = F.aggregate(in_turn, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.count("*")
    is_ = lambda *x: F.count_if(F.col("label").isin(*x))
    x = c.groupBy("document_id").agg(F.count("*").alias("claims"), is_("UNKNOWN").alias("u"), is_("SUPPORTED").alias("s"), is_("CONTRADICTED").alias("c"), is_("MIXED").alias("m"), F.round(mean, 6).alias("mean_confidence"), F.coalesce(F.bool_or(F.col("reason") == "INSUFFICIENT_TIER_FOR_RISK"), F.lit(False)).alias("insufficient_tier"))
    share = (F.col("s") + F.col("c") + F.col("m")) / F.col("claims")
    band = F.when(share >= 0.75, "high").when(share >= 0.55, "medium").otherwise("low")
    return x.select("document_id", "claims", F.round(F.col("u") / F.col("claims"), 6).alias("unknown_rate"), F.round(S.contradiction_rate(F.col("s"), F.col("c"), F.col("m")), 6).alias("contradiction_rate"), "mean_confidence", "insufficient_tier", F.round(share, 6).alias("claim_grounding"), (F.col("claims") < K.MIN_SCORED).alias("low_sample"), band.alias("band"))


@query("""with e as (select l_orderkey, l_linenumber, l_quantity, p_brand, p_size, '(' || p_brand || ';' || p_size || ')' as parts from lineitem left join part on p_partkey = l_partkey),
 l as (select l_orderkey, string_agg(l_linenumber || ':' || cast(l_quantity as bigint) || coalesce(parts, ''), ',' order by l_linenumber, l_quantity, p_brand nulls first, p_size nulls first) as lines, count(*) as n from e group by l_orderkey),
 o as (select o_custkey, string_agg(o_orderkey || '[' || coalesce(lines, '') || ']', '|' order by o_orderkey) as orders, count(*) as n_orders, coalesce(sum(n), 0) as n_lines from orders left join l on l_orderkey = o_orderkey group by o_custkey)
 select c_custkey, coalesce(n_orders, 0)::bigint as n_orders, coalesce(n_lines, 0)::bigint as n_lines, sha256(coalesce(orders, '')) as export_sha256 from customer left join o on o_custkey = c_custkey""")
def nested_export_levels(spark: SparkSession, d: str) -> DataFrame:
    """Four levels: customers, their orders, these' lines, and the lines' parts, nested as arrays of structs and written as text."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    lines = tables.nested(lines, parts, "l_partkey", "parts", ["p_brand", "p_size"]).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "parts")
    orders = tables.nested(table(spark, d, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey", "lines", ["l_linenumber", "l_quantity", "parts"])
    whole = tables.nested(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), orders, "o_custkey", "orders", ["o_orderkey", "lines"])
    listed = lambda xs, f, by: F.array_join(F.transform(F.coalesce(xs, F.array()), f), by)
    part = lambda p: F.concat(F.lit("("), p["p_brand"], F.lit(";"), p["p_size"].cast("string"), F.lit(")"))
    line = lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_quantity"].cast("long").cast("string"), listed(x["parts"], part, ","))
    text = listed(F.col("orders"), lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit("["), listed(o["lines"], line, ","), F.lit("]")), "|")
    n_lines = F.aggregate(F.coalesce("orders", F.array()), F.lit(0), lambda n, o: n + F.coalesce(F.size(o["lines"]), F.lit(0)))
    return whole.select(F.col("o_custkey").alias("c_custkey"), F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n_orders"), n_lines.cast("long").alias("n_lines"), F.sha2(text, 256).alias("export_sha256"))


@query(f"""with {SEGMENTS}, x as (select source, count(*) filter (label = 'OTHER' and lang = 'fr') / count(*) as op, count(*) filter (label <> 'OTHER') / count(*) as fact, avg(case label when 'SUPPORTED' then 0.5 when 'CONTRADICTED' then -1 else 0 end) as sent from segs group by source)
 select source, floor(greatest(0, least(1, 0.40 * op + 0.35 * abs(sent) + 0.25 * abs(op - fact))) * 1000 + 0.5) / 1000 as one_sidedness from x""")
def one_sidedness(spark: SparkSession, d: str) -> DataFrame:
    """All three parts: opinions (unlabelled texts of one language), sentiment by label, and facts (labelled texts)."""
    label = F.col("label")
    sentiment = F.avg(F.when(label == "SUPPORTED", 0.5).when(label == "CONTRADICTED", -1.0).otherwise(0.0))
    share = lambda c: F.count_if(c) / F.count("*")
    return segments(spark, d).groupBy("source").agg(S.round3(S.one_sidedness(share((label == "OTHER") & (F.col("lang") == "fr")), sentiment, share(label != "OTHER"))).alias("one_sidedness"))


@query(f"""with {_TURNS}, n as (select conv_id, turn, claim, {_SCOPE("claim")} as a, {_SCOPE("answer")} as b, (conv_id % 10) / 10.0::double as sim from turns), j as (select *, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::double, 0) as jac from n)
 select conv_id, turn, case when sim >= 0.55 then null when jac < 0.12 then 'LOW_PROPOSITION_OVERLAP' when regexp_matches(claim, '(?i){K.LEGAL_CLAIM}') and jac < 0.18 then 'LEGAL_CLAIM_SCOPE_MISMATCH'
 when regexp_matches(claim, '(?i){K.EVENT_CLAIM}') and regexp_matches(claim, '{K.PROPER_NOUN}') and jac < 0.15 then 'GEOPOLITICAL_EVENT_SCOPE_MISMATCH' end as reason from j""")
def scope_gate_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The gate with similarities of all sizes: evidence that is near enough passes whatever its words."""
    return _turns(spark, d).select("conv_id", "turn", veracity.scope_fails(F.col("claim"), F.col("answer"), ((F.col("conv_id") % 10) / 10.0).cast("double")).alias("reason"))


@query("""select event_id, case when s >= 0.8 then 'high' when s >= 0.6 then 'good' when s >= 0.4 then 'mixed' else 'low' end as score, case when m > 0.05 then 'positive' when m < -0.05 then 'negative' else 'neutral' end as sentiment
 from (select event_id, (k % 21) / 20.0::double as s, (k % 41 - 20) / 200.0::double as m from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events))""")
def score_badges(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", S.score_badge((k % 21) / 20.0).alias("score"), S.sentiment_badge((k % 41 - 20) / 200.0).alias("sentiment"))
