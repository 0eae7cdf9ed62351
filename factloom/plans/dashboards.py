"""Dashboard queries: stories, publishers, leaderboards, pages, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scores as S
from factloom.operators import scans
from factloom.operators.evidence import top_k
from factloom.operators.events import first_seen
from factloom.plans.registry import query
from factloom.plans.scoring import SEGMENTS, segments
from factloom.session import table


@query("select label as event_id, count(*) as documents, count(distinct vec_id % 20) as publishers from embeddings where label is not null group by label having count(*) >= 2")
def story_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("label is not null")
    return e.groupBy(F.col("label").alias("event_id")).agg(F.count("*").alias("documents"), F.count_distinct(F.col("vec_id") % 20).alias("publishers")).where("documents >= 2")


@query("select event_type, count(*) as n from events group by event_type")
def event_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("""with b as (select source, case lang when 'de' then 'left' when 'fr' then 'right' else 'center' end as bias from documents), c as (select source, count(*) filter (bias = 'left') as "left", count(*) filter (bias = 'center') as center, count(*) filter (bias = 'right') as "right" from b group by source)
 select *, ("left" = 0 and "right" > 0) or ("right" = 0 and "left" > 0) as blindspot, ("left" + center + "right" >= 2) and (("left" = 0 and "right" > 0) or ("right" = 0 and "left" > 0)) as badge from c""")
def bias_tallies_blindspot(spark: SparkSession, d: str) -> DataFrame:
    bias = F.when(F.col("lang") == "de", "left").when(F.col("lang") == "fr", "right").otherwise("center")
    c = table(spark, d, "documents").withColumn("bias", bias).groupBy("source").agg(*(F.count_if(F.col("bias") == b).alias(b) for b in ("left", "center", "right")))
    blind = ((F.col("left") == 0) & (F.col("right") > 0)) | ((F.col("right") == 0) & (F.col("left") > 0))
    return c.withColumn("blindspot", blind).withColumn("badge", (F.col("left") + F.col("center") + F.col("right") >= 2) & blind)


@query("select event_id, documents, publishers from (select label || '-' || vec_id // (5 * (1 + label)) as event_id, count(*) as documents, count(distinct vec_id % 20) as publishers from embeddings where label is not null group by 1) where documents >= 2 and publishers < 3")
def low_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Stories of two documents at least and fewer than three publishers. A story is a label's vectors of a run of ids."""
    e = table(spark, d, "embeddings").where("label is not null")
    story = F.concat(F.col("label").cast("string"), F.lit("-"), F.floor(F.col("vec_id") / (5 * (1 + F.col("label")))).cast("string"))
    return e.groupBy(story.alias("event_id")).agg(F.count("*").alias("documents"), F.count_distinct(F.col("vec_id") % 20).alias("publishers")).where("documents >= 2 and publishers < 3")


@query(f"""with {SEGMENTS}, b as (select lang, source, count(*) as articles, round(avg(n_chars) filter (label <> 'OTHER'), 6) as avg_length, round(avg(case label when 'SUPPORTED' then 1 when 'CONTRADICTED' then 0 when 'UNKNOWN' then 0.5 end), 6) as avg_integrity,
 round(count(*) filter (label = 'CONTRADICTED') / nullif(count(*) filter (label <> 'OTHER'), 0)::double, 6) as contradicted from segs group by all)
 select *, row_number() over (partition by lang order by coalesce(avg_integrity, -1) desc, source) as rank from b""")
def publisher_event_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Publishers within an event, by mean integrity, those without any last; numbered by a scan, however many an event has."""
    cell, label = F.col("label") != "OTHER", F.col("label")
    integrity = F.avg(F.when(label == "SUPPORTED", 1.0).when(label == "CONTRADICTED", 0.0).when(label == "UNKNOWN", 0.5))
    rows = segments(spark, d).groupBy("lang", "source").agg(
        F.count("*").alias("articles"), F.round(F.avg(F.when(cell, F.col("n_chars"))), 6).alias("avg_length"), F.round(integrity, 6).alias("avg_integrity"),
        F.round(F.count_if(label == "CONTRADICTED") / F.nullif(F.count_if(cell), F.lit(0)), 6).alias("contradicted"),
    )
    return scans.numbered(rows, ["lang"], [F.coalesce("avg_integrity", F.lit(-1.0)).desc(), F.col("source").asc_nulls_last()], "rank")


@query("select o_orderstatus as publisher, strftime(o_orderdate, '%Y-%m-%d') as day, round(avg(o_totalprice), 4) as mean from orders group by all")
def daily_sparkline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("publisher"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("""select publisher, string_agg(day || '=' || mean, ',' order by day) as points, count(*) as n from (select o_orderpriority as publisher, strftime(o_orderdate, '%Y-%m-%d') as day, floor(avg(o_totalprice) + 0.5)::bigint as mean from orders group by all) group by publisher""")
def sparkline_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The ordered points (day, mean) of each publisher."""
    days = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("publisher"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.floor(F.avg("o_totalprice") + 0.5).alias("mean"))
    points = F.array_sort(F.collect_list(F.struct("day", "mean")))
    return days.groupBy("publisher").agg(F.array_join(F.transform(points, lambda p: F.concat(p["day"], F.lit("="), p["mean"].cast("string"))), ",").alias("points"), F.count("*").alias("n"))


@query("select strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as week, cast(floor(avg(o_totalprice) / 100 + 0.5) as bigint) as mean, count(*) as articles from orders group by 1 having count(*) >= 2")
def weekly_trend(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd")
    return table(spark, d, "orders").groupBy(week.alias("week")).agg(F.floor(F.avg("o_totalprice") / 100 + 0.5).alias("mean"), F.count("*").alias("articles")).where("articles >= 2")


_CATEGORIES = {"BUILDING": "mainstream", "AUTOMOBILE": "partisan", "MACHINERY": "fringe", "HOUSEHOLD": "reference"}


@query(f"""with p as (select n_name as publisher, arg_min(case c_mktsegment {" ".join(f"when '{a}' then '{b}'" for a, b in _CATEGORIES.items())} else 'other' end, c_custkey) as category, count(*) as feeds from customer join nation on c_nationkey = n_nationkey group by n_name)
 select *, row_number() over (order by case category when 'mainstream' then 0 when 'partisan' then 1 when 'fringe' then 2 when 'reference' then 3 else 4 end, publisher) as place from p""")
def publisher_list(spark: SparkSession, d: str) -> DataFrame:
    """Publishers with the category of their first feed, in the order of categories, then by name."""
    named = F.create_map(*(F.lit(x) for kv in _CATEGORIES.items() for x in kv))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    category = F.coalesce(F.try_element_at(named, F.col("c_mktsegment")), F.lit("other"))
    rows = rows.groupBy(F.col("n_name").alias("publisher")).agg(F.min_by(category, "c_custkey").alias("category"), F.count("*").alias("feeds"))
    return scans.numbered(rows, [], [S.category_rank(F.col("category")), F.col("publisher")], "place")


@query("select coalesce(c_mktsegment, 'all') as category, count(*) as n from customer group by rollup (c_mktsegment)")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").rollup("c_mktsegment").agg(F.count("*").alias("n")).select(F.coalesce("c_mktsegment", F.lit("all")).alias("category"), "n")


@query("select user_id, count(*) as n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as newest, max(ts) > (select max(ts) from events) - interval 48 hours as fresh from events group by user_id")
def feed_newest_groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("at")).join(F.broadcast(now))  # one row
    return g.select("user_id", "n", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("newest"), (F.col("at") > F.col("now") - F.expr("interval 48 hours")).alias("fresh"))


@query("""select o_orderpriority as publisher, round(avg(o_totalprice) filter (year(o_orderdate) = 1996), 4) as "7d", round(avg(o_totalprice) filter (year(o_orderdate) = 1997), 4) as "30d" from orders where year(o_orderdate) in (1996, 1997) group by 1""")
def baseline_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("period", F.when(F.year("o_orderdate") == 1996, "7d").when(F.year("o_orderdate") == 1997, "30d")).where("period is not null")
    return o.groupBy(F.col("o_orderpriority").alias("publisher")).pivot("period", ["7d", "30d"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("select row_number() over (order by coalesce(c_acctbal, 0) desc, c_custkey) as rank, c_custkey, c_acctbal from customer order by rank limit 20 offset 20")
def leaderboard_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 2 of 20, page number clamped. The rank is the place on the page, so only what is paged is numbered."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    page = min(2, max(1, -(-c.count() // 20)))
    rows = c.orderBy(F.desc(F.coalesce("c_acctbal", F.lit(0.0))), "c_custkey").offset((page - 1) * 20).limit(20)
    number = F.row_number().over(Window.orderBy(F.desc(F.coalesce("c_acctbal", F.lit(0.0))), "c_custkey"))  # 20 rows
    return rows.select((number + (page - 1) * 20).cast("long").alias("rank"), "c_custkey", "c_acctbal")


@query("""with o as (select o_orderkey, case when o_orderkey % 10 <> 0 then o_totalprice end as integrity from orders)
 select * from (select 'top' as side, o_orderkey, integrity from o order by integrity desc nulls first, o_orderkey limit 3) union all select * from (select 'bottom' as side, o_orderkey, integrity from o where integrity is not null order by integrity, o_orderkey limit 3)""")
def top_bottom_nulls(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("integrity"))
    top = o.orderBy(F.desc_nulls_first("integrity"), "o_orderkey").limit(3).select(F.lit("top").alias("side"), "*")
    return top.unionAll(o.where("integrity is not null").orderBy("integrity", "o_orderkey").limit(3).select(F.lit("bottom").alias("side"), "*"))


@query("select l_suppkey, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as n from lineitem) where n <= 5")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = top_k(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5)
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("select l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as n from lineitem) where n <= 3")
def first_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")], 3).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""select l_orderkey, side, l_linenumber, contribution from (select *, row_number() over (partition by l_orderkey, side order by abs(contribution) desc, l_linenumber) as n from (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then -1.2 * l_quantity when l_returnflag = 'A' then l_quantity else 0.25 * l_quantity end as contribution, case when l_returnflag = 'R' then 'negative' else 'positive' end as side from lineitem)) where n <= 3""")
def top_contributions(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("l_returnflag") == "R", -1.2 * F.col("l_quantity")).when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.25 * F.col("l_quantity"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("contribution"), F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("side"))
    return top_k(rows, ["l_orderkey", "side"], [F.desc(F.abs("contribution")), F.col("l_linenumber")], 3).select("l_orderkey", "side", "l_linenumber", "contribution")


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by text")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """By text: partial aggregation on a 128-bit digest, so hot copies meet as one row a task."""
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    return table(spark, d, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("""with h as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, url from pages), f as (select host, url, min(page_id) as seen from h group by all) select host, url, row_number() over (partition by host order by seen, url) as number from f""")
def first_seen_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), "url")
    return first_seen(rows, "host", "url", "page_id").select("host", "url", F.col("number").cast("long").alias("number"))


@query("""with w as (select conv_id, turn, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n from conversations), c as (select *, coalesce(sum(n) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from w)
 select conv_id, substr(string_agg(text, ' ' order by turn), 1, 800) as lead from c where before < 150 group by conv_id""")
def cumulative_lead(spark: SparkSession, d: str) -> DataFrame:
    """The texts that begin within the first 150 words of a conversation, cut to 800 characters: what a group collects is bounded
    before it is collected, each text to 800 characters and all to 150 words and one text more."""
    from factloom.functions import text as T

    rows = table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 800).alias("text"), F.coalesce(F.size(T.words(F.col("text"))), F.lit(0)).alias("n"))
    rows = scans.running(rows, ["conv_id"], ["turn", "text"], upto=F.col("n")).where("upto - n < 150")
    rows = scans.running(rows, ["conv_id"], ["turn", "text"], chars=F.length("text") + 1).where("chars - coalesce(length(text), 0) <= 801")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return rows.groupBy("conv_id").agg(F.substring(F.array_join(parts, " "), 1, 800).alias("lead"))


@query("""with w as (select * from (values ('de'), ('xx')) t(locale)), l as (select distinct locale, source from w left join documents on lang = locale and source <> 'src0'), n as (select locale, count(source) as n from l group by locale)
 select n.locale, count(*) as kept from n, documents d where n.n = 0 or d.source in (select source from l where l.locale = n.locale and source is not null) group by n.locale""")
def semi_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the sources that a locale has; a locale without sources passes everything."""
    docs = table(spark, d, "documents").select("source", "lang")
    out = []
    for locale in ("de", "xx"):
        wanted = docs.where((F.col("lang") == locale) & (F.col("source") != "src0")).select("source").distinct()
        empty = wanted.agg((F.count("*") == 0).alias("empty"))
        kept = docs.join(wanted.withColumn("hit", F.lit(True)), "source", "left").join(F.broadcast(empty)).where(F.col("hit") | F.col("empty"))  # one row
        out.append(kept.agg(F.count("*").alias("kept")).select(F.lit(locale).alias("locale"), "kept"))
    return out[0].unionAll(out[1])


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def anti_processed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id, source, lang, toxic from documents join (select distinct source as source from documents where lang = 'de') using (source) left join labels using (doc_id) where n_chars >= 1000 and n_chars < 5000 and source <> 'src3'")
def filtered_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("n_chars >= 1000 and n_chars < 5000 and source <> 'src3'").select("doc_id", "source", "lang")
    german = table(spark, d, "documents").where("lang = 'de'").select("source").distinct()
    return docs.join(german, "source", "left_semi").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "source", "lang", "toxic")


@query("""select a.vec_id, b.vec_id as related_id from embeddings a join lateral (select vec_id from embeddings b where b.label = a.label and b.vec_id > a.vec_id order by vec_id limit 5) b on true""")
def related_items(spark: SparkSession, d: str) -> DataFrame:
    """The five that follow each item in its group: items numbered by a scan, whatever the size of a group, and met by number."""
    return scans.followers(table(spark, d, "embeddings"), "label", "vec_id", 5).select("vec_id", F.col("follower").alias("related_id"))


@query(f"with {SEGMENTS} select source, round(avg(n_chars) filter (label <> 'OTHER'), 6) as avg_score, count(*) filter (label in ('SUPPORTED', 'CONTRADICTED', 'MIXED', 'UNKNOWN')) as claims, max(doc_id) as latest, arg_max(lang, doc_id) as latest_lang from segs group by source")
def story_card(spark: SparkSession, d: str) -> DataFrame:
    scored = F.col("label") != "OTHER"
    return segments(spark, d).groupBy("source").agg(F.round(F.avg(F.when(scored, F.col("n_chars"))), 6).alias("avg_score"), F.count_if(F.col("label").isin("SUPPORTED", "CONTRADICTED", "MIXED", "UNKNOWN")).alias("claims"), F.max("doc_id").alias("latest"), F.max_by("lang", "doc_id").alias("latest_lang"))


@query(f"with {SEGMENTS} select source, label, cast(floor(100.0 * count(*) / sum(count(*)) over (partition by source) + 0.5) as bigint) as pct from segs where label <> 'OTHER' group by source, label")
def verdict_distribution(spark: SparkSession, d: str) -> DataFrame:
    n = segments(spark, d).where("label <> 'OTHER'").groupBy("source", "label").agg(F.count("*").alias("n"))
    return n.select("source", "label", S.percent(F.col("n"), F.sum("n").over(Window.partitionBy("source"))).alias("pct"))


@query("select (select count(*) from documents) as documents, (select count(*) from labels) as labels, (select count(*) from pages) as pages")
def exact_counts(spark: SparkSession, d: str) -> DataFrame:
    one = [table(spark, d, t).agg(F.count("*").alias(t)) for t in ("documents", "labels", "pages")]
    return one[0].join(one[1]).join(one[2])  # one row each


