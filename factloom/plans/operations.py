"""Pipeline operations over `events`: event_type is the stage, value the duration, 'error' the failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.operators import ideology, scans, tables
from factloom.plans.registry import query
from factloom.session import scratch_folder, table
from factloom.streaming import breaker, status

_STAMP = "yyyy-MM-dd HH:mm:ss"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """pipeline_stage_metrics: a row fails where its k is a multiple of 7."""
    failed = F.get_json_object("props", "$.k").cast("int") % 7 == 0
    return table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("stage"), F.col("value").alias("duration"), F.when(failed, "failed").otherwise("ok").alias("status"), "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


_METRICS = "metrics as (select event_id, ts, event_type as stage, value as duration, case when cast(json_extract_string(props, '$.k') as int) % 7 = 0 then 'failed' else 'ok' end as status, user_id, cast(json_extract_string(props, '$.k') as int) as k from events)"


@query(f"""with {_METRICS} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, stage, count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'failed') as failed,
 round(count(*) filter (status = 'failed') / count(*), 4) as fail_rate, percentile_disc(0.5) within group (order by duration) as p50, percentile_disc(0.95) within group (order by duration) as p95 from metrics group by all""")
def stage_metrics_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Counts by partial aggregation; percentiles by running counts over values, without a buffer that holds a group's values."""
    m = metrics(spark, d).withColumn("hour", F.date_format(F.date_trunc("hour", "ts"), _STAMP))
    counts = m.groupBy("hour", "stage").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.count_if(F.col("status") == "failed") / F.count("*"), 4).alias("fail_rate"),
    )
    return counts.join(scans.percentiles(m, ["hour", "stage"], "duration", {"p50": 0.5, "p95": 0.95}), ["hour", "stage"], "left")


@query("select coalesce(string_agg(event_type || '=' || n, ',' order by event_type), '') as counts from (select event_type, count(*) as n from events group by event_type)")
def status_count_map(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string"))))
    return n.agg(F.array_join(entries, ",").alias("counts"))


@query("select source as feed_id, coalesce(case when l.quality = 1 then 'aggregated' when l.quality = 0 then 'failed' end, 'unknown') as status, count(*) as n from documents d left join labels l using (doc_id) where source is not null group by source, l.quality")
def feed_status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").where("source is not null")
    name = F.coalesce(F.when(F.col("quality") == 1, "aggregated").when(F.col("quality") == 0, "failed"), F.lit("unknown"))
    return rows.groupBy("source", "quality").agg(F.count("*").alias("n")).select(F.col("source").alias("feed_id"), name.alias("status"), "n")


@query(f"""with {_METRICS} select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, stage, count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'failed') as failed,
 round(100.0 * count(*) filter (status = 'failed') / count(*), 2) as failed_pct, round(avg(duration), 2) as mean_duration, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_run from metrics group by all""")
def runs_daily(spark: SparkSession, d: str) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return metrics(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "stage").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), failed.alias("failed"), F.round(100.0 * failed / F.count("*"), 2).alias("failed_pct"),
        F.round(F.avg("duration"), 2).alias("mean_duration"), F.date_format(F.max("ts"), _STAMP).alias("last_run"),
    )


@query(f"""with {_METRICS}, n as (select max(ts) as now from metrics),
 slo as (select stage, round(count(*) filter (status = 'failed') / count(*), 4) as fail_rate from metrics, n where ts > now - interval 1 hour group by stage)
 select (select count(*) from metrics where k < 50) as queue_depth, (select count(*) from metrics where status = 'failed' and k > 60) as dlq,
 coalesce((select string_agg(stage, ',' order by stage) from (select stage from metrics group by stage having count(*) filter (status = 'failed') * 7 > count(*))), '') as paused,
 coalesce((select string_agg(stage || ':' || cast(cast(fail_rate * 10000 as bigint) as varchar), ',' order by fail_rate desc, stage) from slo), '') as slo""")
def ops_summary(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    now = m.agg(F.max("ts").alias("now"))
    slo = m.join(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.expr("interval 1 hour")).groupBy("stage").agg(F.round(F.count_if(F.col("status") == "failed") / F.count("*"), 4).alias("fail_rate"))
    slo = slo.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("fail_rate")).alias("r"), "stage"))), lambda s: F.concat(s["stage"], F.lit(":"), F.round(-s["r"] * 10000).cast("long").cast("string"))), ",").alias("slo"))
    paused = m.groupBy("stage").agg(F.count_if(F.col("status") == "failed").alias("f"), F.count("*").alias("n")).where("f * 7 > n").agg(F.array_join(F.array_sort(F.collect_list("stage")), ",").alias("paused"))
    head = m.agg(F.count_if(F.col("k") < 50).alias("queue_depth"), F.count_if((F.col("status") == "failed") & (F.col("k") > 60)).alias("dlq"))
    return head.join(F.broadcast(paused)).join(F.broadcast(slo))  # one row each


@query(f"""with {_METRICS}, r as (select * from metrics order by ts desc, event_id desc limit 100)
 select stage, count(*) as volume, count(*) filter (status = 'ok') as ok, count(*) filter (status <> 'ok') as fail, cast(floor(avg(duration) + 0.5) as bigint) as mean_ms, floor(1000.0 * count(*) filter (status <> 'ok') / count(*) + 0.5) / 10 as fail_pct from r group by stage""")
def stage_summary_recent(spark: SparkSession, d: str) -> DataFrame:
    recent = metrics(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    bad = F.count_if(F.col("status") != "ok")
    return recent.groupBy("stage").agg(F.count("*").alias("volume"), F.count_if(F.col("status") == "ok").alias("ok"), bad.alias("fail"), F.floor(F.avg("duration") + 0.5).alias("mean_ms"), (F.floor(1000.0 * bad / F.count("*") + 0.5) / 10).alias("fail_pct"))


@query(f"""with {_METRICS}, c as (select count(*) as n, count(*) filter (status = 'failed') as failed, least(count(*) filter (status = 'failed' and k > 60), 20) as dlq from metrics),
 p as (select count(*) as paused from (select stage from metrics group by stage having count(*) filter (status = 'failed') * 7 > count(*)))
 select n as metrics, failed, dlq, paused, case when failed > 10 or dlq > 10 or paused > 2 or n = 0 then 'unhealthy' when failed > 0 or dlq > 0 or paused > 0 then 'degraded' else 'healthy' end as level from c, p""")
def health_level(spark: SparkSession, d: str) -> DataFrame:
    failed, m = F.col("status") == "failed", metrics(spark, d)
    c = m.agg(F.count("*").alias("metrics"), F.count_if(failed).alias("failed"), F.least(F.count_if(failed & (F.col("k") > 60)), F.lit(20)).alias("dlq"))
    paused = m.groupBy("stage").agg((F.count_if(failed) * 7 > F.count("*")).alias("paused")).agg(F.count_if("paused").alias("paused"))
    bad = (F.col("failed") > 10) | (F.col("dlq") > 10) | (F.col("paused") > 2) | (F.col("metrics") == 0)
    level = F.when(bad, "unhealthy").when((F.col("failed") > 0) | (F.col("dlq") > 0) | (F.col("paused") > 0), "degraded").otherwise("healthy")
    return c.join(F.broadcast(paused)).withColumn("level", level)  # one row each


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, cast(json_extract_string(props, '$.k') as int) >= 50 as high from events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"), (k >= 50).alias("high"))


_STATUSES = ("pending", "classifying", "verifying", "aggregated", "failed")
_TYPES = ("signup", "view", "click", "purchase", "error")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """document_status_changes: one row an event, user as the document."""
    named = F.create_map(*(F.lit(x) for kv in zip(_TYPES, _STATUSES, strict=True) for x in kv))
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.coalesce(F.try_element_at(named, F.col("event_type")), F.lit("failed")).alias("status"), F.col("event_id").alias("seq"))


_CHANGES = "changes as (select user_id as doc_id, case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in zip(_TYPES, _STATUSES, strict=True)) + " else 'failed' end as status, event_id as seq from events)"
_FANOUT = "fanout(status, stage) as (values " + ", ".join(f"('{s}', '{x}')" for s, one in K.STATUS_STAGE.items() for x in K.STATUS_FANOUT.get(s, (one,))) + ")"


_JOBS = f"""with {_CHANGES}, {_FANOUT}, b as (select *, lag(status) over (partition by doc_id order by seq) as before from changes)
 select distinct doc_id, stage, b.status || ':' || seq as token from b join fanout using (status) where before is distinct from b.status"""


@query(_JOBS)
def enqueue_guard(spark: SparkSession, d: str) -> DataFrame:
    return status.status_jobs(_changes(spark, d))


@query(f"""with {_METRICS}, i as (select stage, event_id as seq, status = 'failed' as failed, sum(case when status = 'failed' then 0 else 1 end) over (partition by stage order by event_id rows unbounded preceding) as island from metrics),
 s as (select stage, seq, failed, sum(cast(failed as int)) over (partition by stage, island order by seq rows unbounded preceding) as streak from i)
 select stage, seq, failed, cast(streak as bigint) as streak, failed and streak >= {K.BREAKER_STREAK} as pauses from s""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return status.breaker(metrics(spark, d).select("stage", F.col("event_id").alias("seq"), (F.col("status") == "failed").alias("failed")))


@query("""with j as (select event_id, case when k % 11 = 0 then 'deferred' when k % 5 = 0 then 'skipped' when k % 7 <> 0 then 'ok' else 'failed' end as metric, k % 4 as attempt from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events))
 select event_id, metric, case metric when 'deferred' then 'requeue' when 'failed' then case when attempt < 3 then 'retry' else 'dead_letter' end else 'done' end as action from j""")
def stage_runner(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    jobs = metrics(spark, d).select("event_id", "k", F.lit("CLASSIFY").alias("stage"), (k % 11 == 0).alias("paused"), F.lit(None).cast("timestamp").alias("paused_until"), F.lit("pending").alias("expected_status"), F.when(k % 5 == 0, "failed").otherwise("pending").alias("document_status"), (k % 7 != 0).alias("ok"), (k % 4).alias("attempt"))
    return status.next_state(jobs, F.lit("2024-01-01").cast("timestamp")).select("event_id", "metric", "action")


@query(f"""with {_METRICS}, p as (select * from (select event_id as id, k % 13 as attempts from metrics) where attempts >= {K.POISON_ATTEMPTS} order by id limit 200) select id, attempts from p""")
def poison_reaper(spark: SparkSession, d: str) -> DataFrame:
    return status.poisoned(metrics(spark, d).select(F.col("event_id").alias("id"), (F.col("k") % 13).alias("attempts")))[0]


@query("select strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by all")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = status.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return rows.select(F.date_format("start", _STAMP).alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    old, new = e.where("event_type <> 'error'"), e
    return tables.upsert(old, new, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query("select strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%dT%H:%M:%S.000Z') as bucket, count(*) as n from events group by all")
def event_bucket(spark: SparkSession, d: str) -> DataFrame:
    from factloom.functions import scores as S

    return table(spark, d, "events").groupBy(S.iso_bucket(F.col("ts").cast("timestamp")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""with u as (select user_id, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by user_id)
 select e.event_id, sha256('OTHER|US|' || strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%dT%H:%M:%S.000Z') || '|' || u.kinds) as event_key from events e join u using (user_id)""")
def event_key(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.events import keyed

    e = table(spark, d, "events")
    kinds = e.groupBy("user_id").agg(F.collect_set("event_type").alias("entities"))
    docs = e.join(kinds, "user_id").select("event_id", F.lit("OTHER").alias("event_type"), F.lit("US").alias("geo"), F.col("ts").cast("timestamp").alias("published_at"), "entities")
    return keyed(docs).select("event_id", "event_key")


@query("""select o_orderkey as doc_id, strftime(bucket, '%Y-%m-%d %H:%M:%S') as bucket from orders join (select distinct time_bucket(interval 6 hours, ts) as bucket from events) e
 on abs(epoch_us(o_orderdate + interval 29 years) - epoch_us(bucket)) <= 72 * 3600000000""")
def interval_match(spark: SparkSession, d: str) -> DataFrame:
    from factloom.functions import scores as S
    from factloom.operators.events import interval_pairs

    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderdate") + F.expr("interval 29 years")).cast("timestamp").alias("at"))
    events = table(spark, d, "events").select(S.bucket_6h(F.col("ts").cast("timestamp")).alias("bucket")).distinct().withColumn("event_id", F.unix_timestamp("bucket"))
    return interval_pairs(docs, events).select("doc_id", F.date_format("bucket", _STAMP).alias("bucket"))


@query(_JOBS)
def stage_events_stream(spark: SparkSession, d: str) -> DataFrame:
    """status_stream over the event table as a stream, run to its end; the rows equal enqueue_guard's."""
    named = F.create_map(*(F.lit(x) for kv in zip(_TYPES, _STATUSES, strict=True) for x in kv))
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select(F.col("user_id").alias("doc_id"), F.coalesce(F.try_element_at(named, F.col("event_type")), F.lit("failed")).alias("status"), F.col("event_id").alias("seq"))
    out, state = scratch_folder(spark, "jobs"), scratch_folder(spark, "jobs-state")
    jobs = status.status_stream(rows)
    jobs.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(jobs.schema).parquet(out)


@query(f"""with m as (select event_type as stage, row_number() over (partition by event_type order by ts, event_id) as seq, epoch_us(ts) as moment, cast(json_extract_string(props, '$.k') as int) >= 25 as failed from events),
 r as (select *, sum(case when failed then 0 else 1 end) over (partition by stage order by seq rows unbounded preceding) as row from m),
 s as (select *, sum(failed::int) over (partition by stage, row order by seq rows unbounded preceding) as streak from r),
 h as (select *, coalesce(moment >= lag(moment) over (partition by stage, row order by streak) + {breaker.MICROS}, true)::int as new from s where failed and streak >= 5),
 n as (select *, sum(new) over (partition by stage, row order by streak rows unbounded preceding) as nth from h),
 p as (select stage, row, min(moment) as paused_at, max(moment) + {breaker.MICROS} as until from n group by stage, row, nth),
 o as (select stage, row - 1 as row, moment as success from r where not failed)
 select stage, paused_at, case when success >= paused_at and success < until then success else until end as ended_at, case when success >= paused_at and success < until then 'success' else 'time' end as ended_by from p left join o using (stage, row)""")
def breaker_pauses(spark: SparkSession, d: str) -> DataFrame:
    """When each stage was paused and what ended it: five failures in a row, five minutes, or the next success."""
    rows = scans.numbered(table(spark, d, "events").select(F.col("event_type").alias("stage"), "ts", "event_id", (F.get_json_object("props", "$.k").cast("int") >= 25).alias("failed")), ["stage"], ["ts", "event_id"], "seq")
    return breaker.pauses(rows.select("stage", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "failed"))


_SCORED = "docs as (select doc_id as id, case when quality = 1 then 's' end as strip, case when toxic = 0 then 0.5 end as grounding_score, doc_id % 97 as created_at from labels)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "labels")
    return one.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "s").alias("strip"), F.when(F.col("toxic") == 0, 0.5).alias("grounding_score"), F.when(F.col("toxic") == 0, 0.5).alias("integrity_score"), F.lit("aggregated").alias("pipeline_status"), (F.col("doc_id") % 97).alias("created_at"))


@query(f"with {_SCORED} select id, strip is not null as has_strip, grounding_score is not null as has_scores from (select * from docs where strip is not null or grounding_score is not null order by created_at, id limit 50)")
def rescore_preview(spark: SparkSession, d: str) -> DataFrame:
    return tables.rescore_preview(_scored(spark, d), 50)


@query(f"""with {_SCORED}, p as (select id from docs where strip is not null or grounding_score is not null order by created_at, id limit 50)
 select p.id as doc_id, count(c.conv_id) as claims_reset, true as scores_cleared, false as synthesis_cleared from p left join conversations c on c.conv_id = p.id group by p.id""")
def rescore_reset(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.lit("SUPPORTED").alias("veracity_label"))
    return tables.rescore_reset(_scored(spark, d), claims, 50)[2]


@query("""select o_orderkey, count(*) as n_lines, string_agg(l_linenumber || ':' || cast(l_quantity as bigint), ',' order by l_linenumber, l_quantity) as lines from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def nested_export(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    rows = tables.nested(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "lines", ["l_linenumber"]).where("lines is not null")
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_quantity"].cast("long").cast("string"))), ",")
    return rows.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), text.alias("lines"))


@query("""with c as (select c_custkey from customer where c_mktsegment <> 'BUILDING'), o as (select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING'))
 select 'orders' as name, o_orderkey as key, 0 as line from o union all select 'lineitem', l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING'))""")
def cascade_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a segment go, with them their orders and the orders' lines."""
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    orders, left = tables.cascade(gone, [(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey"), (lines, "l_linenumber", "l_orderkey")])
    return orders.select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("key"), F.lit(0).alias("line")).unionAll(left.select(F.lit("lineitem").alias("name"), "l_orderkey", "l_linenumber"))


@query("select coalesce(a.url, b.url) as url, a.url is not null as was_there from (select distinct url from pages where url like 'https%') a full join (select distinct url from pages) b using (url)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "pages").select("url").distinct()
    old = urls.where("url like 'https%'").withColumn("was_there", F.lit(True))
    return tables.insert_if_absent(old, urls.withColumn("was_there", F.lit(False)), "url")


@query("""with r as (select 0 as part, null::timestamp as moment, printf('%08d', i) as name, 'https://site.test' || p as loc, null::varchar as day from (values (0, '/'), (1, '/a&amp;b')) t(i, p)
 union all select 1, o_orderdate, o_orderkey::varchar, 'https://site.test/documents/' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d') from orders
 union all select 2, null, n_name, 'https://site.test/publishers/' || replace(n_name, ' ', '+'), strftime(max(o_orderdate), '%Y-%m-%d') from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by n_name)
 select row_number() over (order by part, moment desc nulls last, name) as nth, '  <url><loc>' || loc || '</loc>' || coalesce('<lastmod>' || day || '</lastmod>', '') || '</url>' as xml from r""")
def sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Static routes, documents newest first, and publishers with the date of their newest document, written as ordered text and
    read again with the number of each line."""
    orders = table(spark, d, "orders")
    docs = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    of = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = scratch_folder(spark, "sitemap")
    tables.written_sitemap(tables.sitemap("https://site.test", ["/", "/a&b"], docs, of.select(F.col("n_name").alias("name"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))), path)
    lines = spark.read.text(path).select("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"), F.col("value").alias("xml"))  # files are named in order
    return scans.numbered(lines, [], ["file_name", "file_block_start", "at"], "nth").select("nth", "xml")


@query("select user_id, event_id, k from (select user_id, event_id, cast(json_extract_string(props, '$.k') as int) as k, row_number() over (partition by user_id, event_type order by cast(json_extract_string(props, '$.k') as int) desc, event_id desc) as nth, count(*) over (partition by user_id) as n, (select count(distinct event_type) from events x where x.user_id = e.user_id) as kinds from events e) where kinds < 2 or nth <= greatest(1, ceil(n * 0.4))")
def domain_cap(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.ideology import cap_domains

    votes = metrics(spark, d).select("user_id", F.col("event_id").alias("idx"), F.col("stage").alias("domain"), F.col("k").alias("confidence"))
    return cap_domains(votes, "user_id").select("user_id", F.col("idx").alias("event_id"), F.col("confidence").alias("k"))


@query(f"""with recursive {_METRICS}, votes as (select user_id as key, 'all' as axis, event_id as proposition_id, case when stage in ('view', 'purchase') then 1.0::double else 0 end as y, ((k % 5 - 2) / 2)::double as b from metrics), {ideology.ESTIMATE_SQL}
 select key as user_id, score, theta_raw, se, n_propositions from estimates""")
def irt_map(spark: SparkSession, d: str) -> DataFrame:
    """Ability of each user: events are votes, difficulty from k."""
    votes = metrics(spark, d).select("user_id", F.col("event_id").alias("proposition_id"), F.col("stage").isin("view", "purchase").cast("double").alias("y"), ((F.col("k") % 5 - 2) / 2).cast("double").alias("b"))
    return ideology.estimate(votes, "user_id")


