"""What is written again: segments, clusters, stamps, feeds, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import tables
from factloom.operators.stored import StoredTable
from factloom.plans.inputs import _text
from factloom.plans.registry import query
from factloom.session import scratch_folder, table
from factloom.streaming import status


@query("""select doc_id, 0 as position, md5(text) as digest from documents where lang <> 'de' or lang is null union all select doc_id, 1 as position, md5(text) from documents where lang <> 'de' or lang is null
 union all select doc_id, 0 as position, md5('new ' || text) from documents where lang = 'de'""")
def reindex_segments(spark: SparkSession, d: str) -> DataFrame:
    """Two segments a document; German documents are indexed again and have one."""
    docs, digest = table(spark, d, "documents").select("doc_id", "lang", "text"), lambda c: F.md5(c.cast("binary")).alias("digest")
    old = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), digest(F.col("text")))
    new = docs.where("lang = 'de'").select("doc_id", F.lit(0).alias("position"), digest(_text("new ", F.col("text"))))
    return tables.replace_groups(old, new, "doc_id")


@query("select label as cluster, count(*) as n, min(vec_id) as first from embeddings where label % 2 = 0 group by label")
def cluster_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Clusters written whole twice: nothing of the first run is left."""
    e = table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    path = scratch_folder(spark, "clusters")
    tables.overwrite(e.where("cluster % 2 = 1"), path)
    tables.overwrite(e.where("cluster % 2 = 0"), path)
    return spark.read.parquet(path)


@query("select c_custkey, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, case when c_custkey % 3 = 0 then '2024-02-01 00:00:00' else '2024-01-01 00:00:00' end as updated_at from customer")
def updated_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Changed rows get the time of the change, others keep theirs."""
    at = lambda s: F.lit(s).cast("timestamp")
    c = tables.stamped(table(spark, d, "customer").select("c_custkey", "c_acctbal"), at("2024-01-01"))
    changed = F.col("c_custkey") % 3 == 0
    new = tables.stamped(c.where(changed).withColumn("c_acctbal", F.col("c_acctbal") + 1), at("2024-02-01"))
    return c.where(~changed).unionByName(new).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("""select n_nationkey as id, 'https://f/' || n_nationkey as url, case when n_nationkey = 3 then 'reference' else 'wire' end as source_category, case when n_nationkey = 3 then 60 else 30 end as polling_interval_minutes, true as is_active from nation where n_nationkey <> 5
 union all select 100, 'https://new/', 'mainstream', 15, true""")
def feed_admin(spark: SparkSession, d: str) -> DataFrame:
    """A new feed with its defaults, a known one passed over, one changed, one deleted."""
    f = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), _text("https://f/", F.col("n_nationkey")).alias("url"), F.lit("wire").alias("source_category"), F.lit(30).alias("polling_interval_minutes"), F.lit(True).alias("is_active"))
    new = spark.createDataFrame([(100, "https://new/", None, None, None), (101, "https://f/1", "fringe", 5, False)], "id int, url string, source_category string, polling_interval_minutes int, is_active boolean")
    changed = tables.feed_update(tables.feed_insert(f, new), 3, {"source_category": "reference", "polling_interval_minutes": 60})
    return tables.feed_delete(changed, 5)


@query("select event_id from events where event_id % 4 = 0 or ts <= timestamp '2024-01-15 00:00:00'")
def delayed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose time has come; those without one are always ready."""
    jobs = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp")).alias("run_at"))
    return status.runnable(jobs, F.lit("2024-01-15").cast("timestamp")).select("event_id")


@query("""with s as (select o_orderkey as doc_id from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 50) select doc_id, stage from s, (values ('EVIDENCE'), ('VERACITY')) t(stage)""")
def stuck_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The fifty oldest documents of a status once more, to each of its stages."""
    state = F.when(F.col("o_orderstatus") == "F", "verifying").otherwise("pending")
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), state.alias("pipeline_status"))
    return status.stuck(docs, "verifying")


@query("""with t as (select *, max(ts) over () as top from events), b as (select time_bucket(interval 6 hours, ts) as start, event_type, value, time_bucket(interval 6 hours, ts) + interval 6 hours <= max(top) over () - interval 1 day as closed from t)
 select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(avg(value), 6) as mean from b where closed group by start, event_type""")
def late_rows_stream(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a stream with a watermark of a day: a window is given out once no row can come to it any more."""
    path = scratch_folder(spark, "windows")
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = status.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "1 day")
    counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch_folder(spark, "windows-state")).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(counts.schema).parquet(path).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


_LAST = "last as (select * from (select *, row_number() over (partition by client_id order by seq desc, change_id desc, valid_at desc, balance desc) as nth from client_changes where client_id is not null and op <> 'D') where nth = 1)"


@query(f"""with {_LAST} select coalesce(c.client_id, l.client_id) as client_id, coalesce(l.seq, -1) as seq, case when l.client_id is null then c.segment else l.segment end as segment, case when l.client_id is null then c.city else l.city end as city, case when l.client_id is null then c.balance else l.balance end as balance
 from clients c full join last l on l.client_id = c.client_id""")
def stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Clients in a stored table, their changes written into the buckets that they fall into, and the table read again."""
    path = scratch_folder(spark, "clients")
    stored = StoredTable(spark, path, "client_id")
    stored.create(table(spark, d, "clients").select("client_id", F.lit(-1).cast("long").alias("seq"), "segment", "city", "balance"))
    changes = table(spark, d, "client_changes").where("client_id is not null and op <> 'D'")
    last = changes.groupBy("client_id").agg(F.max(F.struct("seq", "change_id", "valid_at", "balance", "segment", "city")).alias("x"))
    stored.upsert(last.select("client_id", "x.seq", "x.segment", "x.city", "x.balance"), "seq")
    return stored.read()
