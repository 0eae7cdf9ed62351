"""Operator 10: WARC records, and not-modified revisits resolved to the responses they stand for.

A revisit that a server answered "not modified" has no body. It stands for the latest earlier full response of the same
canonical URL, if that response's validators agree (entity tag, else last-modified time): an as-of join. The resolved
record has the response's headers, updated by those of the revisit that such an answer may change.

The join is by range: records are sorted by (URL, time, id) into partitions of equal size, whatever the URLs; within a
partition a window carries the latest response forward; what a partition carries over to the next is one row each, joined
up in order on the driver (one row a partition). A URL with a third of all records is spread over many partitions.

Defined results: a null or empty URL has no canonical form and its revisits have no response; records of equal time are
ordered by id; a revisit without validators agrees with none; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialise, prepare

#: Headers of a full response that a not-modified answer never replaces (they describe the stored body or the connection).
FIXED_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "trailer", "transfer-encoding", "upgrade")
RESPONSE, REVISIT = "response", "revisit"
DAY = 86_400


def canonical(url: Column) -> Column:
    """Host in lower case without www. and default port, path without final slashes, parameters sorted and without utm_ ones;
    scheme and fragment go. Null for null and empty URLs."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    raw = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(raw), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(F.length(bare) > 0, F.concat(host, path, F.lit("/"), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit of records (record_id long, url, ts long, kind, headers map<string,string>): its canonical URL,
    the response it stands for, the verdict, and the merged headers (lower-case names)."""
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    names = F.transform(F.map_keys(own), lambda k: F.lower(k))
    first = F.filter(F.map_entries(own), lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)  # of names that differ in case only
    lowered = F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    rows = records.select("record_id", canonical(F.col("url")).alias("canon"), "ts", "kind", lowered.alias("headers"))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.where(F.col("kind").isin(RESPONSE, REVISIT)).repartitionByRange(parts, F.col("canon"), F.col("ts"), F.col("record_id"))
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()))
    mine = F.when((F.col("kind") == RESPONSE) & F.col("canon").isNotNull(), F.struct("record_id", "headers"))
    here = Window.partitionBy("part", "canon").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = ranged.withColumn("found", F.last(mine, ignorenulls=True).over(here)).where(F.col("kind") == REVISIT)
    # what each partition hands on: its first and last URL, and the last response of the last one
    ends = ranged.where("canon is not null").groupBy("part").agg(
        F.min("canon").alias("first"), F.max("canon").alias("last"),
        F.max(F.when(F.col("kind") == RESPONSE, F.struct("canon", "ts", "record_id"))).alias("latest"),
    )
    carried, into = None, []
    for r in sorted(ends.collect(), key=lambda r: r.part):  # one short row a partition
        if carried and carried[0] == r.first:
            into.append((r.part, r.first, carried[1]))
        if r.latest is not None and r.latest.canon == r.last:
            carried = (r.last, r.latest.record_id)
        elif not (carried and carried[0] == r.last):
            carried = None
    spark = records.sparkSession
    brought = spark.createDataFrame(into, "part int, canon string, came long")
    origin = ranged.where(F.col("kind") == RESPONSE).join(F.broadcast(brought.select(F.col("came").alias("record_id")).distinct()), "record_id").select(F.col("record_id").alias("came"), F.struct("record_id", "headers").alias("brought"))
    brought = brought.join(F.broadcast(origin.dropDuplicates(["came"])), "came").drop("came")
    rows = seen.join(F.broadcast(brought), ["part", "canon"], "left").withColumn("of", F.coalesce("found", "brought"))
    old, new = F.col("of.headers"), F.col("headers")
    same = lambda name: F.element_at(old, name) == F.element_at(new, name)
    agrees = F.when(F.element_at(new, "etag").isNotNull(), same("etag")).otherwise(same("last-modified"))
    verdict = F.when(F.col("of").isNull(), "no_earlier_response").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("validators_differ")
    update = F.map_filter(new, lambda k, v: ~k.isin(*FIXED_HEADERS))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    rows = rows.withColumn("verdict", verdict)
    return rows.select("record_id", "canon", "ts", F.col("of.record_id").alias("response_id"), "verdict", F.when(F.col("verdict") == "resolved", merged).alias("merged"))


def page_records(pages: DataFrame) -> DataFrame:
    """Two records for each page: the full response, a minute of its own, and a not-modified answer a day later."""
    tag, at = F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.col("page_id") * 60
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    heads = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    response = F.struct((F.col("page_id") * 2).alias("record_id"), at.alias("ts"), F.lit(RESPONSE).alias("kind"), heads("Content-Type", "text/html", "Content-Length", size, "ETag", tag, "Date", at.cast("string")).alias("headers"))
    revisit = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (at + DAY).alias("ts"), F.lit(REVISIT).alias("kind"), heads("Content-Length", "0", "ETag", tag, "Date", (at + DAY).cast("string"), "Cache-Control", "max-age=60").alias("headers"))
    return pages.select("url", F.explode(F.array(response, revisit)).alias("r")).select("url", "r.*")


def page_revisits(pages: DataFrame) -> DataFrame:
    """The revisits of page_records, resolved: one row for each page."""
    rows = resolve(page_records(pages))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return rows.select(F.floor((F.col("record_id") - 1) / 2).alias("page_id"), "canon", F.floor(F.col("response_id") / 2).alias("response_page_id"), "verdict", lines.alias("headers"))


ORACLE = rf"""
with bare as (select page_id, md5(coalesce(html, '')) as tag, strlen(coalesce(html, '')) as size, page_id * 60 as ts, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from pages),
parts as (select *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') as host, regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '(?s)^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))), '&') as kept from bare),
urls as (select page_id, tag, size, ts, case when length(b) > 0 then host || path || '/' || case when kept <> '' then '?' || kept else '' end end as canon from parts),
pairs as (select v.page_id, v.canon, r.page_id as response_page_id, v.tag, r.tag as old_tag, r.size, v.ts + {DAY} as answered,
  row_number() over (partition by v.page_id order by r.ts desc nulls last, r.page_id desc) as n
  from urls v left join urls r on v.canon = r.canon and r.ts <= v.ts + {DAY} and (r.ts < v.ts + {DAY} or r.page_id * 2 < v.page_id * 2 + 1))
select page_id, canon, response_page_id, case when response_page_id is null then 'no_earlier_response' when tag = old_tag then 'resolved' else 'validators_differ' end as verdict,
  case when tag = old_tag then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || answered || chr(10) || 'etag: ' || tag end as headers
from pairs where n = 1"""


# Files: records as bytes and back.


def written(record_type: str, record_id: str, uri: str | None, date: str, headers: dict[str, str], body: bytes) -> bytes:
    """One WARC/1.1 record whose block is an HTTP answer."""
    status = "HTTP/1.1 304 Not Modified" if record_type == REVISIT else "HTTP/1.1 200 OK"
    block = "\r\n".join([status, *(f"{k}: {v}" for k, v in headers.items()), "", ""]).encode() + body
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", *([f"WARC-Target-URI: {uri}"] if uri else []), f"WARC-Date: {date}"]
    if record_type == REVISIT:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified")
    return "\r\n".join([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """WARC data piece by piece; compressed data member by member, however many there are. Damaged ends are dropped."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + size] for k in range(0, len(data), size))
        return
    rest = data
    try:
        while rest[:2] == b"\x1f\x8b":
            tool = zlib.decompressobj(31)
            while True:
                piece = tool.decompress(rest, size)
                rest = tool.unconsumed_tail
                if piece:
                    yield piece
                if tool.eof or not (rest or piece):
                    break
            rest = tool.unused_data
    except zlib.error:
        return


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line for k, v in [line.split(":", 1)]}


def parsed(data: bytes) -> Iterator[tuple[str, str, str | None, str, dict[str, str], bytes]]:
    """(type, id, URI, date, HTTP headers, body) of each record of WARC data, compressed or not; stops where the data is cut off.
    One record is held at a time."""
    held, more = bytearray(), _pieces(data)

    def grown() -> bool:
        piece = next(more, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:-4]
            if not grown():
                return
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not grown():
                return
        head = _fields(bytes(held[:end]))
        length = head.get("content-length", "")
        stop = end + 4 + (int(length) if length.isdigit() else 0)
        while len(held) < stop:
            if not grown():
                return
        block = bytes(held[end + 4 : stop])
        del held[:stop]
        http, _, body = block.partition(b"\r\n\r\n")
        answer = http.startswith(b"HTTP/")
        yield head.get("warc-type", ""), head.get("warc-record-id", "").strip("<>"), head.get("warc-target-uri"), head.get("warc-date", ""), _fields(http) if answer else {}, body if answer else block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at a path, .warc and .warc.gz, which only Spark needs to reach: (type, id, url, date, headers,
    body). A task holds a file as it is stored (2 GB at most) and a few records of it."""
    names = ["type", "id", "url", "date", "headers", "body"]
    kinds = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(r[j].items()) if j == 4 else r[j] for r in rows], kinds[j]) for j in range(6)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for r in parsed(data):
                    rows.append(r)
                    size += len(r[5])
                    if len(rows) == 1024 or size > 16 << 20:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    prepare(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "type string, id string, url string, date string, headers map<string,string>, body binary")


__all__ = ["canonical", "page_records", "page_revisits", "parsed", "read_warc", "resolve", "written"]
