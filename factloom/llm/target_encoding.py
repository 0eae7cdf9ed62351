"""Operator 12: time-ordered target encoding by segmented cumulative sums over a global range partitioning.

Each level is a column whose values share a history: all lines, an item's kind, a vendor's nation, a client's segment, the item, the
vendor, the client. Lines are summed to one row a (sale, item, vendor), and to one a sale for the levels that a sale fixes. Every row
gives an entry a level; all entries of all levels are sorted together by (level, key, time, hash of the row) into ranges of equal
size, so a hot key, the level of all lines and many rows at one moment are dealt like any others. Within a range, mapInPandas makes
segmented cumulative sums in numpy, batch by batch: what a key had strictly before the moment, in the four other folds. Each range
also says what its last key had so far. The driver adds these up, one row a range (the session's shuffle partitions, RANGES at
most, whatever the input), into what each range's first key brings along; a second pass adds that. Entries then go back to their rows.

Defined results: a line without a sale or time is dropped; a null item or client id is -1, an ordinary id; a null vendor id is an
ordinary id too, and stays null; unknown ids and those of null kind, nation or segment share a value; a repeated line counts each
time; a null or other flag is no return; lines of one microsecond are no history of each other; of several rows of one sale the
earliest counts, then that of the smallest client, of one item, vendor or client the smallest value; other columns are ignored; empty
tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fold, prepare
from factloom.session import scratch_table

FOLDS, SMOOTHING, SCALE, PRIOR = 5, 50, 1_000_000, 500_000
RETURNED = "returned"
RANGES = 4096
BATCH = 65_536
ALL, KIND, NATION, SEGMENT, ITEM, VENDOR, CLIENT = range(7)
_KEY = ("level", "key", "name")


@dataclass
class Carry:
    """The last (level, key, name) of what was read, its last moment, and counts by fold (lines, then returned ones): strictly
    before that moment, and all."""

    key: tuple | None = None
    time: int = 0
    before: np.ndarray = field(default_factory=lambda: np.zeros(2 * FOLDS, np.int64))
    all: np.ndarray = field(default_factory=lambda: np.zeros(2 * FOLDS, np.int64))

    def then(self, own: Carry) -> Carry:
        """What both bring along, where own was read after self without knowing of it."""
        if own.key is None:
            return self
        if own.key != self.key:
            return own
        before = self.before if own.time == self.time else self.all + own.before
        return Carry(own.key, own.time, before, self.all + own.all)


def _sums(frame: pd.DataFrame, carry: Carry) -> tuple[np.ndarray, np.ndarray, Carry]:
    """History of each entry of a sorted batch (lines, returned ones) in other folds, after what came before, and the new carry."""
    level, key, time = (frame[c].to_numpy() for c in ("level", "key", "time"))
    name = pd.factorize(frame["name"])[0]
    new_key = np.concatenate([[True], (level[1:] != level[:-1]) | (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
    new_time = new_key | np.concatenate([[True], time[1:] != time[:-1]])
    first = np.flatnonzero(new_key)[np.cumsum(new_key) - 1]  # where the entry's key begins
    moment = np.flatnonzero(new_time)[np.cumsum(new_time) - 1]  # where its moment begins
    folds = frame["fold"].to_numpy()
    ran = np.zeros((2 * FOLDS, len(frame) + 1), np.int64)
    for j, c in enumerate(("n", "s")):
        v = frame[c].to_numpy()
        for f in range(FOLDS):
            np.cumsum(np.where(folds == f, v, 0), out=ran[j * FOLDS + f, 1:])
    begin = (int(level[0]), int(key[0]), str(frame["name"].iloc[0]))
    goes_on = (first == 0) & (begin == carry.key)
    at_once = goes_on & (time == carry.time)
    out = []
    for j in range(2):
        part = ran[j * FOLDS : (j + 1) * FOLDS]
        own = (part[:, moment] - part[:, first]).sum(axis=0) - (part[folds, moment] - part[folds, first])
        more = lambda counts: counts[j * FOLDS : (j + 1) * FOLDS].sum() - counts[j * FOLDS + folds]  # noqa: B023, E731
        out.append(own + np.where(at_once, more(carry.before), np.where(goes_on, more(carry.all), 0)))
    last = len(frame) - 1
    own = Carry((int(level[last]), int(key[last]), str(frame["name"].iloc[last])), int(time[last]), ran[:, moment[last]] - ran[:, first[last]], ran[:, -1] - ran[:, first[last]])
    return out[0], out[1], carry.then(own)


_ENTRY = "level int, key long, name string, time long, fold int, sale_id long, item_id long, vendor_id long, no_vendor boolean, n long, s long"
_SUMMED = f"{_ENTRY}, past_n long, past_s long, range int, before array<long>, total array<long>"
_COLUMNS = [c.split()[0] for c in _SUMMED.split(", ")]


def _range(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of one range with their local history, then a row of fold -1 with the range's carry."""
    carry, number = Carry(), TaskContext.get().partitionId()
    for frame in frames:
        if len(frame):
            n, s, carry = _sums(frame, carry)
            yield frame.assign(past_n=n, past_s=s, range=number, before=None, total=None)[_COLUMNS]
    if carry.key:
        yield pd.DataFrame([(*carry.key, carry.time, -1, 0, 0, 0, False, 0, 0, 0, 0, number, carry.before.tolist(), carry.all.tolist())], columns=_COLUMNS)


def _carried(ranges: list) -> list[tuple]:
    """What each range's first key brings along: (range, level, key, name, time, lines and returns before by fold, and in all)."""
    out, carry = [], Carry()
    for r in sorted(ranges, key=lambda r: r.range):
        if carry.key:
            out.append((r.range, *carry.key, carry.time, carry.before.tolist(), carry.all.tolist()))
        carry = carry.then(Carry((r.level, r.key, r.name), r.time, np.array(r.before, np.int64), np.array(r.total, np.int64)))
    return out


@contextmanager
def _large_batches(spark: SparkSession) -> Iterator[None]:
    """Entries are short: batches may hold more of them, still bounded in bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def histories(entries: DataFrame) -> DataFrame:
    """entries (_ENTRY, none null) with past_n and past_s: sums of n and s over the entries of their level, key and name, of
    earlier time and another fold."""
    spark = prepare(entries.sparkSession)
    ranges = min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(c) for c in (*_KEY, "time")] + [F.xxhash64("sale_id", "item_id", "vendor_id")]
    ranged = entries.repartitionByRange(ranges, *order).sortWithinPartitions(*_KEY, "time")
    with _large_batches(spark):
        summed = scratch_table(ranged.mapInPandas(_range, _SUMMED), "target_encoding")
    carried = _carried(summed.where("fold < 0").select("range", *_KEY, "time", "before", "total").collect())  # one row a range
    carries = spark.createDataFrame(carried, "r int, l int, k long, m string, t long, b array<long>, a array<long>")
    same = (F.col("range") == F.col("r")) & (F.col("level") == F.col("l")) & (F.col("key") == F.col("k")) & (F.col("name") == F.col("m"))
    met = summed.where("fold >= 0").join(F.broadcast(carries), same, "left")  # RANGES rows at most

    def more(j: int) -> Column:
        counts = F.slice(F.when(F.col("time") == F.col("t"), F.col("b")).otherwise(F.col("a")), j * FOLDS + 1, FOLDS)
        others = F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y) - F.element_at(counts, F.col("fold") + 1)
        return F.when(F.col("r").isNull(), F.lit(0)).otherwise(others)

    past = {"past_n": F.col("past_n") + more(0), "past_s": F.col("past_s") + more(1)}
    return met.withColumns(past).select(*_COLUMNS[: _COLUMNS.index("range")])


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a time, of one without a zone as it is written."""
    c = F.col(column)
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(second from {column})") * 1_000_000).cast("long")


def _one_each(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with one row a key, as a table of its own: a join to it can still split hot keys."""
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.min(value).alias(value))
    return scratch_table(rows, key)


def _sales(sales: DataFrame, clients: DataFrame) -> DataFrame:
    """(sale_id, time, fold, client_id, segment) with one row a sale."""
    rows = sales.select(F.col("sale_id").cast("long").alias("sale_id"), _micros(sales, "sold_at").alias("time"), F.coalesce(F.col("client_id").cast("long"), F.lit(-1)).alias("client_id"))
    rows = rows.where("sale_id is not null and time is not null").groupBy("sale_id").agg(F.min(F.struct("time", "client_id")).alias("x")).select("sale_id", "x.*")
    rows = rows.join(_one_each(clients, "client_id", "segment"), "client_id", "left").withColumn("fold", fold(F.col("sale_id"), FOLDS).cast("int"))
    return scratch_table(rows.select("sale_id", "time", "fold", "client_id", "segment"), "sales")


def _entries(rows: DataFrame, levels: dict[int, Column]) -> DataFrame:
    """An entry a level of each row. levels: a struct of key and name."""
    made = F.array(*(F.struct(F.lit(level).alias("level"), of["key"].cast("long").alias("key"), of["name"].alias("name")) for level, of in levels.items()))
    vendor = [F.coalesce("vendor_id", F.lit(0)).cast("long").alias("vendor_id"), F.col("vendor_id").isNull().alias("no_vendor")]
    return rows.select(F.explode(made).alias("e"), "time", "fold", "sale_id", "item_id", *vendor, "n", "s").select("e.level", "e.key", "e.name", "time", "fold", "sale_id", "item_id", "vendor_id", "no_vendor", "n", "s")


def _named(column: str) -> Column:
    """A text as key; null is one of its own."""
    c = F.col(column)
    return F.struct(c.isNull().cast("long").alias("key"), F.coalesce(c.cast("string"), F.lit("")).alias("name"))


def _numbered(column: str) -> Column:
    """A number as key; null is one of its own."""
    c = F.col(column)
    return F.struct(F.coalesce(c.cast("long"), F.lit(0)).alias("key"), F.when(c.isNull(), "null").otherwise("").alias("name"))


def _across(found: DataFrame, keys: list[str], levels: dict[int, str]) -> DataFrame:
    """A row of keys with the history of each level as <name>_n and <name>_s."""
    of = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c)))
    past = [of(level, f"past_{c}").alias(f"{name}_{c}") for level, name in levels.items() for c in "ns"]
    return found.where(F.col("level").isin(*levels)).groupBy(*keys).agg(F.max("n").alias("n_lines"), F.max("s").alias("n_returned"), *past)


def _rated(rows: DataFrame, name: str, prior: str) -> DataFrame:
    """rows with <name>_rate: the smoothed share of returns in millionths; without history the prior."""
    n, s = f"{name}_n", f"{name}_s"
    return rows.withColumn(f"{name}_rate", F.expr(f"case when {n} < 1 then {prior} else ({SCALE} * {s} + {SMOOTHING} * {prior}) div ({n} + {SMOOTHING}) end"))


def encode(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """(sale_id, item_id, vendor_id, n_lines, n_returned) of each, with history and rate of item, vendor and client."""
    prepare(lines.sparkSession)
    sold = _sales(sales, clients)
    own = lines.select(F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), F.coalesce((F.col("flag") == RETURNED).cast("long"), F.lit(0)).alias("back"))
    own = own.where("sale_id is not null")
    counts = [F.count("*").alias("n"), F.sum("back").alias("s")]
    by_line = own.groupBy("sale_id", "item_id", "vendor_id").agg(*counts).join(sold.select("sale_id", "time", "fold"), "sale_id")
    by_line = by_line.join(_one_each(items, "item_id", "kind"), "item_id", "left").join(_one_each(vendors, "vendor_id", "nation_id"), "vendor_id", "left")
    by_sale = own.groupBy("sale_id").agg(*counts).join(sold, "sale_id").withColumns({"item_id": F.lit(0).cast("long"), "vendor_id": F.lit(0).cast("long")})
    all_ = F.struct(F.lit(0).alias("key"), F.lit("").alias("name"))
    entries = _entries(by_line, {KIND: _named("kind"), NATION: _numbered("nation_id"), ITEM: _numbered("item_id"), VENDOR: _numbered("vendor_id")})
    found = histories(entries.unionAll(_entries(by_sale, {ALL: all_, SEGMENT: _named("segment"), CLIENT: _numbered("client_id")})))
    rows = _across(found, ["sale_id", "item_id", "vendor_id", "no_vendor"], {KIND: "kind", NATION: "nation", ITEM: "item", VENDOR: "vendor"})
    of_sale = _across(found, ["sale_id"], {ALL: "all", SEGMENT: "segment", CLIENT: "client"}).drop("n_lines", "n_returned")
    rows = rows.join(of_sale, "sale_id").withColumn("vendor_id", F.expr("if(no_vendor, null, vendor_id)"))
    rows = _rated(rows, "all", str(PRIOR))
    for name, prior in (("kind", "all"), ("nation", "all"), ("segment", "all"), ("item", "kind"), ("vendor", "nation"), ("client", "segment")):
        rows = _rated(rows, name, f"{prior}_rate")
    return rows.select("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", *(f"{x}_{c}" for x in ("item", "vendor", "client") for c in ("n", "rate")))


def _sql_past(level: str, key: str) -> str:
    before = "order by sold_at range between unbounded preceding and interval 1 microsecond preceding"
    one = lambda c: f"coalesce(sum({c}) over (partition by {key} {before}), 0) - coalesce(sum({c}) over (partition by {key}, fold {before}), 0) as {level}_{'n' if c == '1' else 's'}"
    return f"{one('1')}, {one('back')}"


def _sql_rate(name: str, prior: str) -> str:
    return f"case when {name}_n < 1 then {prior} else ({SCALE} * {name}_s + {SMOOTHING} * {prior}) // ({name}_n + {SMOOTHING}) end as {name}_rate"


_CRC = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
_LEVELS = {"all": "1", "kind": "kind", "nation": "nation_id", "segment": "segment", "item": "item_id", "vendor": "vendor_id", "client": "client_id"}
ORACLE = f"""
with crc as (select {_CRC} as t),
s as (select sale_id, sold_at, coalesce(client_id, -1) as client_id,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(sale_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {FOLDS} as fold
  from sales, crc where sale_id is not null and sold_at is not null),
l as (select l.sale_id, coalesce(l.item_id, -1) as item_id, l.vendor_id, (coalesce(flag, '') = '{RETURNED}')::bigint as back, sold_at, fold, s.client_id, kind, v.nation_id, segment
  from sale_lines l join s using (sale_id) left join items i on i.item_id = coalesce(l.item_id, -1) left join vendors v on v.vendor_id = l.vendor_id left join clients c on c.client_id = s.client_id),
h as (select *, {", ".join(_sql_past(*x) for x in _LEVELS.items())} from l),
g as (select *, {_sql_rate("all", str(PRIOR))} from h),
p as (select *, {_sql_rate("kind", "all_rate")}, {_sql_rate("nation", "all_rate")}, {_sql_rate("segment", "all_rate")} from g),
r as (select *, {_sql_rate("item", "kind_rate")}, {_sql_rate("vendor", "nation_rate")}, {_sql_rate("client", "segment_rate")} from p)
select sale_id, item_id, vendor_id, count(*) as n_lines, sum(back)::bigint as n_returned, {", ".join(f"max({x}_{c})::bigint as {x}_{c}" for x in ("item", "vendor", "client") for c in ("n", "rate"))} from r group by sale_id, item_id, vendor_id"""
