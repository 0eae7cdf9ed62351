"""Running sums over whole tables, and what rests on them: numbers, percentiles, followers.

Rows are sorted into ranges of equal size by (keys, order), so one key may hold any share of them. Sums run within each range; what
a key brings along from the ranges before is one row a range, added up in order on the driver and given to the range's first key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import scratch_table

RANGES = 4096


def running(rows: DataFrame, keys: list[str], order: list, **values: Column) -> DataFrame:
    """rows with a running total (long) of each value within its keys, up to and with the row. order: columns or names; together
    with the keys they should tell rows apart, of rows that they don't any may come first. Null values add nothing."""
    spark = rows.sparkSession
    ranges = min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    own = {f"_own_{n}": F.coalesce(v.cast("long"), F.lit(0)) for n, v in values.items()}
    ranged = rows.withColumns(own).repartitionByRange(ranges, *keys, *by).withColumn("_range", F.spark_partition_id())
    ranged = scratch_table(ranged, "running")
    here = Window.partitionBy("_range", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    of_key = F.struct(F.lit(0).alias("_"), *keys)  # a range's keys ascend, as structs do
    totals = ranged.groupBy("_range", *keys).agg(*(F.sum(f"_own_{n}").alias(n) for n in values))
    ends = totals.groupBy("_range").agg(F.min(of_key).alias("first"), F.max(F.struct(of_key.alias("key"), *values)).alias("last")).collect()  # one row a range
    key, sums, into = None, [], []
    for r in sorted(ends, key=lambda r: r._range):
        goes_on = key == r.first
        if goes_on:
            into.append((r._range, *r.first[1:], *sums))
        whole = goes_on and r.last.key == r.first
        key, sums = r.last.key, [r.last[n] + (before if whole else 0) for n, before in zip(values, sums or [0] * len(values), strict=True)]
    kinds = dict(ranged.dtypes)
    schema = ", ".join(["_of int", *(f"`_key_{k}` {kinds[k]}" for k in keys), *(f"`_from_{n}` long" for n in values)])
    brought = F.broadcast(spark.createDataFrame(into, schema))  # one row a range at most
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = ranged.withColumns({n: F.sum(f"_own_{n}").over(here) for n in values}).join(brought, same, "left")
    return out.select(*rows.columns, *((F.col(n) + F.coalesce(f"_from_{n}", F.lit(0))).alias(n) for n in values))


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "number") -> DataFrame:
    """rows with their number within the keys, from 1."""
    return running(rows, keys, order, **{name: F.lit(1)})


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column a share): the smallest value that this share of a group's values does not exceed, as percentile_disc; null
    values are none. Equal values are counted first, so what is kept a group is one row a value, spread over ranges."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    upto = running(counts, keys, [value], _upto=F.col("_n"))
    joined = upto.alias("u").join(totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_all"), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    enough = {n: F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_all") * F.lit(p)), F.lit(1)), F.col(value))) for n, p in shares.items()}
    return joined.groupBy(*keys).agg(*(c.alias(n) for n, c in enough.items()))


def followers(rows: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """(item, follower): the n next items of the same key by rising item, which must be unique within it."""
    placed = numbered(rows.where(F.col(key).isNotNull()).select(key, item), [key], [item], "_at")
    asked = placed.select(key, item, F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + n)).alias("_at"))
    return asked.join(placed.select(key, "_at", F.col(item).alias("follower")), [key, "_at"]).select(item, "follower")
