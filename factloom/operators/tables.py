"""Writing semantics as rewrites of DataFrames: upserts, inserts if absent, cascades, rescore, exports, sitemap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.evidence import first_wins


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key: the last by `order` of both tables (written in one pass of a union and one shuffle)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True).withColumn("_order", order)
    return first_wins(both, keys, F.desc("_order"), F.desc("_new")).drop("_new", "_order")


def where_given(df: DataFrame, *conditions: tuple[str, str, object]) -> DataFrame:
    """df where the conditions (column, operator, value) hold; one whose value is absent (None) is left out, so the others still
    reach the scan."""
    made = {"=": Column.__eq__, ">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__}
    for name, operator, value in conditions:
        if value is not None:
            df = df.where(made[operator](F.col(name), F.lit(value)))
    return df


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete what has a key of new, then add new (segments of a document indexed again)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(deleted: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What is left of each table of a chain (table, key, parent key) when `deleted` parents go."""
    gone, out = deleted, []
    for df, key, parent in chain:
        dead = df.join(gone.select(F.col(gone.columns[0]).alias(parent)), parent, "left_semi")
        out.append(df.join(gone.select(F.col(gone.columns[0]).alias(parent)), parent, "left_anti"))
        gone = dead.select(key)
    return out


def stamped(df: DataFrame, at: Column | None = None) -> DataFrame:
    return df.withColumn("updated_at", F.current_timestamp() if at is None else at)


def rescore_preview(docs: DataFrame, n: int) -> DataFrame:
    """The oldest scored documents."""
    scored = docs.where("strip is not null or grounding_score is not null")
    return scored.orderBy("created_at", "id").limit(max(n, 1)).select("id", F.col("strip").isNotNull().alias("has_strip"), F.col("grounding_score").isNotNull().alias("has_scores"))


def rescore_reset(docs: DataFrame, claims: DataFrame, n: int, synthesis: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, claims, report) after the verdicts and scores of the oldest scored documents are taken back."""
    picked = rescore_preview(docs, n).select(F.col("id").alias("_picked"))
    d = docs.join(picked, F.col("id") == F.col("_picked"), "left")
    gone = ["strip", "grounding_score", "integrity_score", *(["synthesis_text"] if synthesis else [])]
    d = d.withColumns({c: F.when(F.col("_picked").isNull(), F.col(c)) for c in gone} | {"pipeline_status": F.when(F.col("_picked").isNotNull(), "verifying").otherwise(F.col("pipeline_status"))})
    c = claims.join(picked, F.col("document_id") == F.col("_picked"), "left")
    verdict = [x for x in ("veracity_label", "confidence_score", "gap_reason", "conflict_basis") if x in claims.columns]
    report = picked.join(claims, F.col("_picked") == F.col("document_id"), "left").groupBy(F.col("_picked").alias("doc_id")).agg(F.count("document_id").alias("claims_reset"))
    report = report.select("doc_id", "claims_reset", F.lit(True).alias("scores_cleared"), F.lit(synthesis).alias("synthesis_cleared"))
    return d.drop("_picked"), c.withColumns({x: F.when(F.col("_picked").isNull(), F.col(x)) for x in verdict}).drop("_picked"), report


def nested(parent: DataFrame, child: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """parent with its children as an array of structs, in order."""
    rest = [c for c in child.columns if c != key and c not in order]
    kids = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
    return parent.join(kids, key, "left")


def sitemap(base: str, static: list[str], docs: DataFrame, publishers: DataFrame) -> DataFrame:
    """(part, nth, xml): static routes, documents newest first, publishers by name, one <url> a row."""
    entry = lambda loc, day: F.concat(F.lit("  <url><loc>"), T.xml_escape(loc), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    day = F.date_format("updated_at", "yyyy-MM-dd")
    spark = docs.sparkSession
    routes = spark.createDataFrame([(i, r) for i, r in enumerate(static)], "nth long, path string").select(F.lit(0).alias("part"), F.lit(None).cast("timestamp").alias("at"), F.format_string("%08d", "nth").alias("name"), entry(F.concat(F.lit(base), F.col("path")), F.lit(None).cast("string")).alias("xml"))
    d = docs.select(F.lit(1).alias("part"), F.col("updated_at").alias("at"), F.col("id").cast("string").alias("name"), entry(F.concat(F.lit(base + "/documents/"), F.col("id").cast("string")), day).alias("xml"))
    p = publishers.groupBy("name").agg(F.max("updated_at").alias("updated_at")).select(F.lit(2).alias("part"), F.lit(None).cast("timestamp").alias("at"), "name", entry(F.concat(F.lit(base + "/publishers/"), F.url_encode("name")), day).alias("xml"))
    return reduce(DataFrame.unionAll, (routes, d, p)).orderBy("part", F.desc_nulls_last("at"), "name")


def written_sitemap(rows: DataFrame, path: str) -> None:
    """As text; rows arrive in order."""
    rows.select("xml").write.mode("overwrite").text(path)


def overwrite(df: DataFrame, path: str, *partition: str) -> None:
    """Whole-table replacement, or only of the partitions that df has."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition)
    writer.parquet(path)


def feed_insert(feeds: DataFrame, rows: DataFrame) -> DataFrame:
    """New feeds with their defaults; known URLs are passed over."""
    new = rows.withColumns({"source_category": F.coalesce("source_category", F.lit("mainstream")), "polling_interval_minutes": F.coalesce("polling_interval_minutes", F.lit(15)), "is_active": F.coalesce("is_active", F.lit(True))})
    return insert_if_absent(feeds, new, "url")


def feed_update(feeds: DataFrame, feed_id: int | str, values: dict) -> DataFrame:
    return feeds.withColumns({c: F.when(F.col("id") == feed_id, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def feed_delete(feeds: DataFrame, feed_id: int | str) -> DataFrame:
    return feeds.where(F.col("id") != feed_id)
