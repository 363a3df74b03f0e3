"""Governance scores and object health (group H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import clamp


def access_frequency(n: Column) -> Column:
    """H1."""
    return F.when(n > 10000, "REAL_TIME").when(n > 1000, "HIGH").when(n > 100, "MEDIUM").when(n > 10, "LOW").when(n > 0, "RARE").otherwise("ARCHIVED")


def usage(log: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """H2: accesses of each table and the bucket of their number."""
    n = F.sum(weight) if weight else F.count("*")
    return log.groupBy(*keys).agg(n.alias("query_count")).withColumn("access_frequency", access_frequency(F.col("query_count")))


def churn(log: DataFrame, keys: list[str]) -> DataFrame:
    """H3: superseded row versions as a percentage of live rows, by table, from the change log."""
    per_key = log.groupBy("schema_name", "table_name", *keys).agg(F.count("*").alias("versions"), F.max_by("operation", "change_id").alias("last"))
    live = F.count_if(F.col("last") != "D")
    dead = F.sum(F.col("versions") - (F.col("last") != "D").cast("int"))
    return per_key.groupBy("schema_name", "table_name").agg(live.alias("live_rows"), dead.alias("dead_rows")).withColumn("churn_pct", F.when(F.col("live_rows") > 0, F.round(100 * F.col("dead_rows") / F.col("live_rows"), 4)))


def health_status(fragmentation: Column, duplicates: Column, nulls: Column) -> Column:
    """H4."""
    out = F.when(F.lit(False), "")
    for name, (f, d, n) in {"EMERGENCY": (80, 50, 70), "CRITICAL": (50, 20, 50), "WARNING": (20, 10, 30)}.items():
        out = out.when((fragmentation > f) | (duplicates > d) | (nulls > n), name)
    return out.when((fragmentation == 0) & (duplicates == 0) & (nulls < 5), "EXCELLENT").otherwise("HEALTHY")


def band(score: Column) -> Column:
    return F.when(score >= 80, "HEALTHY").when(score >= 60, "WARNING").otherwise("CRITICAL")


def _off(rule: Column, points: float) -> Column:
    return F.when(rule, points).otherwise(0.0)


def _fragmentation() -> Column:
    f = F.col("fragmentation_pct")
    return F.when(f > 30, F.least((f - 30) * 0.5, F.lit(40.0))).otherwise(0.0)


def _percent(c: Column) -> Column:
    return F.floor(c).cast("string")


def mssql_health(stats: DataFrame) -> DataFrame:
    """H5."""
    f, index = F.col("fragmentation_pct"), F.col("object_type") == "INDEX"
    slow = (F.col("object_type") == "STORED_PROCEDURE") & (F.col("avg_seconds") > 5)
    score = clamp(100 - _fragmentation() - _off(F.col("is_unused") & index, 20) - _off(F.col("has_missing_index") & (F.col("missing_index_impact") > 50), 15) - _off((F.col("object_type") == "DATABASE") & F.col("last_full_backup").isNull(), 10) - _off(slow, 10))
    advice = F.when(f > 30, F.concat(F.lit("Rebuild the index: fragmentation "), _percent(f), F.lit("%"))).when(F.col("has_missing_index"), F.concat(F.lit("Create the missing index: impact "), _percent(F.col("missing_index_impact")), F.lit("%"))).when(F.col("is_unused") & index, "Index is unused").when(slow, F.concat(F.lit("Slow procedure: "), _percent(F.col("avg_seconds")), F.lit(" s")))
    return stats.withColumn("health_score", F.round(score, 4)).withColumn("health_status", band(F.col("health_score"))).withColumn("recommendation", advice)


def mariadb_health(stats: DataFrame) -> DataFrame:
    """H6."""
    free, expired = F.col("data_free_mb") > 0.5 * F.col("data_size_mb"), F.col("user_expired_count") > 0
    score = clamp(100 - _fragmentation() - _off(free, 15) - _off(expired, 10) - _off(F.col("user_locked_count") * 10 > F.col("user_total"), 10))
    advice = F.when(F.col("fragmentation_pct") > 30, F.concat(F.lit("Optimize the table: fragmentation "), _percent(F.col("fragmentation_pct")), F.lit("%"))).when(free, "Optimize the table to reclaim space").when(expired, "Review expired users")
    return stats.withColumn("health_score", F.round(score, 4)).withColumn("health_status", band(F.col("health_score"))).withColumn("recommendation", advice)


def mongo_health(stats: DataFrame) -> DataFrame:
    """H7."""
    bare, large, fat = (F.col("index_count") == 0) & (F.col("document_count") > 1000), F.col("total_size_mb") > 10000, F.col("avg_object_size_bytes") > 1024 * 1024
    score = 100 - _off(bare, 20) - _off(large, 10) - _off(fat, 15)
    advice = F.concat_ws("; ", F.when(bare, "Add indexes"), F.when(large, "Archive old data"), F.when(fat, "Split large documents"))
    n = F.col("document_count")
    return stats.withColumn("health_score", score).withColumn("health_status", band(score)).withColumn("recommendation", F.nullif(advice, F.lit(""))).withColumn("access_frequency", F.when(n > 10000, "HIGH").when(n > 1000, "MEDIUM").otherwise("LOW"))


def oracle_health(stats: DataFrame) -> DataFrame:
    """H8."""
    chain = F.when((F.col("chain_cnt") > 0) & (F.col("num_rows") > 0), F.col("chain_cnt") / F.col("num_rows") * 100).otherwise(0.0)
    empty = F.when((F.col("blocks") > 0) & (F.col("empty_blocks") > 0), F.col("empty_blocks") / F.col("blocks") * 100).otherwise(0.0)
    score = clamp(100 - F.when(chain > 5, F.least((chain - 5) * 2, F.lit(30.0))).otherwise(0.0) - _off(empty > 20, 15) - _off(F.col("logging") == "NO", 10))
    return stats.withColumn("health_score", F.round(score, 4)).withColumn("health_status", band(F.col("health_score")))


def rollup(rows: DataFrame, by: str) -> DataFrame:
    """H9."""
    s = F.col("health_status")
    return rows.groupBy(by).agg(F.count("*").alias("objects"), F.count_if(s == "HEALTHY").alias("healthy"), F.count_if(s == "WARNING").alias("warning"), F.count_if(s == "CRITICAL").alias("critical"), F.round(F.avg(F.col("health_score").cast("decimal(20,4)")).cast("double"), 4).alias("avg_score"))


def with_stats(objects: DataFrame, stats: list[DataFrame], keys: list[str]) -> DataFrame:
    """Objects with each of the statistics tables."""
    for s in stats:
        objects = objects.join(s, keys, "left")
    return objects


def last_backups(backups: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """Newest backup of each kind in a column of its own."""
    return backups.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == k, F.col("finished_at"))).alias(name) for k, name in kinds.items()])


def ordered_list(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """H12."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), ",").alias(out))


def governance_row(tables: DataFrame, sensitive_rollup: DataFrame | None = None) -> DataFrame:
    """Scores, health, access bucket, retention, backup and compliance of every table."""
    from . import quality, sensitive

    out = quality.dimension_scores(tables)
    out = out.withColumn("health_status", health_status(F.col("fragmentation_percentage"), F.col("duplicate_percentage"), F.col("null_percentage"))).withColumn("access_frequency", access_frequency(F.col("query_count")))
    out = out.withColumn("retention", sensitive.retention_policy(F.col("data_category"), F.col("sensitivity_level"))).withColumn("backup", sensitive.backup_frequency(F.col("data_category"), F.col("access_frequency"))).withColumn("compliance", sensitive.compliance(F.col("sensitivity_level"), F.col("business_domain")))
    return out.join(sensitive_rollup, "table_name", "left") if sensitive_rollup is not None else out


def infer_engine(tables: DataFrame, catalog: DataFrame) -> DataFrame:
    """The engine that the catalog has for the schema (the first by name), else UNKNOWN."""
    known = catalog.groupBy("schema_name").agg(F.min("db_engine").alias("inferred_engine"))
    return tables.join(known, "schema_name", "left").na.fill("UNKNOWN", ["inferred_engine"])


def averages(rows: DataFrame, count: str, totals: list[str]) -> DataFrame:
    """Totals by execution; null without executions."""
    return rows.withColumns({f"avg_{t}": F.round(F.try_divide(F.col(t), F.col(count)), 4) for t in totals})


def missing_indexes(details: DataFrame, groups: DataFrame, stats: DataFrame) -> DataFrame:
    """H16."""
    return details.join(groups, "index_handle").join(stats, "group_handle").withColumn("advantage", F.round(F.col("user_seeks") * F.col("avg_cost") * F.col("avg_impact") / 100, 4))


def sizes(rows: DataFrame) -> DataFrame:
    """Megabytes from bytes and from blocks of 8 KiB."""
    return rows.withColumn("size_mb", F.round(F.col("avg_object_size_bytes") * F.col("document_count") / (1024 * 1024), 4)).withColumn("blocks_mb", F.round(F.col("blocks") * 8 / 1024, 4)).withColumn("total_mb", F.col("data_size_mb") + F.col("data_free_mb"))
