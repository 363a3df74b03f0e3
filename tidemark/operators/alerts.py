"""Alerts over governance rows (group L)."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _alert(rows: DataFrame, kind: str, severity: Column, message: Column, metadata: Column) -> DataFrame:
    return rows.select("schema_name", "table_name", F.lit(kind).alias("alert_type"), severity.alias("severity"), message.alias("message"), metadata.alias("metadata"))


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _in_last_day(c: str, as_of: Column) -> Column:
    return F.col(c) >= as_of - F.expr("interval 1 day")


def quality(gov: DataFrame, as_of: Column) -> DataFrame:
    """L1."""
    s = F.col("data_quality_score")
    rows = gov.where((s < 70) & _in_last_day("last_analyzed", as_of))
    return _alert(rows, "DATA_QUALITY_DEGRADED", F.when(s < 50, "CRITICAL").otherwise("WARNING"), F.concat(F.lit("Quality score "), F.format_string("%.1f", s), F.lit(" is below 70")), F.to_json(F.struct(s.alias("quality_score"))))


def pii(gov: DataFrame, as_of: Column) -> DataFrame:
    """L2."""
    n = F.col("sensitive_data_count")
    rows = gov.where((n > 0) & ~(F.col("encryption_at_rest") & F.col("masking_policy_applied")) & _in_last_day("last_analyzed", as_of))
    return _alert(rows, "PII_DETECTED", F.lit("CRITICAL"), F.concat(n.cast("string"), F.lit(" sensitive columns without encryption or masking")), F.to_json(F.struct(n)))


def anomalies(users: DataFrame) -> DataFrame:
    """L3 over J12."""
    rows = users.withColumn("schema_name", F.lit(None).cast("string")).withColumn("table_name", F.lit(None).cast("string"))
    return _alert(rows, "ACCESS_ANOMALY", F.lit("WARNING"), F.concat(F.lit("User "), F.col("username"), F.lit(" made "), F.col("sensitive_accesses").cast("string"), F.lit(" sensitive accesses to "), F.col("tables").cast("string"), F.lit(" tables")), F.to_json(F.struct("username", "sensitive_accesses", "tables")))


def retention(gov: DataFrame, as_of: Column) -> DataFrame:
    """L4."""
    rows = gov.where(F.col("retention_enforced") & ~F.col("legal_hold") & (F.col("data_expiration_date") <= as_of))
    day = F.date_format("data_expiration_date", "yyyy-MM-dd")
    return _alert(rows, "RETENTION_EXPIRED", F.lit("WARNING"), F.concat(F.lit("Data expired on "), day), F.to_json(F.struct(day.alias("expiration_date"))))


def schema_changes(gov: DataFrame, as_of: Column) -> DataFrame:
    """L5."""
    rows = gov.where(F.col("schema_evolution_tracking") & _in_last_day("last_schema_change", as_of))
    at = F.date_format("last_schema_change", "yyyy-MM-dd HH:mm:ss")
    return _alert(rows, "SCHEMA_CHANGE", F.lit("INFO"), F.concat(F.lit("Schema changed at "), at), F.to_json(F.struct(at.alias("changed_at"))))


def freshness(gov: DataFrame, as_of: Column, default_hours: int | None = None) -> DataFrame:
    """Analysed longer ago than the table's threshold; tables without one have the default, if given."""
    hours = F.coalesce(F.col("freshness_hours"), F.lit(default_hours).cast("int"))
    rows = gov.where(F.col("last_analyzed") < as_of - F.make_dt_interval(hours=hours))
    return _alert(rows, "DATA_FRESHNESS", F.lit("WARNING"), F.concat(F.lit("Not analyzed for over "), hours.cast("string"), F.lit(" hours")), F.to_json(F.struct(hours.alias("threshold_hours"))))


def performance(gov: DataFrame, as_of: Column) -> DataFrame:
    """L7."""
    f = F.col("fragmentation_percentage")
    rows = gov.where((f > 30) & _in_last_day("last_analyzed", as_of))
    return _alert(rows, "PERFORMANCE_DEGRADED", F.when(f > 50, "CRITICAL").otherwise("WARNING"), F.concat(F.lit("Fragmentation is "), F.format_string("%.1f", f), F.lit("%")), F.to_json(F.struct(f.alias("fragmentation"))))


def compliance(gov: DataFrame) -> DataFrame:
    """L8."""
    tags = F.col("compliance_requirements")
    rows = gov.where((tags != "") & ~F.col("encryption_at_rest"))
    return _alert(rows, "COMPLIANCE_VIOLATION", F.lit("CRITICAL"), F.concat(tags, F.lit(" asks for encryption")), F.to_json(F.struct(tags)))


def run_all(gov: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """L9."""
    return reduce(DataFrame.unionByName, [quality(gov, as_of), pii(gov, as_of), anomalies(users), retention(gov, as_of), schema_changes(gov, as_of), freshness(gov, as_of), performance(gov, as_of), compliance(gov)])


def evaluate_rule(spark, condition: str, **tables: DataFrame) -> bool:
    """Whether the first cell of the SQL condition is true; one that fails is false and leaves a warning. Tables
    are named {like_this}."""
    return bool(_fires(spark, condition, tables)[0])


def _fires(spark, condition: str, tables: dict[str, DataFrame]) -> tuple[bool, bool]:
    """Whether the condition holds, and whether it could not be run."""
    from pyspark.errors import PySparkException

    try:
        row = spark.sql(condition, **tables).first()
    except PySparkException as e:
        logging.getLogger(__name__).warning("rule %r failed: %s", condition, str(e)[:200])
        return False, True
    return bool(row and row[0] is True), False


def evaluate_rules(spark, rules: list[tuple[str, str]], **tables: DataFrame) -> DataFrame:
    """Rule, fires and failed for each user rule (name, SQL condition), every one a query of its own."""
    return spark.createDataFrame([(name, *_fires(spark, condition, tables)) for name, condition in rules], "rule string, fires boolean, failed boolean")


def listing(alerts: DataFrame, *, kind: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """By severity, then name."""
    if kind:
        alerts = alerts.where(F.col("alert_type") == kind)
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return alerts.withColumn("severity_rank", rank).orderBy("severity_rank", "alert_type", F.asc_nulls_last("schema_name"), F.asc_nulls_last("table_name"), "message").limit(limit)


def message(title: Column, schema: Column, table: Column, column: Column, text: Column) -> Column:
    """Title - schema.table.column - text, without the parts that are empty."""
    place = F.when((schema != "") & (table != ""), F.concat(schema, F.lit("."), table))
    full = F.concat(F.coalesce(F.concat(F.lit(" - "), place), F.lit("")), F.when(column != "", F.concat(F.lit("."), column)).otherwise(""))
    return F.concat(title, full, F.lit(" - "), text)
