"""Query statistics, activity, access and application logs (group J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext


def top_statements(stats: DataFrame, limit: int = 1000) -> DataFrame:
    """Statements other than system ones, by total time."""
    q = F.lower("query")
    return stats.where(~q.contains("pg_stat") & ~q.contains("information_schema")).orderBy(F.desc("total_time_ms"), "queryid").limit(limit)


def parsed(stats: DataFrame) -> DataFrame:
    """J2 to J5."""
    q = F.col("query")
    return stats.withColumns({**sqltext.features(q), "operation_type": sqltext.operation(q), "query_category": sqltext.category(q), "fingerprint": sqltext.fingerprint(q)})


def efficiency(stats: DataFrame) -> DataFrame:
    """J6."""
    hit, read = F.col("blks_hit"), F.col("blks_read")
    cache = F.when(hit + read > 0, 100.0 * hit / (hit + read)).otherwise(0.0)
    io = F.when(F.col("total_time_ms") > 0, (read + F.col("temp_read") + F.col("blks_written") + F.col("temp_written")) / F.col("total_time_ms")).otherwise(0.0)
    mean = F.col("mean_time_ms")
    time_score = F.when(mean < 100, 100.0).when(mean < 1000, 80.0).when(mean < 5000, 60.0).otherwise(40.0)
    io_score = F.when(io > 0, F.least(F.lit(100.0), 100.0 / io)).otherwise(50.0)
    out = stats.withColumn("cache_hit_ratio", F.round(cache, 4)).withColumn("io_efficiency", F.round(io, 4)).withColumn("efficiency_score", F.round(0.4 * time_score + 0.4 * cache + 0.2 * io_score, 4))
    called = F.col("calls") > 0
    return out.withColumn("min_time_ms", F.when(called, 0.5 * mean)).withColumn("max_time_ms", F.when(called, 2.0 * mean))


def query_summary(stats: DataFrame) -> DataFrame:
    """Slow, I/O-heavy and badly cached statements by operation."""
    e = efficiency(stats).withColumn("operation_type", sqltext.operation(F.col("query")))
    return e.groupBy("operation_type").agg(F.count("*").alias("queries"), F.count_if(F.col("mean_time_ms") > 1000).alias("slow"), F.count_if(F.col("blks_read") + F.col("blks_written") > 3000).alias("high_io"), F.count_if(F.col("cache_hit_ratio") < 80).alias("low_cache"), F.count_distinct(sqltext.fingerprint(F.col("query"))).alias("fingerprints"))


def activity(rows: DataFrame) -> DataFrame:
    """Active and idle sessions with duration, flags and score."""
    ms = (F.timestamp_diff("MILLISECOND", F.col("query_start"), F.col("seen_at"))).cast("long")
    blocking = F.coalesce((F.col("wait_event_type") != "") & (F.col("wait_event_type") != "ClientRead"), F.lit(False))
    out = rows.where(F.col("state").isin("active", "idle", "idle in transaction")).withColumn("duration_ms", ms).withColumn("is_long_running", ms > 60000).withColumn("is_blocking", blocking)
    d = F.col("duration_ms")
    duration = F.when(d < 1000, 100.0).when(d < 5000, 80.0).when(d < 30000, 60.0).otherwise(40.0)
    return out.withColumn("efficiency_score", F.round(0.5 * duration + 0.3 * F.when(F.col("state") == "active", 100.0).otherwise(60.0) + 0.2 * F.when(F.col("is_blocking"), 40.0).otherwise(100.0), 4))


def tier(score: Column) -> Column:
    """Bands of our own over a score: 90, 70, 50."""
    return F.when(score >= 90, "EXCELLENT").when(score >= 70, "GOOD").when(score >= 50, "FAIR").otherwise("POOR")


def performance_summary(rows: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """J10, J11 over the last hours, by tier."""
    recent = activity(rows).where(F.col("query_start") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    return recent.groupBy(tier(F.col("efficiency_score")).alias("tier")).agg(F.count("*").alias("queries"), F.count_if("is_long_running").alias("long_running"), F.count_if("is_blocking").alias("blocking"), F.sum("duration_ms").alias("duration_ms"))


def access_anomalies(log: DataFrame, as_of: Column, days: int, max_accesses: int = 1000, max_tables: int = 50) -> DataFrame:
    """Users with more sensitive accesses or tables than usual."""
    table = F.concat_ws(".", "schema_name", "table_name")
    users = log.where(F.col("access_timestamp") >= as_of - F.make_dt_interval(days=F.lit(days))).groupBy("username").agg(F.count_if("is_sensitive_data").alias("sensitive_accesses"), F.count_distinct(table).alias("tables"))
    return users.where((F.col("sensitive_accesses") > max_accesses) | (F.col("tables") > max_tables))


def access_history(log: DataFrame, *, schema: str, table: str, user: str | None = None, limit: int = 100) -> DataFrame:
    """Newest accesses of a table."""
    out = log.where((F.col("schema_name") == schema) & (F.col("table_name") == table))
    return (out.where(F.col("username") == user) if user else out).orderBy(F.desc("access_timestamp"), F.desc("event_id")).limit(limit)


def enriched(log: DataFrame, policies: DataFrame) -> DataFrame:
    """Accesses with the sensitivity, masking and compliance of their table."""
    p = policies.select("schema_name", "table_name", "sensitivity_level", "masking_policy_applied", "compliance_requirements")
    return log.join(p, ["schema_name", "table_name"], "left").withColumn("masking_applied", F.col("is_sensitive_data") & F.coalesce("masking_policy_applied", F.lit(False))).drop("masking_policy_applied")


NEW_LINE = r"^\[([^\]]*)\] \[([^\]]*)\] \[([^\]]*)\] \[([^\]]*)\] (.*)$"
OLD_LINE = r"^\[([^\]]*)\] \[([^\]]*)\] \[([^\]]*)\] (.*)$"


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Time, level, category, function and message; older lines have no category, others are only a message."""
    c = F.col(column)
    new, old = c.rlike(NEW_LINE), c.rlike(OLD_LINE)
    part = lambda i, j: F.when(new, F.regexp_extract(c, NEW_LINE, i)).when(old, F.regexp_extract(c, OLD_LINE, j) if j else F.lit("SYSTEM"))
    return lines.withColumns({"log_time": part(1, 1), "level": part(2, 2), "category": part(3, 0), "function": part(4, 3), "message": F.coalesce(part(5, 4), c)})


def log_stats(logs: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """J16."""
    out = logs.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("entries"), F.max("ts").alias("last_seen"))
    return out.orderBy(F.desc("entries"), "value").limit(limit) if limit else out


def search(logs: DataFrame, *, levels: list[str] | None = None, categories: list[str] | None = None, functions: list[str] | None = None, text: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Entries that fit all conditions given."""
    for column, values in (("level", levels), ("category", categories), ("function", functions)):
        if values:
            logs = logs.where(F.col(column).isin(values))
    if text:
        logs = logs.where(F.contains(F.lower("message"), F.lit(text.lower())))
    if start is not None:
        logs = logs.where(F.col("ts") >= start)
    return logs.where(F.col("ts") < end) if end is not None else logs


SEVERITY = ["CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG"]


def log_tree(logs: DataFrame) -> DataFrame:
    """Counts by level and category with the order of severity."""
    place = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("level"))
    return logs.groupBy("level", "category").agg(F.count("*").alias("entries")).withColumn("severity", place.cast("int"))
