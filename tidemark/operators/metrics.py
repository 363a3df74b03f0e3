"""Transfer metrics and dashboards (group K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalog_metrics(catalog: DataFrame, stats: DataFrame) -> DataFrame:
    """K1 to K3: catalog rows with table statistics; type and status from the catalog's status and active flag."""
    s = F.upper("status")
    kind = F.when(s == "FULL_LOAD", "FULL_LOAD").when(s == "INCREMENTAL", "INCREMENTAL").otherwise("SYNC")
    first = F.when(s.isin("ERROR", "FAILED"), "FAILED").when(s.isin("NO_DATA", "EMPTY", "LISTENING_CHANGES", "ACTIVE"), "SUCCESS").when(s.isin("PENDING", "WAITING"), "PENDING").otherwise("UNKNOWN")
    status = F.when(~F.coalesce("active", F.lit(False)), "FAILED").when(first == "UNKNOWN", "SUCCESS").otherwise(first)
    error = F.when(~F.coalesce("active", F.lit(False)), "Table marked as inactive").when(s.isin("ERROR", "FAILED"), "Transfer failed").when(s.isin("NO_DATA", "EMPTY"), "No data to transfer").when(s.isin("PENDING", "WAITING"), "Waiting for sync").when(s.isin("LISTENING_CHANGES", "ACTIVE"), "").otherwise(F.concat(F.lit("Unknown status: "), s))
    c = catalog.select(F.lower("schema_name").alias("schema_name"), F.lower("table_name").alias("table_name"), "db_engine", kind.alias("transfer_type"), status.alias("metric_status"), error.alias("error_message"), F.col("last_sync").alias("completed_at"))
    joined = c.join(stats.select(F.lower("schema_name").alias("schema_name"), F.lower("table_name").alias("table_name"), "live_rows", "dead_rows"), ["schema_name", "table_name"], "left")
    return joined.withColumn("started_at", F.col("completed_at") - F.expr("interval 1 hour")).withColumn("io_operations", F.coalesce(F.col("live_rows") + F.col("dead_rows"), F.lit(0)))


def daily_last(metrics: DataFrame) -> DataFrame:
    """K5: the last row of each table, engine and day."""
    keys = ["schema_name", "table_name", "db_engine", "created_date"]
    dated = metrics.withColumn("created_date", F.to_date("started_at"))
    rest = [c for c in metrics.columns if c not in keys]
    return dated.groupBy(*keys).agg(F.max_by(F.struct(*rest), "event_id").alias("_r")).select(*keys, "_r.*")


def status_counts() -> list[Column]:
    s = F.col("status")
    return [F.count("*").alias("transfers"), F.count_if(s == "SUCCESS").alias("succeeded"), F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "PENDING").alias("pending")]


def report(metrics: DataFrame, by: list[Column | str]) -> DataFrame:
    """Transfers, rows and bytes with the rate of success."""
    out = metrics.groupBy(*by).agg(*status_counts(), F.sum("records_transferred").alias("records"), F.sum("bytes_transferred").alias("bytes"))
    return out.withColumn("success_rate", F.round(100 * F.col("succeeded") / F.col("transfers"), 4))


def sync_progress(catalog: DataFrame) -> DataFrame:
    """K7."""
    s = F.upper("status")
    one = catalog.agg(F.count("*").alias("tables"), F.count_if(s == "FULL_LOAD").alias("full_load"), F.count_if(s == "LISTENING_CHANGES").alias("listening"), F.count_if(s == "NO_DATA").alias("no_data"), F.count_if(s == "ERROR").alias("errors"), F.count_if(s.isin("SKIP", "SKIPPED")).alias("skipped"), F.count_if("active").alias("active"))
    return one.withColumn("progress", F.round(100 * F.try_divide(F.col("listening") + F.col("no_data"), F.col("tables")), 4))


def recent(metrics: DataFrame, column: str, as_of: Column, span: str) -> DataFrame:
    return metrics.where((F.col(column) >= as_of - F.expr(f"interval {span}")) & (F.col(column) <= as_of))


def engine_performance(metrics: DataFrame) -> DataFrame:
    """Means by engine."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(20,2)")).cast("double"), 4)
    return metrics.groupBy("db_engine").agg(F.count("*").alias("transfers"), mean("records_transferred").alias("avg_records"), mean("memory_used_mb").alias("avg_memory_mb"), mean("io_operations").alias("avg_io"))


def fastest(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """K9: transfers with most rows a second."""
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at"))
    return metrics.where("completed_at is not null").withColumn("rows_per_second", F.round(F.try_divide(F.col("records_transferred"), seconds), 4)).where("rows_per_second is not null").orderBy(F.desc("rows_per_second"), "event_id").select("event_id", "schema_name", "table_name", "rows_per_second").limit(limit)


def largest(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """Tables with most bytes."""
    return metrics.groupBy("schema_name", "table_name").agg(F.sum("bytes_transferred").alias("bytes")).orderBy(F.desc("bytes"), "schema_name", "table_name").limit(limit)


def present_status(running: DataFrame, history: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables in progress and, of all others, the newest history row; with the catalog's engine."""
    done = history.join(running.select("schema_name", "table_name").distinct(), ["schema_name", "table_name"], "left_anti")
    both = running.select("schema_name", "table_name", F.upper("status").alias("status")).unionByName(done.select("schema_name", "table_name", F.upper("status").alias("status")))
    return both.join(catalog.select("schema_name", "table_name", "db_engine").distinct(), ["schema_name", "table_name"], "left")


def processing_stats(metrics: DataFrame) -> DataFrame:
    """K14."""
    t = F.concat_ws(".", "schema_name", "table_name")
    return metrics.groupBy("db_engine").agg(F.count_distinct(t).alias("tables"), F.count_distinct(F.when(F.col("status") == "FAILED", t)).alias("failing_tables"), F.count_distinct(F.when(F.col("transfer_type") == "FULL_LOAD", t)).alias("full_load_tables"))


def page(df: DataFrame, *, where: dict[str, object] | None = None, contains: tuple[str, str] | None = None, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """One page of the rows that fit, in a total order, and the count of all of them."""
    for column, value in (where or {}).items():
        df = df.where(F.col(column) == value)
    if contains:
        df = df.where(F.contains(F.lower(contains[0]), F.lit(contains[1].lower())))
    size = min(max(size, 1), 100)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size), df.agg(F.count("*").alias("total"))


STATUS_ORDER = ["FULL_LOAD", "RESET", "IN_PROGRESS", "LISTENING_CHANGES", "PENDING", "NO_DATA", "ERROR"]


def status_rank(c: Column) -> Column:
    """The place of a status in a listing; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.upper(c))
    return F.when(at > 0, at).otherwise(99).cast("int")


def values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column, for filters."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(items.alias("x")).select("x.*").where("value is not null and value <> ''").distinct()


def last_samples(series: DataFrame, n: int, order: str, tie: str) -> DataFrame:
    """The newest n samples, oldest first."""
    return series.orderBy(F.desc(order), F.desc(tie)).limit(n).orderBy(order, tie)


def last_runs(runs: DataFrame, keys: list[str], n: int, order: str, tie: str) -> DataFrame:
    """The newest n runs of each key.."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return runs.withColumn("run_rank", F.row_number().over(w)).where(F.col("run_rank") <= n)
