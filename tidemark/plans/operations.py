"""Queries over logs, transfer metrics, alerts, retention, compliance and maintenance (J to N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext
from ..operators import alerts, comply, logs, metrics
from .registry import as_of, query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("j1_top_statements", "SELECT queryid, total_time_ms FROM {query_stats} WHERE NOT contains(lower(query), 'pg_stat') ORDER BY total_time_ms DESC, queryid LIMIT 1000")
def j1(t):
    return logs.top_statements(t.query_stats, 1000).select("queryid", "total_time_ms")


@query("j2_text_features", r"""SELECT queryid, regexp_matches(q, ' join |inner join|left join|right join') AS has_joins, regexp_matches(q, '\( ?select') AS has_subqueries, contains(q, 'with ') AND contains(q, ' as (') AS has_cte, contains(q, 'over (') OR contains(q, 'row_number()') OR contains(q, 'rank()') AS has_window,
regexp_matches(q, '(count|sum|avg|max|min)\(') AS has_functions, len(regexp_extract_all(q, '(?:^|[^0-9a-z_])from\s+[0-9a-z_]+|join\s+[0-9a-z_]+')) AS tables_count FROM (SELECT queryid, lower(query) AS q FROM {query_stats})""")
def j2(t):
    return t.query_stats.select("queryid", *[c.alias(n) for n, c in sqltext.features(F.col("query")).items()])


@query("j3_operations", """SELECT queryid, CASE WHEN starts_with(q, 'select') THEN 'SELECT' WHEN starts_with(q, 'insert') THEN 'INSERT' WHEN starts_with(q, 'update') THEN 'UPDATE' WHEN starts_with(q, 'delete') THEN 'DELETE' WHEN starts_with(q, 'create') THEN 'CREATE' WHEN starts_with(q, 'drop') THEN 'DROP' ELSE 'UNKNOWN' END AS operation_type,
CASE WHEN starts_with(q, 'select') THEN CASE WHEN contains(q, 'count') OR contains(q, 'sum') OR contains(q, 'avg') THEN 'ANALYTICS' WHEN contains(q, 'join') THEN 'JOIN_QUERY' ELSE 'SELECT' END WHEN starts_with(q, 'insert') THEN 'INSERT' WHEN starts_with(q, 'update') THEN 'UPDATE' WHEN starts_with(q, 'delete') THEN 'DELETE' WHEN regexp_matches(q, '^(create|alter|drop)') THEN 'DDL' ELSE 'OTHER' END AS query_category
FROM (SELECT queryid, lower(query) AS q FROM {query_stats})""")
def j3(t):
    return logs.parsed(t.query_stats).select("queryid", "operation_type", "query_category")


@query("j5_fingerprints", r"""WITH f AS (SELECT lower(regexp_replace(regexp_replace(query, '\b[0-9]+\b', '?', 'g'), '''[^'']*''', '''?''', 'g')) AS fingerprint, calls FROM {query_stats}) SELECT fingerprint, count(*) AS statements, cast(sum(calls) AS bigint) AS calls FROM f GROUP BY 1""")
def j5(t):
    return logs.parsed(t.query_stats).groupBy("fingerprint").agg(F.count("*").alias("statements"), F.sum("calls").alias("calls"))


EFFICIENCY = """x AS (SELECT *, CASE WHEN blks_hit + blks_read > 0 THEN blks_hit * 100.0::double / (blks_hit + blks_read) ELSE 0 END AS cache, CASE WHEN total_time_ms > 0 THEN (blks_read + temp_read + blks_written + temp_written) / total_time_ms ELSE 0 END AS io FROM {query_stats}),
e AS (SELECT *, round(0.4::double * CASE WHEN mean_time_ms < 100 THEN 100 WHEN mean_time_ms < 1000 THEN 80 WHEN mean_time_ms < 5000 THEN 60 ELSE 40 END + 0.4::double * cache + 0.2::double * CASE WHEN io > 0 THEN least(100.0::double, 100.0::double / io) ELSE 50 END, 4) AS efficiency_score FROM x)"""


@query("j6_efficiency", f"WITH {EFFICIENCY} SELECT queryid, round(cache, 4) AS cache_hit_ratio, round(io, 4) AS io_efficiency, efficiency_score, CASE WHEN calls > 0 THEN mean_time_ms * 0.5 END AS min_time_ms FROM e")
def j6(t):
    return logs.efficiency(t.query_stats).select("queryid", "cache_hit_ratio", "io_efficiency", "efficiency_score", "min_time_ms")


@query("j7_query_summary", r"""WITH x AS (SELECT *, CASE WHEN blks_hit + blks_read > 0 THEN blks_hit * 100.0::double / (blks_hit + blks_read) ELSE 0 END AS cache, upper(regexp_extract(lower(query), '^(select|insert|update|delete|create|alter|drop)', 1)) AS w FROM {query_stats})
SELECT CASE WHEN w <> '' THEN w ELSE 'UNKNOWN' END AS operation_type, count(*) AS queries, count(*) FILTER (mean_time_ms > 1000) AS slow, count(*) FILTER (blks_read + blks_written > 3000) AS high_io, count(*) FILTER (round(cache, 4) < 80) AS low_cache, count(DISTINCT lower(regexp_replace(regexp_replace(query, '\b[0-9]+\b', '?', 'g'), '''[^'']*''', '''?''', 'g'))) AS fingerprints FROM x GROUP BY 1""")
def j7(t):
    return logs.query_summary(t.query_stats)


ACTIVITY = """a AS (SELECT *, date_diff('millisecond', query_start, seen_at) AS duration_ms, coalesce(wait_event_type NOT IN ('', 'ClientRead'), false) AS is_blocking FROM {activity} WHERE state IN ('active', 'idle', 'idle in transaction')),
b AS (SELECT *, duration_ms > 60000 AS is_long_running, round(0.5 * CASE WHEN duration_ms < 1000 THEN 100 WHEN duration_ms < 5000 THEN 80 WHEN duration_ms < 30000 THEN 60 ELSE 40 END + 0.3 * CASE WHEN state = 'active' THEN 100 ELSE 60 END + 0.2 * CASE WHEN is_blocking THEN 40 ELSE 100 END, 4)::double AS efficiency_score FROM a)"""


@query("j9_activity", f"WITH {ACTIVITY} SELECT pid, duration_ms, is_long_running, is_blocking, efficiency_score FROM b")
def j9(t):
    return logs.activity(t.activity).select("pid", "duration_ms", "is_long_running", "is_blocking", "efficiency_score")


@query("j11_performance_summary", f"WITH {ACTIVITY} SELECT CASE WHEN efficiency_score >= 90 THEN 'EXCELLENT' WHEN efficiency_score >= 70 THEN 'GOOD' WHEN efficiency_score >= 50 THEN 'FAIR' ELSE 'POOR' END AS tier, count(*) AS queries, count(*) FILTER (is_long_running) AS long_running, count(*) FILTER (is_blocking) AS blocking, cast(sum(duration_ms) AS bigint) AS duration_ms FROM b WHERE query_start >= {NOW} - INTERVAL 240 HOUR GROUP BY 1")
def j11(t):
    return logs.performance_summary(t.activity, as_of(), 240)


@query("j12_anomalies", f"SELECT username, count(*) FILTER (is_sensitive_data) AS sensitive_accesses, count(DISTINCT schema_name || '.' || table_name) AS tables FROM {{access_log}} WHERE access_timestamp >= {NOW} - INTERVAL 20 DAY GROUP BY 1 HAVING count(*) FILTER (is_sensitive_data) > 25 OR count(DISTINCT schema_name || '.' || table_name) > 40")
def j12(t):
    return logs.access_anomalies(t.access_log, as_of(), 20, 25, 40)


@query("j13_access_history", "SELECT event_id, username, access_timestamp FROM {access_log} WHERE schema_name = 's1' AND table_name = 't8' ORDER BY access_timestamp DESC, event_id DESC LIMIT 100")
def j13(t):
    return logs.access_history(t.access_log, schema="s1", table="t8").select("event_id", "username", "access_timestamp")


@query("j14_enriched", "SELECT event_id, sensitivity_level, compliance_requirements, is_sensitive_data AND coalesce(masking_policy_applied, false) AS masking_applied FROM {access_log} LEFT JOIN {gov} USING (schema_name, table_name)")
def j14(t):
    return logs.enriched(t.access_log, t.gov).select("event_id", "sensitivity_level", "compliance_requirements", "masking_applied")


@query("j15_parsed_lines", r"""SELECT event_id, CASE WHEN new OR old THEN regexp_extract(line, '^\[([^\]]*)\]', 1) END AS log_time, CASE WHEN new OR old THEN regexp_extract(line, '^\[[^\]]*\] \[([^\]]*)\]', 1) END AS level, CASE WHEN new THEN regexp_extract(line, '^\[[^\]]*\] \[[^\]]*\] \[([^\]]*)\]', 1) WHEN old THEN 'SYSTEM' END AS category,
CASE WHEN new THEN regexp_extract(line, '\] \[([^\]]*)\] user', 1) WHEN old THEN regexp_extract(line, '\] \[([^\]]*)\] old', 1) END AS function, CASE WHEN new OR old THEN regexp_extract(line, '\] ((?:user|old) .*)$', 1) ELSE line END AS message FROM (SELECT *, event_id % 10 = 0 AS old, event_id % 10 <> 0 AND event_id % 23 <> 0 AS new FROM {log_lines})""")
def j15(t):
    return logs.parse_lines(t.log_lines).drop("line")


@query("j16_log_stats", "SELECT function AS value, count(*) AS entries, max(ts) AS last_seen FROM {app_logs} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def j16(t):
    return logs.log_stats(t.app_logs, "function", 10)


@query("j17_search", "SELECT event_id, message FROM {app_logs} WHERE level IN ('ERROR', 'CRITICAL') AND category = 'TRANSFER' AND contains(lower(message), 'purchase') AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'")
def j17(t):
    found = logs.search(t.app_logs, levels=["ERROR", "CRITICAL"], categories=["TRANSFER"], text="Purchase", start=F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), end=as_of())
    return found.select("event_id", "message")


@query("j18_log_tree", "SELECT level, category, count(*) AS entries, cast(list_position(['CRITICAL', 'ERROR', 'WARNING', 'INFO', 'DEBUG'], level) AS integer) AS severity FROM {app_logs} GROUP BY 1, 2")
def j18(t):
    return logs.log_tree(t.app_logs)


@query("k1_catalog_metrics", """WITH x AS (SELECT *, upper(status) AS s FROM {catalog}) SELECT x.schema_name, x.table_name, CASE WHEN s = 'FULL_LOAD' THEN 'FULL_LOAD' ELSE 'SYNC' END AS transfer_type, CASE WHEN NOT active THEN 'FAILED' WHEN s = 'ERROR' THEN 'FAILED' WHEN s IN ('NO_DATA', 'LISTENING_CHANGES') THEN 'SUCCESS' WHEN s = 'PENDING' THEN 'PENDING' ELSE 'SUCCESS' END AS metric_status,
CASE WHEN NOT active THEN 'Table marked as inactive' WHEN s = 'ERROR' THEN 'Transfer failed' WHEN s = 'NO_DATA' THEN 'No data to transfer' WHEN s = 'PENDING' THEN 'Waiting for sync' WHEN s = 'LISTENING_CHANGES' THEN '' ELSE 'Unknown status: ' || s END AS error_message, coalesce(live_rows + dead_rows, 0) AS io_operations, last_sync - INTERVAL 1 HOUR AS started_at FROM x LEFT JOIN {table_stats} t USING (schema_name, table_name)""")
def k1(t):
    return metrics.catalog_metrics(t.catalog, t.table_stats).select("schema_name", "table_name", "transfer_type", "metric_status", "error_message", "io_operations", "started_at")


@query("k5_daily_last", "SELECT schema_name, table_name, db_engine, cast(cast(started_at AS date) AS string) AS created_date, max(event_id) AS event_id, arg_max(status, event_id) AS status FROM {transfers} GROUP BY ALL")
def k5(t):
    return metrics.daily_last(t.transfers).select("schema_name", "table_name", "db_engine", F.col("created_date").cast("string"), "event_id", "status")


REPORT = "count(*) AS transfers, count(*) FILTER (status = 'SUCCESS') AS succeeded, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PENDING') AS pending, cast(sum(records_transferred) AS bigint) AS records, cast(sum(bytes_transferred) AS bigint) AS bytes, round(100.0 * count(*) FILTER (status = 'SUCCESS') / count(*), 4) AS success_rate"


@query("k6_daily_report", f"SELECT cast(cast(started_at AS date) AS string) AS day, {REPORT} FROM {{transfers}} GROUP BY 1")
def k6(t):
    return metrics.report(t.transfers, [F.to_date("started_at").cast("string").alias("day")])


@query("k7_sync_progress", "SELECT count(*) AS tables, count(*) FILTER (upper(status) = 'FULL_LOAD') AS full_load, count(*) FILTER (status = 'LISTENING_CHANGES') AS listening, count(*) FILTER (status = 'NO_DATA') AS no_data, count(*) FILTER (status = 'ERROR') AS errors, count(*) FILTER (status IN ('SKIP', 'SKIPPED')) AS skipped, count(*) FILTER (active) AS active, round(100.0 * count(*) FILTER (status IN ('LISTENING_CHANGES', 'NO_DATA')) / count(*), 4) AS progress FROM {catalog}")
def k7(t):
    return metrics.sync_progress(t.catalog)


@query("k8_engine_performance", f"SELECT db_engine, count(*) AS transfers, round(cast(sum(records_transferred) AS double) / count(*), 4) AS avg_records, round(cast(sum(memory_used_mb) AS double) / count(*), 4) AS avg_memory_mb, round(cast(sum(io_operations) AS double) / count(*), 4) AS avg_io FROM {{transfers}} WHERE started_at >= {NOW} - INTERVAL 5 DAY AND started_at <= {NOW} GROUP BY 1")
def k8(t):
    return metrics.engine_performance(metrics.recent(t.transfers, "started_at", as_of(), "5 days"))


@query("k9_fastest", "SELECT event_id, schema_name, table_name, round(records_transferred / date_diff('second', started_at, completed_at), 4) AS rows_per_second FROM {transfers} WHERE completed_at IS NOT NULL AND date_diff('second', started_at, completed_at) > 0 ORDER BY 4 DESC, 1 LIMIT 10")
def k9(t):
    return metrics.fastest(t.transfers)


@query("k10_largest", f"SELECT schema_name, table_name, cast(sum(bytes_transferred) AS bigint) AS bytes FROM {{transfers}} WHERE started_at >= {NOW} - INTERVAL 7 DAY AND started_at <= {NOW} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def k10(t):
    return metrics.largest(metrics.recent(t.transfers, "started_at", as_of(), "7 days"))


@query("k11_throughput", f"SELECT db_engine, count(*) AS transfers, round(cast(sum(io_operations) AS double) / count(*), 4) AS avg_io FROM {{transfers}} WHERE completed_at >= {NOW} - INTERVAL 3 DAY AND completed_at <= {NOW} GROUP BY 1")
def k11(t):
    return metrics.engine_performance(metrics.recent(t.transfers, "completed_at", as_of(), "3 days")).select("db_engine", "transfers", "avg_io")


@query("k12_hourly", f"SELECT date_trunc('hour', started_at) AS hour, {REPORT} FROM {{transfers}} GROUP BY 1")
def k12(t):
    return metrics.report(t.transfers, [F.date_trunc("hour", "started_at").cast("timestamp_ntz").alias("hour")])


@query("k13_present_status", """WITH h AS (SELECT schema_name, table_name, arg_max(status, (started_at, event_id)) AS status FROM {transfers} GROUP BY 1, 2), r AS (SELECT schema_name, table_name, 'IN_PROGRESS' AS status FROM {catalog} WHERE status = 'IN_PROGRESS'),
b AS (SELECT * FROM r UNION ALL SELECT h.* FROM h WHERE (schema_name, table_name) NOT IN (SELECT (schema_name, table_name) FROM r)) SELECT b.*, c.db_engine FROM b LEFT JOIN {catalog} c USING (schema_name, table_name)""")
def k13(t):
    from ..operators import quality

    newest = quality.latest_per(t.transfers.select("schema_name", "table_name", "status", "started_at", "event_id"), ["schema_name", "table_name"], "started_at", "event_id")
    return metrics.present_status(t.catalog.where("status = 'IN_PROGRESS'"), newest, t.catalog)


@query("k14_processing_stats", "SELECT db_engine, count(DISTINCT (schema_name, table_name)) AS tables, count(DISTINCT (schema_name, table_name)) FILTER (status = 'FAILED') AS failing_tables, count(DISTINCT (schema_name, table_name)) FILTER (transfer_type = 'FULL_LOAD') AS full_load_tables FROM {transfers} GROUP BY 1")
def k14(t):
    return metrics.processing_stats(t.transfers)


@query("k15_by_type", f"SELECT db_engine, transfer_type, {REPORT} FROM {{transfers}} WHERE started_at >= {NOW} - INTERVAL 10 DAY AND started_at <= {NOW} GROUP BY 1, 2")
def k15(t):
    return metrics.report(metrics.recent(t.transfers, "started_at", as_of(), "10 days"), ["db_engine", "transfer_type"])


@query("k16_page", "SELECT schema_name, table_name, quality_score, check_id FROM (SELECT schema_name, table_name, check_id, max(quality_score) AS quality_score FROM {quality_log} GROUP BY ALL) WHERE schema_name = 's3' AND contains(table_name, 't') ORDER BY quality_score, check_id, table_name LIMIT 20 OFFSET 40")
def k16(t):
    rows = t.quality_log.groupBy("schema_name", "table_name", "check_id").agg(F.max("quality_score").alias("quality_score"))
    page, _ = metrics.page(rows, where={"schema_name": "s3"}, contains=("table_name", "T"), order=[F.asc("quality_score"), F.asc("check_id"), F.asc("table_name")], number=3)
    return page.select("schema_name", "table_name", "quality_score", "check_id")


@query("k17_status_rank", "SELECT schema_name, table_name, coalesce(list_position(['FULL_LOAD', 'RESET', 'IN_PROGRESS', 'LISTENING_CHANGES', 'PENDING', 'NO_DATA', 'ERROR'], upper(status)), 99)::integer AS status_rank FROM {catalog} ORDER BY 3, 1, 2")
def k17(t):
    return t.catalog.select("schema_name", "table_name", metrics.status_rank(F.col("status")).alias("status_rank")).orderBy("status_rank", "schema_name", "table_name")


@query("k18_values", "SELECT DISTINCT 'db_engine' AS column_name, db_engine AS value FROM {catalog} UNION SELECT 'status', status FROM {catalog} UNION SELECT 'connection_string', connection_string FROM {catalog} WHERE connection_string <> ''")
def k18(t):
    return metrics.values(t.catalog, ["db_engine", "status", "connection_string"])


@query("k19_counts", "SELECT db_engine, count(*) AS entries, count(*) FILTER (active) AS active, cast(sum(table_size) AS bigint) AS rows FROM {catalog} GROUP BY 1")
def k19(t):
    return t.catalog.groupBy("db_engine").agg(F.count("*").alias("entries"), F.count_if("active").alias("active"), F.sum("table_size").alias("rows"))


@query("k20_last_samples", "SELECT * FROM (SELECT event_id, memory_used_mb FROM {transfers} ORDER BY started_at DESC, event_id DESC LIMIT 60)")
def k20(t):
    return metrics.last_samples(t.transfers, 60, "started_at", "event_id").select("event_id", "memory_used_mb")


@query("k21_last_runs", "SELECT table_name, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY started_at DESC, event_id DESC) AS r FROM {transfers}) WHERE r <= 5")
def k21(t):
    return metrics.last_runs(t.transfers, ["table_name"], 5, "started_at", "event_id").select("table_name", "event_id", "status")


DAY = f"last_analyzed >= {NOW} - INTERVAL 1 DAY"
ALERTS = {
    "l1_quality_alerts": f"SELECT schema_name, table_name, 'DATA_QUALITY_DEGRADED' AS alert_type, CASE WHEN data_quality_score < 50 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'Quality score ' || format('{{:.1f}}', data_quality_score) || ' is below 70' AS message, '{{\"quality_score\":' || data_quality_score || '}}' AS metadata FROM {{gov}} WHERE data_quality_score < 70 AND {DAY}",
    "l2_pii_alerts": f"SELECT schema_name, table_name, 'PII_DETECTED' AS alert_type, 'CRITICAL' AS severity, sensitive_data_count || ' sensitive columns without encryption or masking' AS message, '{{\"sensitive_data_count\":' || sensitive_data_count || '}}' AS metadata FROM {{gov}} WHERE sensitive_data_count > 0 AND NOT (encryption_at_rest AND masking_policy_applied) AND {DAY}",
    "l4_retention_alerts": f"SELECT schema_name, table_name, 'RETENTION_EXPIRED' AS alert_type, 'WARNING' AS severity, 'Data expired on ' || strftime(data_expiration_date, '%Y-%m-%d') AS message, '{{\"expiration_date\":\"' || strftime(data_expiration_date, '%Y-%m-%d') || '\"}}' AS metadata FROM {{gov}} WHERE retention_enforced AND NOT legal_hold AND data_expiration_date <= {NOW}",
    "l5_schema_alerts": f"SELECT schema_name, table_name, 'SCHEMA_CHANGE' AS alert_type, 'INFO' AS severity, 'Schema changed at ' || strftime(last_schema_change, '%Y-%m-%d %H:%M:%S') AS message, '{{\"changed_at\":\"' || strftime(last_schema_change, '%Y-%m-%d %H:%M:%S') || '\"}}' AS metadata FROM {{gov}} WHERE schema_evolution_tracking AND last_schema_change >= {NOW} - INTERVAL 1 DAY",
    "l6_freshness_alerts": f"SELECT schema_name, table_name, 'DATA_FRESHNESS' AS alert_type, 'WARNING' AS severity, 'Not analyzed for over ' || freshness_hours || ' hours' AS message, '{{\"threshold_hours\":' || freshness_hours || '}}' AS metadata FROM {{gov}} WHERE last_analyzed < {NOW} - INTERVAL 1 HOUR * freshness_hours",
    "l7_performance_alerts": f"SELECT schema_name, table_name, 'PERFORMANCE_DEGRADED' AS alert_type, CASE WHEN fragmentation_percentage > 50 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'Fragmentation is ' || format('{{:.1f}}', fragmentation_percentage) || '%' AS message, '{{\"fragmentation\":' || fragmentation_percentage || '}}' AS metadata FROM {{gov}} WHERE fragmentation_percentage > 30 AND {DAY}",
    "l8_compliance_alerts": "SELECT schema_name, table_name, 'COMPLIANCE_VIOLATION' AS alert_type, 'CRITICAL' AS severity, compliance_requirements || ' asks for encryption' AS message, '{\"compliance_requirements\":\"' || compliance_requirements || '\"}' AS metadata FROM {gov} WHERE compliance_requirements <> '' AND NOT encryption_at_rest",
    "l3_anomaly_alerts": f"SELECT CAST(NULL AS VARCHAR) AS schema_name, CAST(NULL AS VARCHAR) AS table_name, 'ACCESS_ANOMALY' AS alert_type, 'WARNING' AS severity, 'User ' || username || ' made ' || a || ' sensitive accesses to ' || b || ' tables' AS message, '{{\"username\":\"' || username || '\",\"sensitive_accesses\":' || a || ',\"tables\":' || b || '}}' AS metadata FROM (SELECT username, count(*) FILTER (is_sensitive_data) AS a, count(DISTINCT schema_name || '.' || table_name) AS b FROM {{access_log}} WHERE access_timestamp >= {NOW} - INTERVAL 20 DAY GROUP BY 1) WHERE a > 25 OR b > 40",
}


def anomalous(t):
    return logs.access_anomalies(t.access_log, as_of(), 20, 25, 40)


query("l1_quality_alerts", ALERTS["l1_quality_alerts"])(lambda t: alerts.quality(t.gov, as_of()))
query("l2_pii_alerts", ALERTS["l2_pii_alerts"])(lambda t: alerts.pii(t.gov, as_of()))
query("l3_anomaly_alerts", ALERTS["l3_anomaly_alerts"])(lambda t: alerts.anomalies(anomalous(t)))
query("l4_retention_alerts", ALERTS["l4_retention_alerts"])(lambda t: alerts.retention(t.gov, as_of()))
query("l5_schema_alerts", ALERTS["l5_schema_alerts"])(lambda t: alerts.schema_changes(t.gov, as_of()))
query("l6_freshness_alerts", ALERTS["l6_freshness_alerts"])(lambda t: alerts.freshness(t.gov, as_of()))
query("l7_performance_alerts", ALERTS["l7_performance_alerts"])(lambda t: alerts.performance(t.gov, as_of()))
query("l8_compliance_alerts", ALERTS["l8_compliance_alerts"])(lambda t: alerts.compliance(t.gov))
query("l9_all_alerts", " UNION ALL ".join(f"({ALERTS[k]})" for k in sorted(ALERTS)))(lambda t: alerts.run_all(t.gov, anomalous(t), as_of()))
query("l11_alert_listing", f"SELECT alert_type, severity, schema_name, table_name, message, CASE severity WHEN 'CRITICAL' THEN 0 ELSE 1 END::integer AS severity_rank FROM ({ALERTS['l1_quality_alerts']}) ORDER BY severity_rank, alert_type, schema_name, table_name, message LIMIT 40")(
    lambda t: alerts.listing(alerts.run_all(t.gov, anomalous(t), as_of()), kind="DATA_QUALITY_DEGRADED", limit=40).drop("metadata")
)


@query("l10_rule", "SELECT event_type, count(*) AS n, count(*) > 100 AS fires FROM events GROUP BY 1")
def l10(t):
    rule = "SELECT event_type, count(*) AS n, count(*) > 100 AS fires FROM {events} GROUP BY event_type"
    return t.spark.sql(rule, events=t.events)


@query("l10_evaluated", """SELECT 'many' AS rule, (SELECT count(*) > 100 FROM events) AS fires, false AS failed UNION ALL SELECT 'errors prevail', (SELECT count(*) FILTER (event_type = 'error') * 2 > count(*) FROM events), false UNION ALL SELECT 'broken', false, true UNION ALL SELECT 'void', false, false""")
def l10_evaluated(t):
    rules = [("many", "SELECT count(*) > 100 FROM {events}"), ("errors prevail", "SELECT count_if(event_type = 'error') * 2 > count(*) FROM {events}"), ("broken", "SELECT no_such_column FROM {events}"), ("void", "SELECT cast(null AS boolean) FROM {events}")]
    return alerts.evaluate_rules(t.spark, rules, events=t.events)


@query("l12_messages", "SELECT event_id, 'Alert' || ' - ' || schema_name || '.' || table_name || CASE WHEN column_name = 'email' THEN '' ELSE '.' || column_name END || ' - ' || access_type AS m FROM {access_log}")
def l12(t):
    column = F.nullif("column_name", F.lit("email"))
    return t.access_log.select("event_id", alerts.message(F.lit("Alert"), F.col("schema_name"), F.col("table_name"), column, F.col("access_type")).alias("m"))


HELD = f"coalesce(legal_hold AND (legal_hold_until IS NULL OR legal_hold_until > {NOW}), false)"
YEARS = "CASE WHEN contains(retention_policy, '7_YEARS') THEN 7 WHEN contains(retention_policy, '5_YEARS') THEN 5 WHEN contains(retention_policy, '3_YEARS') THEN 3 WHEN contains(retention_policy, '2_YEARS') THEN 2 WHEN contains(retention_policy, '1_YEAR') THEN 1 ELSE 0 END"


@query("m1_legal_hold", f"SELECT table_name, {HELD} AS held, {NOW} + INTERVAL 1 YEAR * {YEARS} AS expires FROM {{gov}}")
def m1(t):
    return t.gov.select("table_name", comply.legal_hold(as_of()).alias("held"), comply.expiration(F.col("retention_policy"), as_of()).alias("expires"))


@query("m3_retention_plan", f"SELECT schema_name, table_name, retention_policy, CASE WHEN contains(retention_policy, 'ARCHIVE') THEN 'ARCHIVE' ELSE 'DELETE' END AS job_type, {NOW} - INTERVAL 1 YEAR * {YEARS} AS cutoff FROM {{gov}} WHERE retention_enforced AND NOT {HELD} AND table_name NOT IN (SELECT table_name FROM {{tasks}} WHERE maintenance_type = 'VACUUM')")
def m3(t):
    return comply.retention_plan(t.gov, as_of(), t.tasks.where("maintenance_type = 'VACUUM'"))


@query("m4_expire", "SELECT o_orderkey, o_orderdate FROM orders WHERE NOT o_orderdate < TIMESTAMP '1997-01-01 00:00:00'")
def m4(t):
    return comply.expire(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))[0]


@query("m5_execute", "SELECT count(*) AS rows_affected, 'COMPLETED' AS status FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00'")
def m5(t):
    return comply.execute(t.orders, "o_orderdate", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))[1]


@query("m6_subject_columns", "SELECT DISTINCT table_name, column_name FROM {columns_source} WHERE column_name IN ('name', 'extra')")
def m6(t):
    return comply.subject_columns(t.columns_source.withColumn("contains_pii", F.col("column_name") == "extra"))


MATCH = "m AS (SELECT r.request_id, s.* FROM {subjects} s JOIN {requests} r ON lower(s.email) = lower(r.email) UNION SELECT r.request_id, s.* FROM {subjects} s JOIN {requests} r ON contains(lower(s.full_name), lower(r.full_name)))"


@query("m7_forget", f"WITH {MATCH} SELECT subject_id, segment FROM {{subjects}} WHERE subject_id NOT IN (SELECT subject_id FROM m)")
def m7(t):
    return comply.forget(t.subjects, t.requests, ["subject_id"], email=["email"], name=["full_name"]).select("subject_id", "segment")


@query("m8_export", f"WITH {MATCH} SELECT request_id, '{{\"subject_id\":' || subject_id || ',\"email\":\"' || email || '\",\"full_name\":\"' || full_name || '\",\"segment\":\"' || segment || '\"}}' AS row FROM m")
def m8(t):
    return comply.export(t.subjects, t.requests, email=["email"], name=["full_name"])


@query("m9_pending", "SELECT request_id, request_type, requested_at FROM {requests} WHERE upper(status) = 'PENDING' AND email IS NOT NULL ORDER BY requested_at, request_id")
def m9(t):
    return comply.pending(t.requests).select("request_id", "request_type", "requested_at")


STATE = "st AS (SELECT schema_name, table_name, subject_id, consent_type, arg_max(status, event_id) AS status, max(ts) FILTER (status = 'GIVEN') AS given_at, max(ts) FILTER (status = 'WITHDRAWN') AS withdrawn_at FROM {consents} GROUP BY 1, 2, 3, 4)"


@query("m10_consent_state", f"WITH {STATE} SELECT * FROM st")
def m10(t):
    return comply.consent_state(t.consents)


@query("m11_without_consent", f"WITH {STATE} SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT subject_id FROM st WHERE status = 'GIVEN' AND consent_type = 'MARKETING')")
def m11(t):
    return comply.without_consent(t.events, comply.consent_state(t.consents), "user_id", "MARKETING").select("event_id", "user_id")


@query("m12_orphans", "SELECT schema_name, table_name, check_id FROM {quality_log} q WHERE NOT EXISTS (SELECT 1 FROM {catalog} c WHERE c.schema_name = q.schema_name AND c.table_name = q.table_name)")
def m12(t):
    return comply.orphan_rows(t.quality_log, t.catalog, ["schema_name", "table_name"]).select("schema_name", "table_name", "check_id")


@query("m13_invalid_entries", "SELECT CASE WHEN connection_string = '' THEN 'NO_CONNECTION' ELSE 'UNKNOWN_ENGINE' END AS reason, count(*) AS entries FROM {catalog} WHERE connection_string = '' OR db_engine = 'MongoDB' GROUP BY 1")
def m13(t):
    return comply.invalid_entries(t.catalog, ["MariaDB", "MSSQL", "PostgreSQL"])


@query("m14_vanished", "SELECT schema_name, table_name, db_engine FROM {catalog} EXCEPT SELECT schema_name, table_name, db_engine FROM {discovered}")
def m14(t):
    return comply.orphan_rows(t.catalog, t.discovered, ["schema_name", "table_name", "db_engine"]).select("schema_name", "table_name", "db_engine")


@query("m15_keep_recent", f"SELECT event_id, ts FROM {{app_logs}} WHERE ts >= {NOW} - INTERVAL 100 HOUR")
def m15(t):
    return comply.keep_recent(t.app_logs, "ts", as_of(), 100).select("event_id", "ts")


@query("m16_merge_catalog", """SELECT schema_name, table_name, db_engine, CASE WHEN c.status IS NULL OR (d.pk_columns IS NOT NULL AND (d.pk_columns <> c.pk_columns OR d.pk_strategy <> c.pk_strategy)) THEN 'FULL_LOAD' ELSE upper(c.status) END AS status, CASE WHEN c.status IS NULL THEN false ELSE c.active END AS active, coalesce(d.pk_columns, c.pk_columns) AS pk_columns, coalesce(d.pk_strategy, c.pk_strategy) AS pk_strategy, coalesce(d.table_size, c.table_size) AS table_size
FROM {catalog} c FULL JOIN {discovered} d USING (schema_name, table_name, db_engine)""")
def m16(t):
    return comply.merge_catalog(t.catalog, t.discovered)


@query("m17_activation", """WITH x AS (SELECT c.schema_name, c.table_name, upper(status) AS s, active, coalesce(live_rows, 0) AS live FROM {catalog} c LEFT JOIN {table_stats} t USING (schema_name, table_name)), y AS (SELECT *, CASE WHEN s = 'NO_DATA' THEN live > 0 ELSE active END AS na FROM x)
SELECT schema_name, table_name, CASE WHEN s = 'NO_DATA' AND live > 0 THEN 'FULL_LOAD' WHEN NOT na THEN 'SKIP' ELSE s END AS new_status, na AS new_active, live FROM y""")
def m17(t):
    return comply.activation(t.catalog, t.table_stats.select("schema_name", "table_name", "live_rows"))


@query("m18_table_sizes", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def m18(t):
    return comply.table_sizes({n: getattr(t, n) for n in ("orders", "events", "documents")})


@query("m19_glossary_search", "SELECT term_id, term FROM {glossary} WHERE contains(lower(term), '1') AND contains(lower(definition), 'a') OR contains(lower(domain), 'brand#1')")
def m19(t):
    found = comply.glossary_search(t.glossary, "Brand#1", ["domain"]).select("term_id", "term")
    both = comply.glossary_search(comply.glossary_search(t.glossary, "1", ["term"]), "A", ["definition"]).select("term_id", "term")
    return found.unionByName(both).distinct()


@query("m20_term_links", "SELECT DISTINCT term_id, term, table_name FROM (SELECT term_id, term, trim(unnest(string_split(related_tables, ','))) AS table_name FROM {glossary}) WHERE table_name <> ''")
def m20(t):
    return comply.term_links(t.glossary)


@query("m21_breach_flags", "SELECT schema_name, table_name, coalesce(sensitivity_level = 'CRITICAL', false) AS breach_notification FROM {catalog} LEFT JOIN {gov} USING (schema_name, table_name)")
def m21(t):
    return comply.breach_flags(t.catalog.select("schema_name", "table_name"), t.gov)


NEEDS = f"""n AS (SELECT schema_name, table_name, 'VACUUM' AS maintenance_type, fragmentation_pct FROM {{table_stats}} WHERE dead_rows > 1000 OR coalesce(100 * dead_rows / nullif(live_rows, 0) > 10, false) OR last_vacuum IS NULL OR last_vacuum < {NOW} - INTERVAL 7 DAY
UNION ALL SELECT schema_name, table_name, 'ANALYZE', fragmentation_pct FROM {{table_stats}} WHERE last_analyze IS NULL OR last_analyze < {NOW} - INTERVAL 1 DAY
UNION ALL SELECT schema_name, table_name, CASE WHEN page_count > 100 THEN CASE WHEN fragmentation_pct > 30 THEN 'REBUILD INDEX' ELSE 'REORGANIZE INDEX' END ELSE 'REINDEX' END, fragmentation_pct FROM {{table_stats}} WHERE (page_count > 100 AND fragmentation_pct > 10) OR fragmentation_pct > 30
UNION ALL SELECT schema_name, table_name, 'OPTIMIZE TABLE', fragmentation_pct FROM {{table_stats}} WHERE free_mb > 100 OR fragmentation_pct > 20)"""
PRIORITY = "CASE WHEN maintenance_type = 'VACUUM' THEN CASE WHEN fragmentation_pct > 50 THEN 9 WHEN fragmentation_pct > 30 THEN 7 ELSE 5 END WHEN maintenance_type IN ('REINDEX', 'REBUILD INDEX') THEN CASE WHEN fragmentation_pct > 50 THEN 8 WHEN fragmentation_pct > 30 THEN 6 ELSE 5 END ELSE 5 END"
NEXT = f"{NOW} + INTERVAL 1 DAY * CASE WHEN maintenance_type IN ('VACUUM', 'OPTIMIZE TABLE') THEN 7 WHEN maintenance_type IN ('REINDEX', 'REBUILD INDEX') THEN 30 ELSE 1 END"


@query("n1_needs", f"WITH {NEEDS} SELECT *, {PRIORITY} AS priority, {NEXT} AS next_date FROM n")
def n1(t):
    return comply.all_needs(t.table_stats, as_of())


@query("n7_merged_tasks", f"WITH {NEEDS} SELECT schema_name, table_name, maintenance_type, CASE WHEN n.fragmentation_pct IS NOT NULL THEN 'PENDING' ELSE o.status END AS status, CASE WHEN n.fragmentation_pct IS NOT NULL THEN {NEXT} ELSE o.next_date END AS next_date, CASE WHEN n.fragmentation_pct IS NOT NULL THEN {PRIORITY.replace('fragmentation_pct', 'n.fragmentation_pct')} ELSE 5 END AS priority FROM {{tasks}} o FULL JOIN n USING (schema_name, table_name, maintenance_type)")
def n7(t):
    return comply.merge_tasks(t.tasks, comply.all_needs(t.table_stats, as_of()))


@query("n8_due", f"SELECT schema_name, table_name, maintenance_type, {PRIORITY} AS priority FROM {{tasks}} WHERE status = 'PENDING' AND enabled AND next_date <= {NOW} ORDER BY priority DESC, next_date, schema_name, table_name LIMIT 50")
def n8(t):
    return comply.due(t.tasks, as_of(), 50).select("schema_name", "table_name", "maintenance_type", "priority")


@query("n9_impact", "SELECT object_name, CASE WHEN data_size_mb > 0 AND data_free_mb > 0 THEN data_size_mb - data_free_mb END AS space_reclaimed_mb, CASE WHEN fragmentation_pct > 0 AND missing_index_impact > 0 THEN round(fragmentation_pct - missing_index_impact, 4) END AS improvement_pct FROM {object_stats}")
def n9(t):
    s = t.object_stats
    return comply.impact(s.select("object_name", F.col("data_size_mb").alias("size_mb"), F.col("fragmentation_pct").alias("frag")), s.select("object_name", F.col("data_free_mb").alias("size_mb"), F.col("missing_index_impact").alias("frag")), ["object_name"])


@query("n10_report", "SELECT maintenance_type, count(*) AS tasks, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'COMPLETED') AS completed, max(next_date) AS last_date FROM {tasks} GROUP BY 1")
def n10(t):
    return comply.maintenance_report(t.tasks)
