"""Queries of single rules that other queries use inside larger results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, pii, sqltext
from ..operators import cdc, comply, evolve, govern, lineage, logs, metrics, quality, sensitive
from .operations import ACTIVITY, NEEDS, NEXT, NOW, PRIORITY, YEARS
from .quality import EDGES, GOVERNED, HEALTH, PHI_ANY, PII_CATEGORY, POLICIES
from .registry import as_of, query
from .replication import COMPATIBLE


@query("c14_redacted", "SELECT o_orderkey, 'host=h;user=u;password=***; port=' || o_custkey AS shown FROM orders")
def c14(t):
    return t.orders.select("o_orderkey", clean.redacted(F.concat(F.lit("host=h;user=u;password="), F.md5(F.col("o_orderkey").cast("string")), F.lit("; port="), F.col("o_custkey").cast("string"))).alias("shown"))


@query("d19_apply_statistics", "SELECT schema_name, table_name, cast(user_id AS bigint) AS batch, count(*) AS changes, count(*) FILTER (operation <> 'D') AS upserts, count(*) FILTER (operation = 'D') AS deletes, max(change_id) AS cursor FROM (SELECT *, json_extract_string(pk_values, '$.user_id') AS user_id FROM {change_log}) GROUP BY ALL")
def d19(t):
    return cdc.apply_statistics(t.change_log, F.get_json_object("pk_values", "$.user_id").cast("long"))


@query("e2_compatible", f"SELECT table_name, column_name, {COMPATIBLE} AS compatible FROM (SELECT table_name, column_name, t.pg_type AS o, s.pg_type AS n FROM {{columns_source}} s JOIN {{columns_target}} t USING (table_name, column_name))")
def e2(t):
    new = t.columns_source.select("table_name", "column_name", F.col("pg_type").alias("n"))
    return t.columns_target.join(new, ["table_name", "column_name"]).select("table_name", "column_name", evolve.compatible(F.col("pg_type"), F.col("n")).alias("compatible"))


@query("e4_dropped_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def e4(t):
    return evolve.evolve(t.orders, [("o_orderkey", "bigint"), ("o_orderstatus", "string")], keys=["o_orderkey"])[0]


@query("e5_cast_columns", "SELECT id, try_cast(cents AS bigint) AS cents, try_cast(cust AS integer) AS cust, status FROM {raw_rows}")
def e5(t):
    return evolve.evolve(t.raw_rows, [("id", "bigint"), ("cents", "bigint"), ("cust", "int"), ("status", "string")], keys=["id"])[0]


@query("f2_statistics", " UNION ALL ".join(f"SELECT '{c}' AS column_name, cast(min({c}) AS string) AS min_value, cast(max({c}) AS string) AS max_value, round(cast(sum(cast({c} AS decimal(38,6))) AS double) / count({c}), 4) AS mean FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_linenumber")))
def f2(t):
    return quality.profile(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), exact=False).select("column_name", "min_value", "max_value", F.round("mean", 4).alias("mean"))


@query("f9_status_counts", "SELECT CASE WHEN quality_score >= 90 THEN 'PASSED' WHEN quality_score >= 70 THEN 'WARNING' ELSE 'FAILED' END AS validation_status, count(*) AS n FROM {quality_log} GROUP BY 1")
def f9(t):
    return t.quality_log.groupBy(quality.status(F.col("quality_score")).alias("validation_status")).agg(F.count("*").alias("n"))


@query("f14_governance_duplicates", "SELECT round(100.0 * (count(*) - count(DISTINCT text)) / count(*), 4) AS duplicate_percentage FROM documents")
def f14(t):
    return quality.governance_duplicates(t.documents.select("text"))


@query("f16_overall_score", "SELECT table_name, round(greatest(0, 100 - 0.5 * null_percentage - 0.3 * duplicate_percentage - 0.2 * fragmentation_percentage), 4) AS overall_score FROM {gov}")
def f16(t):
    return quality.dimension_scores(t.gov).select("table_name", "overall_score")


@query("g2_health_names", f"SELECT p_partkey, regexp_matches(lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN '_Diagnosis' ELSE '' END), '{pii.PHI_NAMES}') AS is_phi FROM part")
def g2(t):
    return t.part.select("p_partkey", pii.phi_by_name(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "_Diagnosis").otherwise(""))).alias("is_phi"))


@query("g4_health_content", f"SELECT conv_id, turn, coalesce({PHI_ANY}, false) AS is_phi FROM (SELECT conv_id, turn, text AS v FROM conversations)")
def g4(t):
    return t.conversations.select("conv_id", "turn", pii.phi_by_content(F.col("text")).alias("is_phi"))


@query("g6_categories", f"SELECT CASE WHEN v IS NULL OR v = '' THEN 'UNKNOWN' ELSE {PII_CATEGORY} END AS category, count(*) AS n FROM (SELECT html AS v FROM pages) GROUP BY 1")
def g6(t):
    return t.pages.groupBy(pii.pii_category(F.col("html")).alias("category")).agg(F.count("*").alias("n"))


@query("g7_confidence", "SELECT table_name, column_name, CASE WHEN column_name = 'name' THEN 0.9 ELSE 0.6 END + CASE WHEN column_name = 'extra' THEN 0.05 ELSE 0 END::double AS confidence FROM {columns_source}")
def g7(t):
    n = F.col("column_name")
    return t.columns_source.select("table_name", "column_name", pii.confidence(n, n.isin("name", "extra"), n == "name").alias("confidence"))


@query("g11_backup", f"WITH {GOVERNED}, x AS (SELECT table_name, {POLICIES} FROM g) SELECT backup, count(*) AS n FROM x GROUP BY 1")
def g11(t):
    return t.gov.groupBy(sensitive.backup_frequency(F.col("data_category"), govern.access_frequency(F.col("query_count"))).alias("backup")).agg(F.count("*").alias("n"))


@query("g12_compliance", f"WITH {GOVERNED}, x AS (SELECT table_name, {POLICIES} FROM g) SELECT compliance, count(*) AS n FROM x GROUP BY 1")
def g12(t):
    return t.gov.groupBy(sensitive.compliance(F.col("sensitivity_level"), F.col("business_domain")).alias("compliance")).agg(F.count("*").alias("n"))


@query("g17_denied", "SELECT username, count(*) AS denied FROM {access_log} LEFT JOIN {gov} USING (schema_name, table_name) WHERE coalesce(sensitivity_level, '') IN ('CRITICAL', 'HIGH') AND NOT coalesce(masking_policy_applied, false) GROUP BY 1")
def g17(t):
    return sensitive.masking(t.access_log, t.gov).where("not allowed").groupBy("username").agg(F.count("*").alias("denied"))


@query("h1_access_frequency", f"WITH {GOVERNED} SELECT access_frequency, count(*) AS n FROM g GROUP BY 1")
def h1(t):
    return t.gov.groupBy(govern.access_frequency(F.col("query_count")).alias("access_frequency")).agg(F.count("*").alias("n"))


@query("h4_health_status", f"SELECT table_name, {HEALTH} FROM {{gov}}")
def h4(t):
    return t.gov.select("table_name", govern.health_status(F.col("fragmentation_percentage"), F.col("duplicate_percentage"), F.col("null_percentage")).alias("health_status"))


def _references(kind: str, confidence: float):
    name = {"VIEW": "i3_view_references", "TRIGGER": "i4_trigger_references"}[kind]

    @query(name, f"WITH {EDGES} SELECT schema_name, object_name, target_schema_name, target_object_name, {confidence}::double AS confidence_score FROM e WHERE object_type = '{kind}'")
    def references(t):
        return lineage.text_references(t.definitions.where(F.col("object_type") == kind)).select("schema_name", "object_name", "target_schema_name", "target_object_name", "confidence_score")


_references("VIEW", 0.9)
_references("TRIGGER", 0.85)


@query("i12_objects", "SELECT count(*) AS distinct_objects FROM (SELECT object_name FROM {edges} UNION SELECT target_object_name FROM {edges})")
def i12(t):
    return lineage.metrics(t.edges, as_of()).select("distinct_objects")


@query("i2_reachable", "WITH b AS (SELECT DISTINCT object_name AS a, target_object_name AS b FROM {edges} WHERE object_name < target_object_name), h AS (SELECT a, b, 1 AS hops FROM b UNION ALL SELECT x.a, y.b, 2 FROM b x JOIN b y ON x.b = y.a) SELECT a, b, min(hops)::integer AS hops FROM h GROUP BY 1, 2")
def reachable(t):
    return lineage.reachable(t.edges.where("object_name < target_object_name"), 2)


@query("j4_categories", "SELECT CASE WHEN starts_with(q, 'select') THEN CASE WHEN regexp_matches(q, 'count|sum|avg') THEN 'ANALYTICS' WHEN contains(q, 'join') THEN 'JOIN_QUERY' ELSE 'SELECT' END WHEN regexp_matches(q, '^(insert|update|delete)') THEN upper(substr(q, 1, 6)) WHEN regexp_matches(q, '^(create|alter|drop)') THEN 'DDL' ELSE 'OTHER' END AS query_category, count(*) AS n FROM (SELECT lower(query) AS q FROM {query_stats}) GROUP BY 1")
def j4(t):
    return t.query_stats.groupBy(sqltext.category(F.col("query")).alias("query_category")).agg(F.count("*").alias("n"))


@query("j8_durations", f"WITH {ACTIVITY} SELECT state, count(*) AS sessions, cast(sum(duration_ms) AS bigint) AS duration_ms, max(duration_ms) AS longest_ms FROM b GROUP BY 1")
def j8(t):
    return logs.activity(t.activity).groupBy("state").agg(F.count("*").alias("sessions"), F.sum("duration_ms").alias("duration_ms"), F.max("duration_ms").alias("longest_ms"))


@query("j10_activity_summary", f"WITH {ACTIVITY} SELECT count(*) AS sessions, count(*) FILTER (is_long_running) AS long_running, count(*) FILTER (is_blocking) AS blocking, count(*) FILTER (state = 'active') AS active FROM b")
def j10(t):
    return logs.activity(t.activity).agg(F.count("*").alias("sessions"), F.count_if("is_long_running").alias("long_running"), F.count_if("is_blocking").alias("blocking"), F.count_if(F.col("state") == "active").alias("active"))


@query("k2_io_counters", "SELECT c.schema_name, c.table_name, coalesce(live_rows + dead_rows, 0) AS io_operations FROM {catalog} c LEFT JOIN {table_stats} USING (schema_name, table_name)")
def k2(t):
    return metrics.catalog_metrics(t.catalog, t.table_stats).select("schema_name", "table_name", "io_operations")


@query("k3_metric_status", "SELECT CASE WHEN NOT active OR status = 'ERROR' THEN 'FAILED' WHEN status = 'PENDING' THEN 'PENDING' ELSE 'SUCCESS' END AS metric_status, count(*) AS n FROM {catalog} GROUP BY 1")
def k3(t):
    return metrics.catalog_metrics(t.catalog, t.table_stats).groupBy("metric_status").agg(F.count("*").alias("n"))


@query("k4_start_times", "SELECT schema_name, table_name, last_sync AS completed_at, last_sync - INTERVAL 1 HOUR AS started_at FROM {catalog}")
def k4(t):
    return metrics.catalog_metrics(t.catalog, t.table_stats).select("schema_name", "table_name", "completed_at", "started_at")


@query("m2_expiration", f"SELECT table_name, {NOW} + INTERVAL 1 YEAR * {YEARS} AS expires FROM {{gov}}")
def m2(t):
    return t.gov.select("table_name", comply.expiration(F.col("retention_policy"), as_of()).alias("expires"))


@query("n2_stale_statistics", f"SELECT schema_name, table_name, 'ANALYZE' AS maintenance_type, fragmentation_pct FROM {{table_stats}} WHERE last_analyze < {NOW} - INTERVAL 1 DAY")
def n2(t):
    return comply.stale_statistics(t.table_stats, as_of())


@query("n3_index_needs", f"WITH {NEEDS} SELECT * FROM n WHERE contains(maintenance_type, 'INDEX')")
def n3(t):
    return comply.index_needs(t.table_stats)


@query("n4_optimize_needs", "SELECT schema_name, table_name, 'OPTIMIZE TABLE' AS maintenance_type, fragmentation_pct FROM {table_stats} WHERE free_mb > 100 OR fragmentation_pct > 20")
def n4(t):
    return comply.optimize_needs(t.table_stats)


@query("n5_priorities", f"SELECT table_name, maintenance_type, {PRIORITY} AS priority FROM {{tasks}}")
def n5(t):
    return t.tasks.select("table_name", "maintenance_type", comply.priority(F.col("maintenance_type"), F.col("fragmentation_pct")).alias("priority"))


@query("n6_next_dates", f"SELECT table_name, maintenance_type, {NEXT} AS next_date FROM {{tasks}}")
def n6(t):
    return t.tasks.select("table_name", "maintenance_type", comply.next_date(F.col("maintenance_type"), as_of()).alias("next_date"))
