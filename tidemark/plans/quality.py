"""Queries over profiling, quality, sensitive data, governance and lineage (F to I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii, sqltext
from ..operators import govern, lineage, quality, sensitive
from .registry import as_of, query


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    rows = []
    for c, kind in columns.items():
        mean = f"cast(sum(cast({c} AS decimal(38,6))) / count({c}) AS double)" if kind != "string" else "cast(NULL AS double)"
        rows.append(f"SELECT '{c}' AS column_name, '{kind}' AS data_type, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, cast(min({c}) AS string) AS min_value, cast(max({c}) AS string) AS max_value, round({mean}, 4) AS mean, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_pct, round(100.0 * count(DISTINCT {c}) / count(*), 4) AS distinct_pct FROM {{{table}}}")
    return " UNION ALL ".join(rows)


@query("f1_profile", _profile_sql("orders_new", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "cents": "bigint"}))
def f1(t):
    return quality.profile(t.orders_new, exact=True).withColumn("mean", F.round("mean", 4))


@query("f3_column_catalog", """SELECT c.table_name, c.column_name, c.pg_type, c.is_nullable, c.is_pk, coalesce(k.kind = 'PK', false) AS in_pk, coalesce(k.kind = 'FK', false) AS is_fk, coalesce(k.kind = 'UQ', false) AS is_unique FROM {columns_source} c LEFT JOIN {constraints} k USING (table_name, column_name)""")
def f3(t):
    return quality.column_catalog(t.columns_source, t.constraints)


@query("f4_null_counts", "SELECT count(*) AS total_rows, count(*) FILTER (o_orderstatus IS NULL) AS null_count FROM {orders_new}")
def f4(t):
    return quality.null_counts(t.orders_new)


@query("f5_duplicates", "SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_count FROM lineitem")
def f5(t):
    return quality.duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("f6_type_failures", "SELECT 'cents' AS column_name, count(*) FILTER (cents = 'n/a') AS invalid_count, 'bigint' AS expected_type FROM {raw_rows} UNION ALL SELECT 'cust', count(*) FILTER (cust = 'x'), 'bigint' FROM {raw_rows}")
def f6(t):
    return quality.type_failures(t.raw_rows, {"cents": "bigint", "cust": "bigint"})


@query("f7_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def f7(t):
    return quality.orphans(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_custkey % 10 <> 0"), "c_custkey")


VALIDATE = """m AS (SELECT 'raw_rows' AS table_name, count(*) AS total_rows, cast(0 AS bigint) AS null_count, count(*) - count(DISTINCT (id, cents, cust, status)) AS duplicate_count, count(*) FILTER (cents = 'n/a') + count(*) FILTER (cust = 'x') AS invalid_type_count, count(*) FILTER (id % 20 = 0) AS orphans FROM {raw_rows}),
s AS (SELECT *, round(greatest(0.0, least(100.0, 100 - 20 * null_count / total_rows - 20 * duplicate_count / total_rows - 30 * invalid_type_count / total_rows - 30 * orphans / total_rows)), 4) AS quality_score FROM m)"""


@query("f10_validate", f"WITH {VALIDATE} SELECT *, CASE WHEN quality_score >= 90 THEN 'PASSED' WHEN quality_score >= 70 THEN 'WARNING' ELSE 'FAILED' END AS validation_status, '{{\"null_count\":' || null_count || ',\"duplicate_count\":' || duplicate_count || ',\"invalid_type_count\":' || invalid_type_count || ',\"orphans\":' || orphans || '}}' AS details FROM s")
def f10(t):
    parent = t.orders.where("o_orderkey % 20 <> 0").select(F.col("o_orderkey").alias("k"))
    return quality.validate(t.raw_rows, "raw_rows", expected={"cents": "bigint", "cust": "bigint"}, parents=[("id", parent, "k")])


@query("f8_scores", """SELECT table_name, schema_name, check_id, CASE WHEN quality_score >= 90 THEN 'PASSED' WHEN quality_score >= 70 THEN 'WARNING' ELSE 'FAILED' END AS validation_status FROM {quality_log}""")
def f8(t):
    return t.quality_log.select("schema_name", "table_name", "check_id", quality.status(F.col("quality_score")).alias("validation_status"))


@query("f11_validate_all", "SELECT 'orders' AS table_name, count(*) AS total_rows, cast(0 AS bigint) AS null_count, 100.0::double AS quality_score FROM orders UNION ALL SELECT 'customer', count(*), 0, 100.0 FROM customer UNION ALL SELECT 'part', count(*), 0, 100.0 FROM part")
def f11(t):
    return quality.validate_all({n: (getattr(t, n), None, ()) for n in ("orders", "customer", "part")}).select("table_name", "total_rows", "null_count", "quality_score")


@query("f12_latest_check", "SELECT schema_name, table_name, check_id, check_timestamp, quality_score FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY check_timestamp DESC, check_id DESC, quality_score DESC) AS r FROM {quality_log}) WHERE r = 1")
def f12(t):
    rows = t.quality_log.groupBy("schema_name", "table_name", "check_id", "check_timestamp").agg(F.max("quality_score").alias("quality_score"))
    return quality.latest_per(rows, ["schema_name", "table_name"], "check_timestamp", "check_id")


@query("f13_governance_nulls", "SELECT 25.0::double AS null_percentage, (SELECT round(100.0 * (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) / count(*), 4) FROM lineitem) AS duplicate_percentage")
def f13(t):
    k = F.lit(1)
    a = quality.governance_nulls(t.orders_new).withColumn("_k", k)
    return a.join(quality.governance_duplicates(t.lineitem.select("l_orderkey", "l_linenumber")).withColumn("_k", k), "_k").drop("_k")


DIM = "null_percentage AS n, duplicate_percentage AS d, fragmentation_percentage AS f"


@query("f15_dimensions", f"WITH x AS (SELECT table_name, {DIM} FROM {{gov}}) SELECT table_name, round(100 - 0.1 * n, 4) AS completeness_score, round(100 - 0.5 * d, 4) AS accuracy_score, round(100 - 0.2 * f, 4) AS consistency_score, round(100 - 0.3 * n, 4) AS validity_score, round(100 - 0.1 * f, 4) AS timeliness_score, round(100 - 0.8 * d, 4) AS uniqueness_score, round(100 - 0.3 * f, 4) AS integrity_score, round(greatest(0, 100 - 0.5 * n - 0.3 * d - 0.2 * f), 4) AS overall_score FROM x")
def f15(t):
    return quality.dimension_scores(t.gov).select("table_name", *[f"{n}_score" for n in quality.DIMENSIONS], "overall_score")


@query("f17_rules", "SELECT 'positive' AS rule_name, count(*) FILTER (NOT o_totalprice > 50000) AS violations FROM orders UNION ALL SELECT 'known_status', count(*) FILTER (NOT o_orderstatus IN ('O', 'F')) FROM orders")
def f17(t):
    return quality.check_rules(t.orders, [("positive", "o_totalprice > 50000"), ("known_status", "o_orderstatus IN ('O', 'F')")])


@query("f18_structure", """WITH c AS (SELECT table_name, count(*) AS columns, count(*) FILTER (is_nullable) AS nullable_columns FROM {columns_source} GROUP BY 1), k AS (SELECT table_name, count(*) FILTER (kind = 'FK') AS foreign_keys, count(*) FILTER (kind = 'UQ') AS unique_keys, string_agg(column_name, ',' ORDER BY position) FILTER (kind = 'PK') AS pk_columns FROM {constraints} GROUP BY 1) SELECT * FROM c LEFT JOIN k USING (table_name)""")
def f18(t):
    return quality.structure(t.columns_source, t.constraints)


# The patterns for an engine without lookarounds: with edges that consume a character, to test whether one occurs, ...
EDGES = "(?:^|[^0-9A-Za-z_])", "(?:$|[^0-9A-Za-z_])"
OCCURS = {"EMAIL": "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}", "PHONE": "(?:[+]?1[-. \t\n\f\r]?)?[(]?[0-9]{3}[)]?[-. \t\n\f\r]?[0-9]{3}[-. \t\n\f\r]?[0-9]{4}"} | {
    k: EDGES[0] + p + EDGES[1] for k, p in {"SSN": "[0-9]{3}-?[0-9]{2}-?[0-9]{4}", "CREDIT_CARD": "[0-9]{4}[- \t\n\f\r]?[0-9]{4}[- \t\n\f\r]?[0-9]{4}[- \t\n\f\r]?[0-9]{4}", "ZIP_CODE": "[0-9]{5}(?:-[0-9]{4})?", "IP": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"}.items()
}
GAP = ">[- \t\n\f\r]<"
# ... and, to count all, over text in which < and > stand around every run of word characters, by the lengths of the runs.
RUNS = {
    "SSN": "<[0-9]{9}>|<[0-9]{3}>-<[0-9]{6}>|<[0-9]{5}>-<[0-9]{4}>|<[0-9]{3}>-<[0-9]{2}>-<[0-9]{4}>",
    "CREDIT_CARD": "|".join("<[0-9]{4}" + "[0-9]{4}".join((x, y, z)) + "[0-9]{4}>" for x in ("", GAP) for y in ("", GAP) for z in ("", GAP)),
    "ZIP_CODE": "<[0-9]{5}>(?:-<[0-9]{4}>)?", "IP": "<[0-9]{1,3}>[.]<[0-9]{1,3}>[.]<[0-9]{1,3}>[.]<[0-9]{1,3}>",
}
PII_ANY = "regexp_matches(v, '" + "|".join(f"(?:{p})" for p in OCCURS.values()) + "')"
PII_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{k}'" for k, p in OCCURS.items() if k != "IP") + " ELSE 'IDENTIFIER' END"
PHI_ANY = f"(regexp_matches(lower(v), '{pii.PHI_WORDS}') OR regexp_matches(v, '{pii.MEDICAL_CODE}'))"


@query("g1_names", f"SELECT p_partkey, regexp_matches(lower(n), '{pii.PII_NAMES}') AS is_pii, regexp_matches(lower(n), '{pii.PHI_NAMES}') AS is_phi FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Email_' WHEN 1 THEN 'patient_id_' WHEN 2 THEN 'ZIPcode' ELSE p_name END || p_partkey AS n FROM part)")
def g1(t):
    n = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Email_' WHEN 1 THEN 'patient_id_' WHEN 2 THEN 'ZIPcode' ELSE p_name END || p_partkey")
    return t.part.select("p_partkey", pii.pii_by_name(n).alias("is_pii"), pii.phi_by_name(n).alias("is_phi"))


@query("g3_content", f"SELECT doc_id, coalesce({PII_ANY}, false) AS is_pii, coalesce({PHI_ANY}, false) AS is_phi, CASE WHEN v IS NULL OR v = '' THEN 'UNKNOWN' ELSE {PII_CATEGORY} END AS category FROM (SELECT doc_id, text AS v FROM documents)")
def g3(t):
    return sensitive.content(sensitive.spread(t.documents.select("doc_id", "text")), "text", ["doc_id"])


PII_TABLE = """v AS (SELECT 'email' AS column_name, 'user' || c_custkey || '@mail.test' AS v FROM customer UNION ALL SELECT 'ref', CASE WHEN c_custkey % 10 = 0 THEN '123-45-6789' ELSE 'x' END FROM customer UNION ALL SELECT 'zip', CASE WHEN c_custkey % 5 = 0 THEN '90210' END FROM customer UNION ALL SELECT 'patient_note', CASE WHEN c_custkey % 9 = 0 THEN 'Allergy' ELSE 'ok' END FROM customer)"""


@query("g5_verdicts", f"""WITH {PII_TABLE}, h AS (SELECT column_name, v, {PII_ANY} AS hit, {PHI_ANY} AS phi, {PII_CATEGORY} AS cat FROM v WHERE v IS NOT NULL),
s AS (SELECT column_name, count(*) AS values, count(*) FILTER (hit) AS pii_hits, count(*) FILTER (phi) AS phi_hits, mode(cat) FILTER (hit) AS cat FROM h GROUP BY 1),
x AS (SELECT *, pii_hits > 0.1 * values AS bc, regexp_matches(column_name, '{pii.PII_NAMES}') AS bn, phi_hits > 0.1 * values AS pc, regexp_matches(column_name, '{pii.PHI_NAMES}') AS pn FROM s)
SELECT 'people' AS table_name, column_name, values, pii_hits, phi_hits, bc OR bn AS contains_pii, CASE WHEN bc THEN 'CONTENT_ANALYSIS' WHEN bn THEN 'NAME_BASED' END AS pii_method, CASE WHEN bc OR bn THEN coalesce(cat, 'UNKNOWN') END AS pii_category,
CASE WHEN bc THEN 0.9 WHEN bn THEN CASE WHEN regexp_matches(column_name, 'email|phone|ssn') THEN 0.8 ELSE 0.65 END END::double AS pii_confidence, pc OR pn AS contains_phi, CASE WHEN pc THEN 0.85 WHEN pn THEN 0.6 END::double AS phi_confidence FROM x""")
def g5(t):
    k = F.col("c_custkey")
    people = t.customer.select(F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.test")).alias("email"), F.when(k % 10 == 0, "123-45-6789").otherwise("x").alias("ref"), F.when(k % 5 == 0, "90210").alias("zip"), F.when(k % 9 == 0, "Allergy").otherwise("ok").alias("patient_note"))
    return sensitive.verdicts(people, "people")


def _counts(table: str, key: str, text: str) -> str:
    marked = f"(SELECT {key}, {text} AS v, regexp_replace(translate({text}, '<>', '()'), '([0-9A-Za-z_]+)', '<\\1>', 'g') AS m FROM {table})"
    parts = [f"SELECT {key}, '{k}' AS category, len(regexp_extract_all({'m' if k in RUNS else 'v'}, '{RUNS.get(k, p)}')) AS n FROM {marked}" for k, p in OCCURS.items()]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@query("g8_occurrences", _counts("documents", "doc_id", "text"))
def g8(t):
    return sensitive.occurrences(t.documents, "doc_id", "text")


@query("g8_adjacent", _counts("{contacts}", "id", "note"))
def g8_adjacent(t):
    return sensitive.occurrences(t.contacts, "id", "note")


RULES = [("domain", 1, "schema", "s1", "FINANCE"), ("domain", 2, "table", "t1", "HEALTHCARE"), ("domain", 3, "table", "T2", "SPORTS"), ("category", 1, "table", "9", "ANALYTICAL")]


@query("g9_classify", "SELECT schema_name, table_name, CASE WHEN contains(schema_name, 's1') THEN 'FINANCE' WHEN contains(table_name, 't1') THEN 'HEALTHCARE' WHEN contains(table_name, 't2') THEN 'SPORTS' ELSE 'GENERAL' END AS domain FROM {gov}")
def g9(t):
    rules = t.spark.createDataFrame(RULES, "kind string, rule_order int, match_on string, keyword string, label string")
    return sensitive.classify(t.gov.select("schema_name", "table_name"), rules, "domain", "GENERAL")


GOVERNED = """g AS (SELECT *, CASE WHEN query_count > 10000 THEN 'REAL_TIME' WHEN query_count > 1000 THEN 'HIGH' WHEN query_count > 100 THEN 'MEDIUM' WHEN query_count > 10 THEN 'LOW' WHEN query_count > 0 THEN 'RARE' ELSE 'ARCHIVED' END AS access_frequency FROM {gov})"""
POLICIES = """CASE sensitivity_level WHEN 'CRITICAL' THEN '7_YEARS' WHEN 'HIGH' THEN '5_YEARS' ELSE CASE data_category WHEN 'ANALYTICAL' THEN '3_YEARS' WHEN 'SPORTS' THEN '3_YEARS' WHEN 'TRANSACTIONAL' THEN '2_YEARS' ELSE '1_YEAR' END END AS retention,
CASE WHEN access_frequency IN ('REAL_TIME', 'HIGH') THEN 'HOURLY' WHEN data_category IN ('TRANSACTIONAL', 'MASTER_DATA', 'SPORTS') THEN 'DAILY' WHEN data_category = 'ANALYTICAL' THEN 'WEEKLY' ELSE 'MONTHLY' END AS backup,
CASE business_domain WHEN 'HEALTHCARE' THEN 'HIPAA' WHEN 'FINANCE' THEN CASE WHEN sensitivity_level IN ('CRITICAL', 'HIGH') THEN 'SOX,PCI' ELSE 'SOX' END WHEN 'SPORTS' THEN CASE WHEN sensitivity_level IN ('CRITICAL', 'HIGH') THEN 'GDPR,PCI,AML' ELSE 'GDPR,AML' END ELSE 'GDPR' END AS compliance"""
HEALTH = "CASE WHEN fragmentation_percentage > 80 OR duplicate_percentage > 50 OR null_percentage > 70 THEN 'EMERGENCY' WHEN fragmentation_percentage > 50 OR duplicate_percentage > 20 OR null_percentage > 50 THEN 'CRITICAL' WHEN fragmentation_percentage > 20 OR duplicate_percentage > 10 OR null_percentage > 30 THEN 'WARNING' WHEN fragmentation_percentage = 0 AND duplicate_percentage = 0 AND null_percentage < 5 THEN 'EXCELLENT' ELSE 'HEALTHY' END AS health_status"


@query("h13_governance_row", f"WITH {GOVERNED} SELECT schema_name, table_name, access_frequency, {HEALTH}, {POLICIES} FROM g")
def h13(t):
    return govern.governance_row(t.gov).select("schema_name", "table_name", "access_frequency", "health_status", "retention", "backup", "compliance")


@query("g10_policies", f"WITH {GOVERNED} SELECT table_name, {POLICIES} FROM g")
def g10(t):
    s, c, d = F.col("sensitivity_level"), F.col("data_category"), F.col("business_domain")
    return t.gov.select("table_name", sensitive.retention_policy(c, s).alias("retention"), sensitive.backup_frequency(c, govern.access_frequency(F.col("query_count"))).alias("backup"), sensitive.compliance(s, d).alias("compliance"))


VERDICT_ROWS = "SELECT table_name, column_name, contains_pii, contains_phi, CASE WHEN contains_pii THEN cat END AS pii_category, CASE WHEN contains_pii THEN conf END AS pii_confidence FROM (SELECT table_name, column_name, column_name IN ('name', 'extra') AS contains_pii, column_name = 'made' AS contains_phi, CASE WHEN column_name = 'name' THEN 'EMAIL' ELSE 'PHONE' END AS cat, CASE WHEN column_name = 'name' THEN 0.9 ELSE 0.65 END AS conf FROM {columns_source})"


def verdict_rows(t):
    name = F.col("column_name")
    v = t.columns_source.select("table_name", "column_name", name.isin("name", "extra").alias("contains_pii"), (name == "made").alias("contains_phi"), F.when(name == "name", "EMAIL").when(name == "extra", "PHONE").alias("pii_category"))
    return v.withColumn("pii_confidence", F.when(F.col("pii_category") == "EMAIL", 0.9).when(F.col("pii_category") == "PHONE", 0.65))


@query("g13_rollup", f"WITH v AS ({VERDICT_ROWS}) SELECT table_name, count(*) FILTER (contains_pii) AS pii_columns, count(*) FILTER (contains_phi) AS phi_columns, max(pii_confidence)::double AS max_confidence, string_agg(DISTINCT pii_category, ',' ORDER BY pii_category) AS pii_categories FROM v GROUP BY 1")
def g13(t):
    return sensitive.table_rollup(verdict_rows(t))


@query("g14_catalog_report", "SELECT pg_type, count(*) AS columns, count(DISTINCT table_name) AS tables, count(*) FILTER (is_pk) AS key_columns, count(*) FILTER (is_nullable) AS nullable_columns FROM {columns_source} GROUP BY 1")
def g14(t):
    return sensitive.catalog_report(t.columns_source, "pg_type")


@query("g15_sensitive_access", "SELECT event_id, username FROM {access_log} WHERE (schema_name, table_name) IN (SELECT schema_name, table_name FROM {gov} WHERE sensitivity_level = 'CRITICAL')")
def g15(t):
    return sensitive.sensitive_rows(t.access_log, t.gov.where("sensitivity_level = 'CRITICAL'"), ["schema_name", "table_name"]).select("event_id", "username")


@query("g16_masking", "SELECT event_id, is_sensitive_data AND coalesce(masking_policy_applied, false) AS should_mask, NOT (coalesce(sensitivity_level, '') IN ('CRITICAL', 'HIGH') AND NOT coalesce(masking_policy_applied, false)) AS allowed FROM {access_log} LEFT JOIN {gov} USING (schema_name, table_name)")
def g16(t):
    return sensitive.masking(t.access_log, t.gov).select("event_id", "should_mask", "allowed")


@query("g16_masked", "SELECT subject_id, sha256('s' || email) AS email, segment FROM {subjects}")
def g16_masked(t):
    return sensitive.mask_columns(t.subjects.select("subject_id", "email", "segment"), ["email"], "s")


@query("h2_usage", "SELECT schema_name, table_name, count(*) AS query_count, CASE WHEN count(*) > 10000 THEN 'REAL_TIME' WHEN count(*) > 1000 THEN 'HIGH' WHEN count(*) > 100 THEN 'MEDIUM' WHEN count(*) > 10 THEN 'LOW' ELSE 'RARE' END AS access_frequency FROM {access_log} GROUP BY ALL")
def h2(t):
    return govern.usage(t.access_log, ["schema_name", "table_name"])


@query("h3_churn", "WITH k AS (SELECT schema_name, table_name, pk_values, count(*) AS v, arg_max(operation, change_id) AS op FROM {change_log} GROUP BY ALL) SELECT schema_name, table_name, count(*) FILTER (op <> 'D') AS live_rows, cast(sum(v) - count(*) FILTER (op <> 'D') AS bigint) AS dead_rows, CASE WHEN count(*) FILTER (op <> 'D') > 0 THEN round(100.0 * (sum(v) - count(*) FILTER (op <> 'D')) / count(*) FILTER (op <> 'D'), 4) END AS churn_pct FROM k GROUP BY ALL")
def h3(t):
    return govern.churn(t.change_log, ["pk_values"])


BAND = "CASE WHEN health_score >= 80 THEN 'HEALTHY' WHEN health_score >= 60 THEN 'WARNING' ELSE 'CRITICAL' END AS health_status"
FRAG = "CASE WHEN fragmentation_pct > 30 THEN least((fragmentation_pct - 30) * 0.5, 40) ELSE 0 END"
MSSQL = f"x AS (SELECT *, round(greatest(0, least(100, 100 - {FRAG} - CASE WHEN is_unused AND object_type = 'INDEX' THEN 20 ELSE 0 END - CASE WHEN has_missing_index AND missing_index_impact > 50 THEN 15 ELSE 0 END - CASE WHEN object_type = 'DATABASE' AND last_full_backup IS NULL THEN 10 ELSE 0 END - CASE WHEN object_type = 'STORED_PROCEDURE' AND avg_seconds > 5 THEN 10 ELSE 0 END)), 4) AS health_score FROM {{object_stats}})"


@query("h5_mssql_health", f"""WITH {MSSQL} SELECT object_name, health_score, {BAND}, CASE WHEN fragmentation_pct > 30 THEN 'Rebuild the index: fragmentation ' || cast(floor(fragmentation_pct) AS bigint) || '%' WHEN has_missing_index THEN 'Create the missing index: impact ' || cast(floor(missing_index_impact) AS bigint) || '%' WHEN is_unused AND object_type = 'INDEX' THEN 'Index is unused' WHEN object_type = 'STORED_PROCEDURE' AND avg_seconds > 5 THEN 'Slow procedure: ' || cast(floor(avg_seconds) AS bigint) || ' s' END AS recommendation FROM x""")
def h5(t):
    return govern.mssql_health(t.object_stats).select("object_name", "health_score", "health_status", "recommendation")


@query("h6_mariadb_health", f"WITH x AS (SELECT object_name, round(greatest(0, 100 - {FRAG} - CASE WHEN data_free_mb > data_size_mb * 0.5 THEN 15 ELSE 0 END - CASE WHEN user_expired_count > 0 THEN 10 ELSE 0 END - CASE WHEN user_locked_count > user_total * 0.1 THEN 10 ELSE 0 END), 4) AS health_score FROM {{object_stats}}) SELECT object_name, health_score, {BAND} FROM x")
def h6(t):
    return govern.mariadb_health(t.object_stats).select("object_name", "health_score", "health_status")


@query("h7_mongo_health", f"WITH x AS (SELECT object_name, (100.0 - CASE WHEN index_count = 0 AND document_count > 1000 THEN 20 ELSE 0 END - CASE WHEN total_size_mb > 10000 THEN 10 ELSE 0 END - CASE WHEN avg_object_size_bytes > 1048576 THEN 15 ELSE 0 END)::double AS health_score, nullif(concat_ws('; ', CASE WHEN index_count = 0 AND document_count > 1000 THEN 'Add indexes' END, CASE WHEN total_size_mb > 10000 THEN 'Archive old data' END, CASE WHEN avg_object_size_bytes > 1048576 THEN 'Split large documents' END), '') AS recommendation, CASE WHEN document_count > 10000 THEN 'HIGH' WHEN document_count > 1000 THEN 'MEDIUM' ELSE 'LOW' END AS access_frequency FROM {{object_stats}}) SELECT *, {BAND} FROM x")
def h7(t):
    return govern.mongo_health(t.object_stats).select("object_name", "health_score", "health_status", "recommendation", "access_frequency")


@query("h8_oracle_health", f"WITH c AS (SELECT *, CASE WHEN chain_cnt > 0 AND num_rows > 0 THEN chain_cnt / num_rows * 100 ELSE 0 END AS ch, CASE WHEN blocks > 0 AND empty_blocks > 0 THEN empty_blocks / blocks * 100 ELSE 0 END AS em FROM {{object_stats}}), x AS (SELECT object_name, round(greatest(0, 100 - CASE WHEN ch > 5 THEN least((ch - 5) * 2, 30) ELSE 0 END - CASE WHEN em > 20 THEN 15 ELSE 0 END - CASE WHEN logging = 'NO' THEN 10 ELSE 0 END), 4) AS health_score FROM c) SELECT object_name, health_score, {BAND} FROM x")
def h8(t):
    return govern.oracle_health(t.object_stats).select("object_name", "health_score", "health_status")


@query("h9_rollup", f"WITH {MSSQL}, y AS (SELECT *, {BAND} FROM x) SELECT object_type, count(*) AS objects, count(*) FILTER (health_status = 'HEALTHY') AS healthy, count(*) FILTER (health_status = 'WARNING') AS warning, count(*) FILTER (health_status = 'CRITICAL') AS critical, round(cast(sum(cast(health_score AS decimal(20,4))) AS double) / count(*), 4) AS avg_score FROM y GROUP BY 1")
def h9(t):
    return govern.rollup(govern.mssql_health(t.object_stats), "object_type")


@query("h10_with_stats", "SELECT object_name, object_type, chain_cnt, CASE WHEN document_count > 5000 THEN total_size_mb END AS total_size_mb FROM {object_stats}")
def h10(t):
    s = t.object_stats
    return govern.with_stats(s.select("object_name", "object_type"), [s.select("object_name", "chain_cnt"), s.where("document_count > 5000").select("object_name", "total_size_mb")], ["object_name"])


@query("h11_last_backups", "SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last_full, max(ts) FILTER (event_type = 'view') AS last_log FROM events GROUP BY 1")
def h11(t):
    return govern.last_backups(t.events.select("user_id", F.col("event_type").alias("kind"), F.col("ts").alias("finished_at")), ["user_id"], {"purchase": "last_full", "view": "last_log"})


@query("h12_ordered_list", "SELECT table_name, string_agg(column_name, ',' ORDER BY position, column_name) AS columns FROM {constraints} WHERE kind = 'PK' GROUP BY 1")
def h12(t):
    return govern.ordered_list(t.constraints.where("kind = 'PK'"), ["table_name"], "position", "column_name", "columns")


@query("h14_engine", "SELECT g.schema_name, g.table_name, coalesce(k.e, 'UNKNOWN') AS inferred_engine FROM {gov} g LEFT JOIN (SELECT schema_name, min(db_engine) AS e FROM {catalog} WHERE schema_name <> 's3' GROUP BY 1) k USING (schema_name)")
def h14(t):
    return govern.infer_engine(t.gov.select("schema_name", "table_name"), t.catalog.where("schema_name <> 's3'"))


@query("h15_averages", "SELECT queryid, CASE WHEN calls > 0 THEN round(total_time_ms / calls, 4) END AS avg_total_time_ms FROM {query_stats}")
def h15(t):
    return govern.averages(t.query_stats, "calls", ["total_time_ms"]).select("queryid", "avg_total_time_ms")


@query("h16_missing_indexes", "SELECT l_orderkey * 10 + l_linenumber AS detail_id, l_partkey AS index_handle, p_size AS group_handle, round(s.s_nationkey * s.s_suppkey * (s.s_suppkey % 100) / 100, 4)::double AS advantage FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier s ON p_size = s.s_suppkey")
def h16(t):
    d = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("detail_id"), F.col("l_partkey").alias("index_handle"))
    g = t.part.select(F.col("p_partkey").alias("index_handle"), F.col("p_size").alias("group_handle"))
    s = t.supplier.select(F.col("s_suppkey").cast("int").alias("group_handle"), F.col("s_nationkey").alias("user_seeks"), F.col("s_suppkey").alias("avg_cost"), (F.col("s_suppkey") % 100).alias("avg_impact"))
    return govern.missing_indexes(d, g, s).select("detail_id", "index_handle", "group_handle", "advantage")


@query("h17_sizes", "SELECT object_name, round(avg_object_size_bytes * document_count / 1048576, 4) AS size_mb, round(blocks * 8 / 1024, 4) AS blocks_mb, data_size_mb + data_free_mb AS total_mb FROM {object_stats}")
def h17(t):
    return govern.sizes(t.object_stats).select("object_name", "size_mb", "blocks_mb", "total_mb")


@query("i1_foreign_keys", "SELECT table_name AS object_name, column_name, ref_table AS target_object_name, ref_column AS target_column_name, 'FOREIGN_KEY' AS relationship_type, 1 AS dependency_level, 1.0::double AS confidence_score, table_name || '|' || column_name || '|' || ref_table || '|FOREIGN_KEY' AS edge_key FROM {constraints} WHERE kind = 'FK'")
def i1(t):
    return lineage.foreign_keys(t.constraints)


REFS = sqltext.TABLES.replace("'", "''")
EDGES = f"""n AS (SELECT schema_name, object_name, object_type, unnest(list_distinct(list_transform(regexp_extract_all(text, '{REFS}', 1), lambda x: lower(x)))) AS name FROM {{definitions}}),
e AS (SELECT DISTINCT schema_name, object_name, object_type, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE schema_name END AS target_schema_name, CASE WHEN contains(name, '.') THEN split_part(name, '.', 2) ELSE name END AS target_object_name FROM n)"""


def _scoped(kind: str):
    return f"""SELECT DISTINCT d.schema_name, d.object_name, coalesce(v.s, d.schema_name) AS target_schema_name, v.t || CASE WHEN v.t IN ('t', 'src') THEN cast(d.n AS string) ELSE '' END AS target_object_name FROM {{definitions_odd}} d
JOIN (VALUES (0, 'sales', 'orders'), (1, NULL, 'part'), (1, NULL, 'lineitem'), (2, NULL, 'supplier'), (3, NULL, 'My Table'), (3, 'b', 'c'), (4, NULL, 't'), (4, NULL, 'region'), (4, NULL, 'nation'), (4, NULL, 'events'), (5, NULL, 'orders'), (5, NULL, 'stock'), (6, NULL, 'tgt'), (6, NULL, 'src')) AS v(k, s, t)
ON v.k = d.kind WHERE d.object_type = '{kind}'"""


for _name, _kind in (("i2_scoped_references", "PROCEDURE"), ("i3_scoped_views", "VIEW"), ("i4_scoped_triggers", "TRIGGER")):
    query(_name, _scoped(_kind))(lambda t, kind=_kind: lineage.text_references(t.definitions_odd.where(F.col("object_type") == kind), clean=True).select("schema_name", "object_name", "target_schema_name", "target_object_name"))


@query("i2_text_references", f"WITH {EDGES} SELECT *, CASE object_type WHEN 'PROCEDURE' THEN 0.8 WHEN 'VIEW' THEN 0.9 ELSE 0.85 END::double AS confidence_score, 2 AS dependency_level, concat_ws('|', schema_name, object_name, target_schema_name, target_object_name, object_type) AS edge_key FROM e")
def i2(t):
    return lineage.text_references(t.definitions)


@query("i5_reassembled", "SELECT def_id, object_type, text FROM {definitions}")
def i5(t):
    return lineage.reassembled(t.def_lines, ["def_id", "object_type"])


@query("i6_dependencies", "SELECT DISTINCT object_name, target_object_name, CASE object_type WHEN 'PROCEDURE' THEN 0.95 ELSE 0.9 END::double AS confidence_score, object_type AS kind FROM {edges} WHERE object_name <> target_object_name AND object_type IN ('PROCEDURE', 'TABLE')")
def i6(t):
    return lineage.dependencies(t.edges.select("object_name", "target_object_name", F.col("object_type").alias("kind")))


@query("i7_document_references", """SELECT 'ref' AS field, 0.7::double AS confidence_score, count(*) AS documents FROM {documents_json} WHERE json_exists(doc, '$.ref') UNION ALL SELECT 'owner', 0.6, count(*) FROM {documents_json} WHERE json_exists(doc, '$.owner')""")
def i7(t):
    return lineage.document_references(t.documents_json)


@query("i7_containment", """SELECT 'ref' AS field, 'users' AS collection, cast(1 AS double) AS share, count(DISTINCT user_id) AS n_values FROM {events} WHERE event_id % 3 = 0
UNION ALL SELECT 'owner', 'kinds', cast(count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) AS double) / count(DISTINCT event_type), count(DISTINCT event_type) FROM {events} WHERE event_id % 4 = 0""")
def i7_containment(t):
    short = lambda c: F.substring(F.md5(F.col(c).cast("string")), 1, 24)
    references = t.events.where("event_id % 3 = 0").select(F.lit("ref").alias("field"), short("user_id").alias("value")).unionByName(t.events.where("event_id % 4 = 0").select(F.lit("owner").alias("field"), short("event_type").alias("value")))
    ids = t.events.select(F.lit("users").alias("collection"), short("user_id").alias("id")).unionByName(t.events.where("event_type <> 'error'").select(F.lit("kinds").alias("collection"), short("event_type").alias("id"))).unionByName(t.events.withColumn("later", F.col("event_id") + 1_000_000_000).select(F.lit("events").alias("collection"), short("later").alias("id")))
    return lineage.containment(references, ids)


@query("i8_view_edges", "SELECT object_name, 't' || cast(def_id % 7 AS string) AS target_object_name, 'VIEW_ON' AS relationship_type, 1.0::double AS confidence_score FROM {definitions} WHERE object_type = 'VIEW'")
def i8(t):
    return lineage.view_edges(t.definitions.select(F.col("object_name").alias("name"), F.lower("object_type").alias("kind"), F.concat(F.lit("t"), (F.col("def_id") % 7).cast("string")).alias("view_on")))


@query("i9_edge_keys", "SELECT def_id, concat_ws('|', schema_name, object_name, 'a' || chr(92) || '|b') AS edge_key FROM {definitions}")
def i9(t):
    return t.definitions.withColumn("odd", F.lit("a|b")).select("def_id", lineage.edge_key("schema_name", "object_name", "odd").alias("edge_key"))


@query("i10_merged", """SELECT edge_key, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, arg_max(confidence_score, (seen_at, seen_id)) AS confidence_score FROM {edges} GROUP BY 1""")
def i10(t):
    return lineage.merged(t.edges, ["confidence_score"])


@query("i11_metrics", """SELECT count(*) AS relationships, count(DISTINCT edge_key) AS edges, count(*) FILTER (confidence_score >= 0.9) AS high_confidence, count(*) FILTER (confidence_score >= 0.7 AND confidence_score < 0.9) AS medium_confidence, count(*) FILTER (confidence_score < 0.7) AS low_confidence, round(cast(sum(cast(confidence_score AS decimal(20,4))) AS double) / count(*), 4) AS avg_confidence, max(dependency_level) AS max_level,
count(*) FILTER (seen_at >= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 7 DAY) AS seen_in_week, (SELECT count(*) FROM (SELECT object_name FROM {edges} UNION SELECT target_object_name FROM {edges})) AS distinct_objects FROM {edges}""")
def i11(t):
    return lineage.metrics(t.edges, F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))


@query("i13_tree", "SELECT object_name, object_type, count(DISTINCT target_object_name) AS targets, md5(string_agg(DISTINCT target_object_name, ',' ORDER BY target_object_name)) AS target_list_md5 FROM {edges} GROUP BY ALL")
def i13(t):
    return lineage.tree(t.edges)


@query("i14_listing", "SELECT edge_key, object_name, confidence_score, seen_id FROM {edges} WHERE relationship_type = 'READS' AND contains(lower(target_object_name), 't1') ORDER BY confidence_score DESC, seen_id DESC, edge_key LIMIT 50")
def i14(t):
    from ..operators import metrics

    rows, _ = metrics.page(t.edges, where={"relationship_type": "READS"}, contains=("target_object_name", "T1"), order=[F.desc("confidence_score"), F.desc("seen_id"), F.asc("edge_key")], size=50)
    return rows.select("edge_key", "object_name", "confidence_score", "seen_id")
