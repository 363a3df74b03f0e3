"""Queries over sources, cleaning, change data capture and schema evolution (A to E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import cdc, digest, evolve
from ..sources import scan, scratch, sinks
from .registry import as_of, query

KEYS, IMAGE = "user_id long", "cents long, kind string"
PARSED = """p AS (SELECT change_id, operation, cast(json_extract_string(pk_values, '$.user_id') AS bigint) AS user_id, cast(json_extract_string(row_data, '$.cents') AS bigint) AS cents, json_extract_string(row_data, '$.kind') AS kind,
  row_data IS NOT NULL AND coalesce(json_exists(row_data, '$.cents'), false) AS has_cents, row_data IS NOT NULL AND coalesce(json_exists(row_data, '$.kind'), false) AS has_kind FROM {change_log})"""
LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY change_id DESC) AS rn FROM p) WHERE rn = 1)"


@query("a1_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice > 100000")
def a1(t):
    return scan.read_table(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderkey % 3 = 0 AND o_totalprice > 100000")


@query("a2_change_scan", "SELECT change_id, operation, pk_values FROM {change_log} WHERE change_id > 400")
def a2(t):
    return cdc.since(t.change_log, 400).select("change_id", "operation", "pk_values")


@query("a3_document_fields", """WITH k AS (SELECT event_id, unnest(json_keys(doc)) AS field, generate_subscripts(json_keys(doc), 1) - 1 AS place FROM {documents_json})
SELECT field, arg_min(event_id, (event_id, place)) AS first_seen, cast(arg_min(place, (event_id, place)) AS integer) AS place, count(*) AS documents FROM k GROUP BY field""")
def a3(t):
    return scan.fields(t.documents_json, "doc", "event_id")


@query("a4_flatten", """SELECT event_id, json_extract_string(doc, '$._id."$oid"') AS _id, json_extract_string(doc, '$.user') AS user, json_extract_string(doc, '$.kind') AS kind, json_extract_string(doc, '$.ok') AS ok, json_extract_string(doc, '$.ref."$oid"') AS ref, CAST(NULL AS VARCHAR) AS tags, doc AS _document FROM {documents_json}""")
def a4(t):
    return scan.flatten(t.documents_json, "doc", ["_id", "user", "kind", "ok", "ref", "tags"], ["event_id"])


@query("a5_payload", """WITH x AS (SELECT body_id, cast(CASE WHEN starts_with(body, '[') THEN body::JSON WHEN json_exists(body, '$.data') THEN json_extract(body, '$.data') WHEN json_exists(body, '$.results') THEN json_extract(body, '$.results') ELSE ('[' || body || ']')::JSON END AS JSON[]) AS items FROM {bodies}),
y AS (SELECT body_id, unnest(items) AS r FROM x) SELECT body_id, cast(json_extract_string(r, '$.id') AS bigint) AS id, json_extract_string(r, '$.segment') AS segment, cast(json_extract_string(r, '$.bal') AS double) AS bal FROM y""")
def a5(t):
    r = scan.payload_rows(t.bodies, "body", ["body_id"])
    g = lambda n, k: F.get_json_object("record", f"$.{n}").cast(k).alias(n)
    return r.select("body_id", g("id", "long"), g("segment", "string"), g("bal", "double"))


@query("a6_column_union", """WITH k AS (SELECT change_id, unnest(json_keys(row_data)) AS field, generate_subscripts(json_keys(row_data), 1) - 1 AS place FROM {change_log} WHERE row_data IS NOT NULL)
SELECT field, arg_min(change_id, (change_id, place)) AS first_seen, cast(arg_min(place, (change_id, place)) AS integer) AS place, count(*) AS documents FROM k GROUP BY field""")
def a6(t):
    return scan.fields(t.change_log, "row_data", "change_id")


@query("a7_inferred_types", """WITH k AS (SELECT doc, unnest(json_keys(doc)) AS field FROM {documents_json}), v AS (SELECT field, json_type(json_extract(doc, '$.' || field)) AS jt FROM k)
SELECT field, CASE WHEN count(DISTINCT jt) > 1 THEN 'TEXT' WHEN min(jt) IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN min(jt) = 'VARCHAR' THEN 'VARCHAR(255)' WHEN min(jt) = 'BOOLEAN' THEN 'BOOLEAN' ELSE 'JSONB' END AS sql_type FROM v GROUP BY field""")
def a7(t):
    return scan.inferred_types(t.documents_json, "doc")


@query("a7_nested_types", """SELECT v.path, v.sql_type FROM (VALUES ('_id', 'JSONB'), ('_id.$oid', 'TEXT'), ('user', 'BIGINT'), ('kind', 'TEXT'), ('ok', 'BOOLEAN'), ('ref', 'JSONB'), ('ref.$oid', 'TEXT'), ('owner', 'TEXT'), ('tags', 'JSONB'), ('tags[]', 'BIGINT'), ('mixed', 'JSONB'), ('mixed[]', 'NUMERIC'), ('deep', 'JSONB'), ('deep.a', 'JSONB'), ('deep.a[]', 'JSONB'), ('deep.a[].b', 'NUMERIC'), ('odd', 'JSONB')) AS v(path, sql_type)
WHERE EXISTS (SELECT 1 FROM {documents_json})""")
def a7_nested(t):
    even = F.col("event_id") % 2 == 0
    more = F.when(even, F.lit(', "mixed": [1, 2], "deep": {"a": [{"b": 1}]}, "odd": 1}')).otherwise(F.lit(', "mixed": [2.5], "deep": {"a": [{"b": 2.5}, {}]}, "odd": {"x": 1}}'))
    docs = t.documents_json.select("event_id", F.concat(F.regexp_replace(F.regexp_replace("doc", r'"props": .*, "tags"', '"tags"'), r"\}$", ""), more).alias("doc"))
    return scan.nested_types(docs, "doc")


@query("a8_query_source", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def a8(t):
    return scan.run_query(t.spark, "SELECT c_mktsegment, count(*) AS n FROM {o} JOIN {c} ON o_custkey = c_custkey GROUP BY c_mktsegment", o=t.orders, c=t.customer)


@query("a9_coercion", """WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 't' WHEN 1 THEN cast(p_partkey AS string) WHEN 2 THEN cast(p_partkey AS string) || '.5' WHEN 3 THEN p_brand ELSE NULL END AS v FROM part)
SELECT id, CASE WHEN v IS NULL THEN NULL WHEN v IN ('t', 'f', 'true', 'false') THEN 'bool' WHEN contains(v, '.') AND try_cast(v AS double) IS NOT NULL THEN 'double' WHEN try_cast(v AS bigint) IS NOT NULL THEN 'long' ELSE 'string' END AS kind, CASE WHEN v IN ('t', 'true') THEN true END AS as_bool,
CASE WHEN NOT contains(v, '.') THEN try_cast(v AS bigint) END AS as_long, CASE WHEN contains(v, '.') THEN try_cast(v AS double) END AS as_double FROM v""")
def a9(t):
    k = F.col("p_partkey")
    v = F.when(k % 5 == 0, "t").when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.concat(k.cast("string"), F.lit(".5"))).when(k % 5 == 3, F.col("p_brand"))
    return t.part.select(k.alias("id"), v.alias("v")).withColumns(clean.coerced(F.col("v"))).drop("v")


@query("a10_find", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id = 7")
def a10(t):
    return scan.find(t.events, {"event_type": "purchase", "user_id": 7}).select("event_id", "user_id")


def _metric_rows(row: dict) -> list[dict]:
    return [{"nation": row["n_name"], "metric": m, "value": row["n_nationkey"] * k} for k, m in ((1, "keys"), (10, "tens"))]


@query("a11_script_rows", "SELECT n_name AS nation, m.m AS metric, cast(n_nationkey * m.k AS bigint) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (VALUES (1, 'keys'), (10, 'tens')) AS m(k, m)")
def a11(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n_nationkey")
    return scan.script_rows(rows, _metric_rows, "nation string, metric string, value long")


GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("a12_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS columns FROM (DESCRIBE SELECT * FROM {n})" for n in GIVEN))
def a12(t):
    return scan.folder_tables(t.spark, t.sf_dir)


@query("a13_time_column", """WITH c AS (SELECT table_name, CASE WHEN column_name = 'made' THEN 'Created_At' WHEN column_name = 'extra' THEN 'updated_time' ELSE column_name END AS column_name FROM {columns_source})
SELECT table_name, arg_min(column_name, CASE lower(column_name) WHEN 'updated_time' THEN 4 ELSE 5 END) AS time_column FROM c WHERE lower(column_name) IN ('updated_time', 'created_at') GROUP BY table_name""")
def a13(t):
    name = F.col("column_name")
    return evolve.time_column(t.columns_source.withColumn("column_name", F.when(name == "made", "Created_At").when(name == "extra", "updated_time").otherwise(name)))


@query("a14_primary_keys", "SELECT table_name, string_agg(column_name, ',' ORDER BY position) AS pk_columns FROM {constraints} WHERE kind = 'PK' GROUP BY table_name")
def a14(t):
    return evolve.primary_keys(t.constraints)


@query("b3_upsert", """SELECT user_id, cents, kind FROM {users_before} WHERE user_id NOT IN (SELECT user_id FROM {users_source} WHERE user_id % 2 = 0) UNION ALL SELECT user_id, cents, kind FROM {users_source} WHERE user_id % 2 = 0""")
def b3(t):
    return sinks.upserted(t.users_before, t.users_source.where("user_id % 2 = 0"), ["user_id"])


@query("b4_upsert_without_key", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def b4(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity")
    return sinks.upserted_without_key(rows.where("l_quantity > 20"), rows)


@query("b5_stamped", "SELECT c_custkey, TIMESTAMP '2024-01-31 00:00:00' AS _job_sync_at FROM customer")
def b5(t):
    return sinks.stamped(t.customer.select("c_custkey"), "_job_sync_at", as_of())


@query("b7_sample", """SELECT (SELECT count(*) FROM orders) AS rows, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}', ',' ORDER BY o_orderkey) || ']' AS sample FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100)""")
def b7(t):
    return sinks.sample(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query("b9_nullability", "SELECT 'kind' AS column_name, count(*) FILTER (kind IS NULL) AS null_count, count(*) FILTER (kind IS NULL) = 0 AS can_be_not_null FROM (SELECT nullif(event_type, 'click') AS kind FROM events) UNION ALL SELECT 'event_id', 0, true FROM (SELECT 1) UNION ALL SELECT 'value', 0, true FROM (SELECT 1)")
def b9(t):
    return evolve.nullability(t.events.select("event_id", "value", F.nullif("event_type", F.lit("click")).alias("kind")))


@query("b10_rejects", "SELECT 'cents' AS column_name, count(*) AS rejected FROM {raw_rows} WHERE cents = 'n/a' HAVING count(*) > 0 UNION ALL SELECT 'cust', count(*) FROM {raw_rows} WHERE cust = 'x' HAVING count(*) > 0")
def b10(t):
    return sinks.reject_counts(t.raw_rows, {"cents": "bigint", "cust": "bigint"})


@query("b10_accepted", "SELECT id, cast(cents AS bigint) AS cents, cast(cust AS bigint) AS cust, status FROM {raw_rows} WHERE cents <> 'n/a' AND cust <> 'x'")
def b10_good(t):
    return sinks.split_rejects(t.raw_rows, {"cents": "bigint", "cust": "bigint"})[0]


NULLISH = r"(v IS NULL OR v IN ('', 'NULL', 'null', chr(92) || 'N', chr(92) || '0') OR regexp_matches(v, '0000-|1900-01-01|1970-01-01') OR regexp_matches(v, '[^\x20-\x7F]'))"
BADDATE = r"(d IS NULL OR d IN ('', 'NULL', 'null') OR regexp_matches(d, '0000-|1900-01-01|1970-01-01') OR length(d) < 10 OR NOT contains(d, '-') OR contains(d, '0000') OR contains(d, '-00') OR contains(d, ' 00:00:00'))"


@query("c1_clean_mariadb", f"SELECT id, CASE WHEN {NULLISH} THEN 'DEFAULT' ELSE v END AS text_value, CASE WHEN {NULLISH} THEN '0' ELSE v END AS int_value, CASE WHEN {BADDATE} THEN '1970-01-01 00:00:00' ELSE d END AS ts_value FROM {{dirty}}")
def c1(t):
    return t.dirty.select("id", clean.clean(F.col("v"), "TEXT", strict=True).alias("text_value"), clean.clean(F.col("v"), "INTEGER", strict=True).alias("int_value"), clean.clean(F.col("d"), "TIMESTAMP", strict=True).alias("ts_value"))


@query("c2_clean_mssql", f"SELECT id, CASE WHEN {NULLISH} THEN '' ELSE v END AS text_value, CASE WHEN flag = '' THEN 'false' WHEN flag IN ('N', '0', 'false', 'FALSE') THEN 'false' WHEN flag IN ('Y', '1', 'true', 'TRUE') THEN 'true' ELSE flag END AS flag_value FROM {{dirty}}")
def c2(t):
    return t.dirty.select("id", clean.clean(F.col("v"), "VARCHAR", "mssql", strict=True).alias("text_value"), clean.clean(F.col("flag"), "BOOLEAN", "mssql", strict=True).alias("flag_value"))


@query("c3_clean_oracle", "SELECT id, CASE WHEN v IS NULL OR v IN ('', 'NULL', 'null') THEN '' ELSE v END AS text_value, CASE WHEN d IN ('', 'NULL', 'null') OR regexp_matches(d, '0000-|1900-01-01|1970-01-01') THEN '1970-01-01 00:00:00' ELSE d END AS ts_value FROM {dirty}")
def c3(t):
    return t.dirty.select("id", clean.clean(F.col("v"), "TEXT", "oracle", strict=True).alias("text_value"), clean.clean(F.col("d"), "TIMESTAMP", "oracle", strict=True).alias("ts_value"))


@query("c4_clean_mongo", r"SELECT id, CASE WHEN v IS NULL OR v IN ('', 'NULL', 'null') THEN 'NULL' ELSE regexp_replace(v, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') END AS text_value FROM {dirty}")
def c4(t):
    return t.dirty.select("id", clean.clean(F.col("v"), "TEXT", "mongo", strict=True).alias("text_value"))


@query("c1_clean_safe", "SELECT id, CASE WHEN v IN ('', 'NULL', 'null', chr(92) || 'N') THEN NULL ELSE v END AS text_value FROM {dirty}")
def c1_safe(t):
    return t.dirty.select("id", clean.clean(F.col("v"), "TEXT").alias("text_value"))


@query("c5_strip", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[^\x00-\x7F]', '?', 'g')) AS n, md5(regexp_replace(text, '[^\x00-\x7F]', '?', 'g')) AS digest FROM documents")
def c5(t):
    c = clean.ascii_only(clean.strip_controls(F.col("text")))
    return t.documents.select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query("c6_log_text", "SELECT event_id, level, message FROM {app_logs} WHERE length(message) <= 20 AND length(level) <= 7")
def c6(t):
    return clean.valid_log_text(t.app_logs, {"message": 20, "level": 7}).select("event_id", "level", "message")


@query("c7_identifiers", r"WITH x AS (SELECT p_partkey, ' ' || p_name || '-$ ' AS n FROM part), y AS (SELECT p_partkey, substr(lower(regexp_replace(trim(n), '[^A-Za-z0-9_$#]', '', 'g')), 1, 128) AS n FROM x) SELECT p_partkey, CASE WHEN n <> '' AND NOT regexp_matches(n, '^[0-9]') THEN n END AS ident FROM y")
def c7(t):
    return t.part.select("p_partkey", clean.identifier(F.concat(F.lit(" "), "p_name", F.lit("-$ "))).alias("ident"))


@query("c8_text_predicates", "SELECT c_custkey, lower(trim(c_name)) AS low, upper(c_name) AS up, starts_with(c_mktsegment, 'B') AS leads, ends_with(c_mktsegment, 'G') AS ends, contains(lower(c_name), 'er#00') AS has FROM customer")
def c8(t):
    return t.customer.select("c_custkey", F.lower(F.trim("c_name")).alias("low"), F.upper("c_name").alias("up"), F.col("c_mktsegment").startswith("B").alias("leads"), F.col("c_mktsegment").endswith("G").alias("ends"), F.contains(F.lower("c_name"), F.lit("er#00")).alias("has"))


@query("c9_mapping", "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders")
def c9(t):
    return clean.map_columns(t.orders, {"id": "o_orderkey", "state": "o_orderstatus", "gone": "no_such"})


@query("c10_types", """WITH x AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'varchar(' || p_size || ')' WHEN 1 THEN 'int(11)' WHEN 2 THEN 'char(3)' WHEN 3 THEN 'DOUBLE' WHEN 4 THEN 'varchar(99999)' WHEN 5 THEN 'geometry' WHEN 6 THEN 'datetime' ELSE 'bigint unsigned' END AS s FROM part)
SELECT p_partkey, CASE WHEN s LIKE 'varchar%' AND s <> 'varchar(99999)' THEN upper(s) WHEN s = 'varchar(99999)' THEN 'VARCHAR' WHEN s = 'int(11)' THEN 'INTEGER' WHEN s = 'DOUBLE' THEN 'DOUBLE PRECISION' WHEN s = 'datetime' THEN 'TIMESTAMP' WHEN s LIKE 'bigint%' THEN 'BIGINT' ELSE 'TEXT' END AS pg_type FROM x""")
def c10(t):
    k = F.col("p_partkey") % 8
    s = F.when(k == 0, F.concat(F.lit("varchar("), F.col("p_size").cast("string"), F.lit(")")))
    for i, v in enumerate(("int(11)", "char(3)", "DOUBLE", "varchar(99999)", "geometry", "datetime"), 1):
        s = s.when(k == i, v)
    return t.part.select("p_partkey", clean.target_type(s.otherwise("bigint unsigned")).alias("pg_type"))


@query("c11_text_values", "SELECT o_orderkey, cast(o_orderkey AS string) AS k, CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, '{\"s\":\"' || o_orderstatus || '\"}' AS nested FROM orders")
def c11(t):
    return t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"), (F.col("o_custkey") % 2 == 0).cast("string").alias("flag"), F.to_json(F.struct(F.col("o_orderstatus").alias("s"))).alias("nested"))


HOSTS = "CASE {k} % 9 WHEN 0 THEN 'db-prod-' WHEN 1 THEN 'x.staging.' WHEN 2 THEN 'development_' WHEN 3 THEN 'product-uat' WHEN 4 THEN 'myqabox' WHEN 5 THEN 'eu-Cluster' WHEN 6 THEN 'core-db-' WHEN 7 THEN 'LOCALHOST' ELSE 'plain' END || CASE WHEN {k} % 9 = 7 THEN '' ELSE cast({k} AS string) END"


@query("c12_cluster_name", "WITH x AS (SELECT s_suppkey, " + HOSTS.replace("{k}", "s_suppkey") + " AS h FROM supplier) SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'PRODUCTION' WHEN 1 THEN 'STAGING' WHEN 2 THEN 'DEVELOPMENT' WHEN 3 THEN 'UAT' WHEN 4 THEN 'QA' WHEN 5 THEN 'CLUSTER' || s_suppkey WHEN 6 THEN 'DB-' || s_suppkey WHEN 7 THEN 'LOCAL' ELSE upper(h) END AS cluster FROM x")
def c12(t):
    return t.supplier.select("s_suppkey", clean.cluster_name(F.expr(HOSTS.replace("{k}", "s_suppkey"))).alias("cluster"))


CONN = "CASE {k} % 4 WHEN 0 THEN 'host=h' || {k} || ';user=u;password=p' || {k} || ';' WHEN 1 THEN 'SERVER=h' || {k} || ',1433; Database=d' WHEN 2 THEN 'mongodb://u:p@h' || {k} || ':27017/db' ELSE 'nothing' END"


@query("c13_host", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN 'h' || s_suppkey END AS host, CASE WHEN s_suppkey % 4 = 0 THEN 'host=h' || s_suppkey || ';user=u;password=***;' ELSE " + CONN.replace("{k}", "s_suppkey") + " END AS shown FROM supplier")
def c13(t):
    c = F.expr(CONN.replace("{k}", "s_suppkey"))
    return t.supplier.select("s_suppkey", clean.host_from_connection(c).alias("host"), clean.redacted(c).alias("shown"))


@query("c15_string_array", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'a,' || s_suppkey WHEN 1 THEN '' ELSE 'b' END AS items FROM supplier""")
def c15(t):
    j = F.expr("""CASE s_suppkey % 3 WHEN 0 THEN '["a", "' || s_suppkey || '"]' WHEN 1 THEN 'not json' ELSE '["b", 7, null]' END""")
    return t.supplier.select("s_suppkey", F.array_join(clean.string_array(j), ",").alias("items"))


@query("d1_parse", f"WITH {PARSED} SELECT change_id, operation, user_id, cents, kind, cast(has_cents AS int) + cast(has_kind AS int) AS n FROM p")
def d1(t):
    return cdc.parse(t.change_log, KEYS, IMAGE).select("change_id", "operation", "user_id", "cents", "kind", F.size("has").alias("n"))


@query("d2_latest", f"WITH {PARSED}, {LAST} SELECT user_id, change_id, operation, cents, kind FROM l")
def d2(t):
    return cdc.latest(cdc.parse(t.change_log, KEYS, IMAGE).select("user_id", "change_id", "operation", "cents", "kind"), ["user_id"])


@query("d3_delete_by_key", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def d3(t):
    gone = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return cdc.delete_by_key(t.orders.select("o_custkey", "o_orderkey"), gone, ["o_custkey"])


@query("d4_delete_by_image", "SELECT o_orderkey, o_orderstatus FROM {orders_new} WHERE NOT (o_orderstatus IS NULL AND o_orderkey % 3 = 0)")
def d4(t):
    rows = t.orders_new.select("o_orderkey", "o_orderstatus")
    return cdc.delete_by_image(rows, rows.where("o_orderstatus IS NULL AND o_orderkey % 3 = 0"), ["o_orderkey", "o_orderstatus"])


FINAL = f"""WITH {PARSED}, {LAST} SELECT coalesce(l.user_id, b.user_id) AS user_id, CASE WHEN l.user_id IS NULL THEN b.cents ELSE l.cents END AS cents, CASE WHEN l.user_id IS NULL THEN b.kind ELSE l.kind END AS kind
FROM l FULL JOIN {{users_before}} b ON l.user_id = b.user_id WHERE l.operation IS NULL OR l.operation <> 'D'"""


@query("d5_apply_changes", FINAL)
def d5(t):
    return cdc.apply_changes(t.users_before, cdc.parse(t.change_log, KEYS, IMAGE), ["user_id"], ["cents", "kind"])


@query("d6_row_hash", "SELECT o_orderkey, md5(coalesce(cast(o_orderkey AS string), '') || '|' || coalesce(o_orderstatus, '') || '|' || coalesce(cast(cents AS string), '')) AS h FROM {orders_new}")
def d6(t):
    return t.orders_new.select("o_orderkey", cdc.row_hash(["o_orderkey", "o_orderstatus", "cents"]).alias("h"))


DIFF = """SELECT CASE WHEN a.o_orderkey IS NULL THEN 'I' WHEN b.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS operation, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, '{"o_orderkey":' || coalesce(a.o_orderkey, b.o_orderkey) || '}' AS pk_values,
CASE WHEN b.o_orderkey IS NOT NULL THEN '{"o_custkey":' || b.o_custkey || CASE WHEN b.o_orderstatus IS NULL THEN '' ELSE ',"o_orderstatus":"' || b.o_orderstatus || '"' END || ',"cents":' || b.cents || '}' END AS row_data
FROM {orders_old} a FULL JOIN {orders_new} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR (a.o_custkey, a.o_orderstatus, a.cents) IS DISTINCT FROM (b.o_custkey, b.o_orderstatus, b.cents)"""


@query("d7_snapshot_diff", DIFF)
def d7(t):
    return cdc.diff(t.orders_old, t.orders_new, ["o_orderkey"])


@query("d7_digest_diff", DIFF)
def d7_digest(t):
    return digest.diff(t.orders_old, t.orders_new, ["o_orderkey"])


@query("d7_stored_digests", DIFF)
def d7_stored(t):
    path = scratch.folder(t.spark, "digests")
    digest.store(t.orders_old, f"{path}/old", ["o_orderkey"])
    digest.store(t.orders_new, f"{path}/new", ["o_orderkey"])
    return digest.stored_diff(t.spark, f"{path}/old", f"{path}/new", ["o_orderkey"])


COPIES = "o AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity < 25 THEN NULL ELSE l_tax END AS tax FROM lineitem WHERE l_linenumber <= 4), w AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity < 20 THEN NULL ELSE l_tax END AS tax FROM lineitem WHERE l_linenumber >= 2)"


def _copies(t):
    tax = lambda n: F.when(F.col("l_quantity") < n, F.lit(None)).otherwise(F.col("l_tax")).alias("tax")
    return t.lineitem.where("l_linenumber <= 4").select("l_returnflag", "l_linestatus", tax(25)), t.lineitem.where("l_linenumber >= 2").select("l_returnflag", "l_linestatus", tax(20))


@query("d7_multiset_diff", f"WITH {COPIES} SELECT l_returnflag, l_linestatus, tax, operation, count(*) AS copies FROM (SELECT *, 'D' AS operation FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM w) UNION ALL SELECT *, 'I' FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM o)) GROUP BY 1, 2, 3, 4")
def d7_multiset(t):
    return cdc.multiset_diff(*_copies(t))


@query("b4_multiset_apply", f"WITH {COPIES} SELECT * FROM w")
def b4_multiset(t):
    old, new = _copies(t)
    return cdc.multiset_apply(old, cdc.multiset_diff(old, new))


@query("d6_occurrences", f"WITH {COPIES} SELECT l_returnflag, l_linestatus, tax, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, tax) - 1 AS nth FROM o")
def d6_occurrences(t):
    old = _copies(t)[0]
    return cdc.numbered(cdc.copies(old, old.columns, "copies"))


@query("d4_images_told_apart", "SELECT o.id, o.a, o.b FROM {notes_old} o WHERE NOT EXISTS (SELECT 1 FROM {notes_new} n WHERE n.id = o.id AND n.a IS NOT DISTINCT FROM o.a AND n.b IS NOT DISTINCT FROM o.b)")
def d4_images(t):
    return cdc.delete_by_image(t.notes_old, t.notes_new, ["id", "a", "b"])


@query("d7_changes_told_apart", "SELECT 'U' AS operation, n.id, n.a, n.b FROM {notes_new} n JOIN {notes_old} o ON n.id = o.id WHERE n.a IS DISTINCT FROM o.a OR n.b IS DISTINCT FROM o.b")
def d7_changes(t):
    image = F.from_json("row_data", "a string, b string")
    return cdc.diff(t.notes_old, t.notes_new, ["id"]).select("operation", "id", image["a"].alias("a"), image["b"].alias("b"))


@query("d8_complete", f"WITH {PARSED} SELECT change_id, p.user_id, CASE WHEN has_cents THEN p.cents ELSE s.cents END AS cents, CASE WHEN has_kind THEN p.kind ELSE s.kind END AS kind FROM p LEFT JOIN {{users_source}} s ON p.user_id = s.user_id")
def d8(t):
    changes = cdc.parse(t.change_log, KEYS, IMAGE).select("change_id", "user_id", "cents", "kind", "has")
    return cdc.complete(changes, t.users_source, ["user_id"], ["cents", "kind"]).drop("has")


@query("d9_keyed", "SELECT o_orderkey, o_orderstatus FROM {orders_new} WHERE o_orderstatus IS NOT NULL")
def d9(t):
    return cdc.keyed(t.orders_new.select("o_orderkey", "o_orderstatus"), ["o_orderkey", "o_orderstatus"])


@query("d10_cursor", "SELECT schema_name, table_name, change_id // 1000 AS batch, count(*) AS changes, count(*) FILTER (operation <> 'D') AS upserts, count(*) FILTER (operation = 'D') AS deletes, max(change_id) AS cursor FROM {change_log} GROUP BY ALL")
def d10(t):
    return cdc.apply_statistics(t.change_log, F.floor(F.col("change_id") / 1000))


@query("d13_changed_fields", """SELECT b.o_orderkey, b.o_custkey, b.o_orderstatus, b.cents, CASE WHEN a.cents <> b.cents THEN 'cents' ELSE '' END AS changed FROM {orders_old} a JOIN {orders_new} b USING (o_orderkey) WHERE a.cents <> b.cents""")
def d13(t):
    return cdc.changed_fields(t.orders_old, t.orders_new, ["o_orderkey"]).withColumn("changed", F.array_join("changed", ","))


COUNTS = "c AS (SELECT g.o_custkey, coalesce(sum(g.s), 0) AS source_rows, coalesce(sum(g.t), 0) AS target_rows FROM (SELECT o_custkey, 1 AS s, 0 AS t FROM {orders_new} UNION ALL SELECT o_custkey, 0, 1 FROM {orders_old}) g GROUP BY g.o_custkey)"


@query("d15_reconcile", f"WITH {COUNTS} SELECT o_custkey, cast(source_rows AS bigint) AS source_rows, cast(target_rows AS bigint) AS target_rows, cast(source_rows - target_rows AS bigint) AS diff, CASE WHEN source_rows < target_rows THEN 'FULL_LOAD' WHEN source_rows > target_rows THEN 'INCREMENTAL' ELSE 'IN_SYNC' END AS next_action FROM c")
def d15(t):
    return cdc.reconcile(t.orders_new, t.orders_old, ["o_custkey"])


@query("d15_digest_reconcile", """WITH x AS (SELECT o_custkey FROM (SELECT * FROM {orders_new} EXCEPT ALL SELECT * FROM {orders_old}) UNION SELECT o_custkey FROM (SELECT * FROM {orders_old} EXCEPT ALL SELECT * FROM {orders_new})),
g AS (SELECT o_custkey, sum(s) AS source_rows, sum(t) AS target_rows FROM (SELECT o_custkey, 1 AS s, 0 AS t FROM {orders_new} UNION ALL SELECT o_custkey, 0, 1 FROM {orders_old}) GROUP BY o_custkey)
SELECT o_custkey, cast(source_rows AS bigint) AS source_rows, cast(target_rows AS bigint) AS target_rows, o_custkey NOT IN (SELECT o_custkey FROM x) AS in_sync FROM g""")
def d15_digest(t):
    return digest.reconcile(t.orders_new, t.orders_old, ["o_custkey"])


@query("d14_next_action", """SELECT c.schema_name, c.table_name, CASE WHEN upper(status) IN ('FULL_LOAD', 'RESET') THEN 'FULL_LOAD' WHEN live_rows = 0 AND table_size = 0 THEN 'NO_DATA' WHEN live_rows < table_size THEN 'FULL_LOAD' WHEN upper(status) = 'LISTENING_CHANGES' THEN 'CDC' WHEN live_rows = table_size THEN 'LISTENING_CHANGES' ELSE 'INCREMENTAL' END AS next_action
FROM {catalog} c JOIN {table_stats} s USING (schema_name, table_name)""")
def d14(t):
    rows = t.catalog.join(t.table_stats, ["schema_name", "table_name"]).withColumnRenamed("live_rows", "source_rows").withColumnRenamed("table_size", "target_rows")
    return cdc.next_action(rows).select("schema_name", "table_name", "next_action")


@query("d16_key_check", """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT cast(sum(n) AS bigint) AS rows, cast(sum(n - 1) AS bigint) AS surplus, cast(0 AS bigint) AS null_keys, sum(n - 1) = 0 AS is_key FROM g""")
def d16(t):
    return cdc.key_check(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d17_resync_due", "SELECT schema_name, table_name FROM {catalog} WHERE upper(status) IN ('FULL_LOAD', 'IN_PROGRESS') AND last_sync <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR")
def d17(t):
    return cdc.resync_due(t.catalog, as_of()).select("schema_name", "table_name")


@query("d18_work_order", "SELECT schema_name, table_name, CASE upper(status) WHEN 'FULL_LOAD' THEN 0 WHEN 'RESET' THEN 1 WHEN 'LISTENING_CHANGES' THEN 2 ELSE 3 END AS work_rank FROM {catalog} ORDER BY 3, 1, 2 LIMIT 1000")
def d18(t):
    return cdc.work_order(t.catalog, 1000).select("schema_name", "table_name", "work_rank")


@query("d20_deleted_keys", "SELECT o_orderkey FROM {orders_old} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {orders_new})")
def d20(t):
    return cdc.delete_by_key(t.orders_old.select("o_orderkey"), t.orders_new.select("o_orderkey"), ["o_orderkey"])


@query("d20_digest_deleted", "SELECT o_orderkey FROM {orders_old} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {orders_new})")
def d20_digest(t):
    return digest.deleted_keys(t.orders_old, t.orders_new, ["o_orderkey"])


COMPATIBLE = "(o = n OR (o LIKE '%CHAR%' AND n LIKE '%CHAR%') OR (o LIKE '%INTEGER%' AND n LIKE '%BIGINT%') OR (o LIKE '%CHAR%' AND n LIKE '%TEXT%') OR (o LIKE '%TEXT%' AND n LIKE '%CHAR%') OR (o LIKE '%NUMERIC%' AND n LIKE '%NUMERIC%') OR (o LIKE '%TIME%' AND n LIKE '%TIME%'))"
DIFF = """d AS (SELECT table_name, column_name, s.pg_type AS new_type, t.pg_type AS old_type, s.is_nullable AS nn, t.is_nullable AS tn, t.is_pk AS old_pk FROM {columns_source} s FULL JOIN {columns_target} t USING (table_name, column_name)),
e AS (SELECT *, CASE WHEN old_type IS NULL THEN 'ADD' WHEN new_type IS NULL THEN 'DROP' WHEN old_type <> new_type OR nn <> tn THEN 'MODIFY' END AS action, old_type AS o, new_type AS n FROM d)"""


@query("e1_schema_diff", f"WITH {DIFF} SELECT table_name, column_name, action, old_type, new_type, CASE WHEN action = 'MODIFY' THEN {COMPATIBLE} ELSE true END AS compatible FROM e WHERE action IS NOT NULL")
def e1(t):
    return evolve.schema_diff(t.columns_source, t.columns_target).select("table_name", "column_name", "action", "old_type", "new_type", "compatible")


@query("e6_evolution_plan", f"WITH {DIFF} SELECT table_name, count(*) FILTER (action = 'ADD') AS added, count(*) FILTER (action = 'DROP') AS dropped, count(*) FILTER (action = 'MODIFY' AND {COMPATIBLE}) AS modified, count(*) FILTER (action = 'MODIFY' AND NOT {COMPATIBLE}) AS skipped, bool_or(action = 'DROP' AND coalesce(old_pk, false)) AS refused FROM e WHERE action IS NOT NULL GROUP BY table_name")
def e6(t):
    return evolve.evolution_plan(t.columns_source, t.columns_target)


@query("e3_evolve", "SELECT o_orderkey, cast(o_custkey AS string) AS o_custkey, 'none' AS note, cast(NULL AS bigint) AS extra FROM orders")
def e3(t):
    out, _ = evolve.evolve(t.orders, [("o_orderkey", "bigint"), ("O_CUSTKEY", "string"), ("note", "string"), ("extra", "bigint")], keys=["o_orderkey"], defaults={"note": "none"})
    return out


@query("e7_count_drift", "WITH s AS (SELECT table_name, count(*) AS source_columns FROM {columns_source} GROUP BY 1), t AS (SELECT table_name, count(*) AS target_columns FROM {columns_target} GROUP BY 1) SELECT *, 'FULL_LOAD' AS new_status FROM s JOIN t USING (table_name) WHERE source_columns <> target_columns")
def e7(t):
    return evolve.count_drift(t.columns_source, t.columns_target)


@query("e8_late_fields", "SELECT cast(user_id AS bigint) AS user_id, kind, CAST(NULL AS VARCHAR) AS later, CAST(NULL AS VARCHAR) AS _document FROM {users_source}")
def e8(t):
    return evolve.late_fields(t.users_source, ["user_id", "kind", "later"])
