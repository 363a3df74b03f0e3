"""Inputs that the given tables do not hold, derived from them in SQL that Spark and DuckDB both run.

A fixture is a SELECT; {name} stands for a given table or another fixture. Timestamps are without zone.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

FIXTURES = {
    # A change log keyed by user: signups insert, errors delete, all else updates. Every seventh image lacks a key.
    "change_log": """SELECT event_id AS change_id, ts AS change_time, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS operation,
        'app' AS schema_name, 'users' AS table_name, '{"user_id": ' || cast(user_id AS string) || '}' AS pk_values,
        CASE WHEN event_type = 'error' THEN NULL
             WHEN event_id % 7 = 0 THEN '{"cents": ' || cast(cast(round(value * 100) AS bigint) AS string) || '}'
             WHEN event_id % 11 = 0 THEN '{"cents": null, "kind": "' || event_type || '"}'
             ELSE '{"cents": ' || cast(cast(round(value * 100) AS bigint) AS string) || ', "kind": "' || event_type || '"}' END AS row_data
        FROM {events}""",
    # The target as it was before the log: every third user.
    "users_before": """SELECT DISTINCT user_id, user_id * 10 AS cents, 'old' AS kind FROM {events} WHERE user_id % 3 = 0""",
    # The source table's present rows, for images that lack a key.
    "users_source": """SELECT user_id, max(cast(round(value * 100) AS bigint)) AS cents, 'source' AS kind FROM {events} GROUP BY user_id""",
    "orders_old": """SELECT o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) AS bigint) AS cents FROM {orders}""",
    "orders_new": """SELECT o_orderkey, o_custkey, o_orderstatus, cents + CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END AS cents FROM {orders_old} WHERE o_orderkey % 11 <> 0
        UNION ALL SELECT o_orderkey + 100000000, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'N' END, cents FROM {orders_old} WHERE o_orderkey % 13 = 0""",
    "dirty": """SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN '' WHEN 1 THEN 'NULL' WHEN 2 THEN 'null' WHEN 3 THEN chr(92) || 'N' WHEN 4 THEN '0000-00-00' WHEN 5 THEN '1900-01-01'
        WHEN 6 THEN 'caf' || chr(233) WHEN 7 THEN 'a' || chr(7) || 'b' WHEN 8 THEN 'a' || chr(9) || 'b' WHEN 9 THEN c_mktsegment WHEN 10 THEN NULL ELSE cast(c_custkey AS string) END AS v,
        CASE c_custkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN '0' WHEN 2 THEN 'TRUE' WHEN 3 THEN '' ELSE 'maybe' END AS flag,
        CASE c_custkey % 7 WHEN 0 THEN '2024-01-05 10:00:00' WHEN 1 THEN '2024-01-05 00:00:00' WHEN 2 THEN '2024-00-05 10:00:00' WHEN 3 THEN 'soon' WHEN 4 THEN '1970-01-01 00:00:01' WHEN 5 THEN '' ELSE '2023-12-31' END AS d
        FROM {customer}""",
    "raw_rows": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE cast(cast(round(o_totalprice * 100) AS bigint) AS string) END AS cents,
        CASE WHEN o_orderkey % 14 = 0 THEN 'x' ELSE cast(o_custkey AS string) END AS cust, o_orderstatus AS status FROM {orders}""",
    # Column lists of many tables, before and after a change.
    "columns_target": """SELECT 't' || cast(p_partkey AS string) AS table_name, c.column_name, c.pg_type, c.is_nullable, c.is_pk FROM {part}
        CROSS JOIN (VALUES ('id', 'INTEGER', false, true), ('name', 'VARCHAR', true, false), ('amount', 'NUMERIC', true, false), ('old_note', 'TEXT', true, false), ('made', 'TIMESTAMP', true, false)) AS c(column_name, pg_type, is_nullable, is_pk)""",
    "columns_source": """SELECT 't' || cast(p_partkey AS string) AS table_name, c.column_name, CASE WHEN c.column_name = 'amount' AND p_partkey % 3 = 0 THEN 'BOOLEAN' WHEN c.column_name = 'id' AND p_partkey % 2 = 0 THEN 'BIGINT' ELSE c.pg_type END AS pg_type,
        CASE WHEN c.column_name = 'name' AND p_partkey % 5 = 0 THEN false ELSE c.is_nullable END AS is_nullable, c.is_pk FROM {part}
        CROSS JOIN (VALUES ('id', 'INTEGER', false, true), ('name', 'TEXT', true, false), ('amount', 'NUMERIC', true, false), ('extra', 'JSONB', true, false), ('made', 'TIMESTAMP', true, false)) AS c(column_name, pg_type, is_nullable, is_pk)
        WHERE NOT (c.column_name = 'id' AND p_partkey % 17 = 0)""",
    "constraints": """SELECT 't' || cast(p_partkey AS string) AS table_name, k.column_name, k.kind, k.position, CASE WHEN k.kind = 'FK' THEN 't' || cast(p_partkey % 10 AS string) END AS ref_table, CASE WHEN k.kind = 'FK' THEN 'id' END AS ref_column, k.kind || '_' || cast(p_partkey AS string) AS constraint_name FROM {part}
        CROSS JOIN (VALUES ('id', 'PK', 2), ('name', 'PK', 1), ('amount', 'FK', 1), ('made', 'UQ', 1)) AS k(column_name, kind, position)""",
    "documents_json": """SELECT event_id, '{"_id": {"$oid": "' || substr(md5(cast(event_id AS string)), 1, 24) || '"}, "user": ' || cast(user_id AS string) || ', "kind": "' || event_type || '", "ok": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ||
        CASE WHEN event_id % 3 = 0 THEN ', "ref": {"$oid": "' || substr(md5(cast(user_id AS string)), 1, 24) || '"}' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN ', "owner": "' || substr(md5(event_type), 1, 24) || '"' ELSE '' END ||
        ', "props": ' || props || ', "tags": [1, 2]}' AS doc FROM {events}""",
    "bodies": """SELECT c_nationkey AS body_id, CASE c_nationkey % 4 WHEN 0 THEN '[' || items || ']' WHEN 1 THEN '{"data": [' || items || ']}' WHEN 2 THEN '{"results": [' || items || '], "page": 1}' ELSE '{"id": ' || cast(c_nationkey AS string) || ', "segment": "single"}' END AS body
        FROM (SELECT c_nationkey, string_agg('{"id": ' || cast(c_custkey AS string) || ', "segment": "' || c_mktsegment || '"' || CASE WHEN c_custkey % 3 = 0 THEN ', "bal": ' || cast(cast(c_custkey AS double) / 2 + 0.25 AS string) ELSE '' END || '}', ',') AS items FROM {customer} GROUP BY c_nationkey) AS g""",
    # Versions of a table whose images differ only in nulls, empty texts and bars.
    "notes_old": """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'x|' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'x' END AS a, CASE c_custkey % 3 WHEN 0 THEN 'y' WHEN 1 THEN '' ELSE NULL END AS b FROM {customer}""",
    "notes_new": """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'x|' END WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'x' END AS a, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 4 = 0 THEN '|y' ELSE 'y' END WHEN 1 THEN '' ELSE NULL END AS b FROM {customer}""",
    # Personal data side by side, with one character between.
    "contacts": """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '12345 67890 12345' WHEN 1 THEN '123-45-6789 123456789 123-456789' WHEN 2 THEN '10.0.0.1 10.0.0.2 10.0.0.3' WHEN 3 THEN 'a.b@c.org;d@e.com9@f.net g@@h.de'
        WHEN 4 THEN '1234-5678-1234-5678 1234 5678 1234 5678 1234567812345678' WHEN 5 THEN '90210-1234 90210-12345 x90210 90210y 90210' WHEN 6 THEN '1.2.3.4.5.6.7.8.9' ELSE 'none ' || cast(c_custkey AS string) END AS note FROM {customer}""",
    # Governance rows: one table a part.
    "gov": """SELECT 's' || cast(p_partkey % 7 AS string) AS schema_name, 't' || cast(p_partkey AS string) AS table_name, CASE p_partkey % 4 WHEN 0 THEN 'MariaDB' WHEN 1 THEN 'MSSQL' WHEN 2 THEN 'PostgreSQL' ELSE 'MongoDB' END AS db_engine,
        cast(p_partkey * 37 % 1000 AS double) / 10 AS null_percentage, cast(p_partkey * 53 % 700 AS double) / 10 AS duplicate_percentage, cast(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_partkey * 71 % 1000 END AS double) / 10 AS fragmentation_percentage,
        cast(p_partkey * 29 % 1001 AS double) / 10 AS data_quality_score, p_partkey * 7919 % 20000 - 10 AS query_count,
        CASE p_partkey % 5 WHEN 0 THEN 'TRANSACTIONAL' WHEN 1 THEN 'ANALYTICAL' WHEN 2 THEN 'MASTER_DATA' WHEN 3 THEN 'SPORTS' ELSE 'REFERENCE' END AS data_category,
        CASE p_partkey % 4 WHEN 0 THEN 'HEALTHCARE' WHEN 1 THEN 'FINANCE' WHEN 2 THEN 'SPORTS' ELSE 'GENERAL' END AS business_domain,
        CASE p_partkey % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'PUBLIC' END AS sensitivity_level,
        CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 8 = 1 THEN '' ELSE 'GDPR' END AS compliance_requirements,
        cast(p_partkey % 6 AS int) AS sensitive_data_count, p_partkey % 2 = 0 AS encryption_at_rest, p_partkey % 3 = 0 AS masking_policy_applied, p_partkey % 4 = 0 AS retention_enforced, p_partkey % 9 = 0 AS legal_hold,
        CASE WHEN p_partkey % 18 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS legal_hold_until, CASE p_partkey % 6 WHEN 0 THEN '7_YEARS' WHEN 1 THEN '5_YEARS' WHEN 2 THEN '3_YEARS' WHEN 3 THEN '2_YEARS' WHEN 4 THEN 'ARCHIVE_1_YEAR' ELSE 'NONE' END AS retention_policy,
        TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * cast(p_partkey % 60 AS int) AS last_analyzed, CASE WHEN p_partkey % 10 <> 0 THEN TIMESTAMP '2024-02-10 00:00:00' - INTERVAL '1' DAY * cast(p_partkey % 30 AS int) END AS data_expiration_date,
        p_partkey % 2 = 1 AS schema_evolution_tracking, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * cast(p_partkey % 48 AS int) AS last_schema_change, CASE WHEN p_partkey % 5 <> 0 THEN cast(p_partkey % 50 AS int) END AS freshness_hours
        FROM {part}""",
    "object_stats": """SELECT 'o' || cast(p_partkey AS string) AS object_name, CASE p_partkey % 4 WHEN 0 THEN 'INDEX' WHEN 1 THEN 'DATABASE' WHEN 2 THEN 'STORED_PROCEDURE' ELSE 'TABLE' END AS object_type, cast(p_partkey * 71 % 1200 AS double) / 10 AS fragmentation_pct,
        p_partkey % 3 = 0 AS is_unused, p_partkey % 5 < 2 AS has_missing_index, cast(p_partkey * 13 % 100 AS double) AS missing_index_impact, CASE WHEN p_partkey % 7 <> 0 THEN TIMESTAMP '2024-01-30 00:00:00' END AS last_full_backup, cast(p_partkey % 11 AS double) AS avg_seconds,
        cast(p_partkey * 3 % 500 AS double) AS data_size_mb, cast(p_partkey * 7 % 400 AS double) AS data_free_mb, p_partkey % 13 - 10 AS user_expired_count, p_partkey % 4 AS user_locked_count, p_partkey % 30 AS user_total,
        p_partkey % 3 AS index_count, p_partkey * 97 % 20000 AS document_count, p_partkey * 11 % 12000 AS total_size_mb, p_partkey * 7907 % 2000000 AS avg_object_size_bytes,
        p_partkey * 17 % 300 AS chain_cnt, p_partkey * 31 % 2000 AS num_rows, p_partkey % 100 AS blocks, p_partkey * 3 % 40 AS empty_blocks, CASE WHEN p_partkey % 6 = 0 THEN 'NO' ELSE 'YES' END AS logging FROM {part}""",
    "catalog": """SELECT schema_name, table_name, db_engine, CASE WHEN cast(substr(table_name, 2) AS bigint) % 19 = 0 THEN '' ELSE 'host=db;port=1' END AS connection_string,
        CASE cast(substr(table_name, 2) AS bigint) % 8 WHEN 0 THEN 'full_load' WHEN 1 THEN 'LISTENING_CHANGES' WHEN 2 THEN 'NO_DATA' WHEN 3 THEN 'SKIPPED' WHEN 4 THEN 'PENDING' WHEN 5 THEN 'ERROR' WHEN 6 THEN 'RESET' ELSE 'IN_PROGRESS' END AS status,
        cast(substr(table_name, 2) AS bigint) % 3 <> 0 AS active, CASE WHEN cast(substr(table_name, 2) AS bigint) % 4 = 0 THEN '["id","name"]' ELSE '["id"]' END AS pk_columns, CASE WHEN cast(substr(table_name, 2) AS bigint) % 4 = 0 THEN 'COMPOSITE' ELSE 'PK' END AS pk_strategy,
        cast(substr(table_name, 2) AS bigint) * 10 AS table_size, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * cast(cast(substr(table_name, 2) AS bigint) % 60 AS int) AS last_sync FROM {gov} WHERE cast(substr(table_name, 2) AS bigint) % 10 <> 9""",
    "discovered": """SELECT schema_name, table_name, db_engine, CASE WHEN cast(substr(table_name, 2) AS bigint) % 5 = 0 THEN '["id"]' WHEN cast(substr(table_name, 2) AS bigint) % 4 = 0 THEN '["id","name"]' ELSE '["id"]' END AS pk_columns, CASE WHEN cast(substr(table_name, 2) AS bigint) % 4 = 0 THEN 'COMPOSITE' ELSE 'PK' END AS pk_strategy,
        cast(substr(table_name, 2) AS bigint) % 900 AS table_size FROM {gov} WHERE cast(substr(table_name, 2) AS bigint) % 12 <> 0""",
    "quality_log": """SELECT 's' || cast(l_suppkey % 7 AS string) AS schema_name, 't' || cast(l_suppkey AS string) AS table_name, l_orderkey * 10 + l_linenumber AS check_id, l_shipdate AS check_timestamp, cast(l_quantity * 2 AS bigint) AS quality_score FROM {lineitem}""",
    "transfers": """SELECT event_id, 's' || cast(user_id % 3 AS string) AS schema_name, 't' || cast(user_id AS string) AS table_name, CASE user_id % 3 WHEN 0 THEN 'MariaDB' WHEN 1 THEN 'MSSQL' ELSE 'MongoDB' END AS db_engine, event_id % 5000 AS records_transferred, event_id % 977 * 1000 AS bytes_transferred,
        event_id % 101 AS memory_used_mb, event_id % 307 AS io_operations, CASE event_id % 4 WHEN 0 THEN 'FULL_LOAD' WHEN 1 THEN 'INCREMENTAL' ELSE 'SYNC' END AS transfer_type, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_id % 17 = 0 THEN 'PENDING' ELSE 'SUCCESS' END AS status,
        ts - INTERVAL '1' MINUTE * cast(event_id % 90 AS int) AS started_at, CASE WHEN event_id % 17 <> 0 THEN ts END AS completed_at FROM {events}""",
    "query_stats": """SELECT event_id AS queryid, 'u' || cast(user_id % 20 AS string) AS username, CASE event_id % 9 WHEN 0 THEN 'SELECT count(*) FROM orders WHERE o_custkey = ' || cast(user_id AS string) WHEN 1 THEN 'select o.id, c.name from orders o JOIN customer c on o.c = c.id where c.name = ''' || event_type || ''''
        WHEN 2 THEN 'INSERT INTO sales.orders VALUES (' || cast(event_id AS string) || ', ''x'')' WHEN 3 THEN 'update part set p = (select max(q) from lineitem) where id = 7' WHEN 4 THEN 'WITH a AS (SELECT 1 FROM t) SELECT row_number() over (order by x) FROM a' WHEN 5 THEN 'DELETE  FROM events WHERE id < 10'
        WHEN 6 THEN 'CREATE TABLE z AS SELECT avg(v) FROM app.events INNER JOIN users u ON 1 = 1' WHEN 7 THEN 'drop table old_' || cast(user_id AS string) ELSE 'VACUUM' END AS query,
        event_id % 50 AS calls, cast(event_id * 31 % 90000 AS double) / 10 AS total_time_ms, cast(event_id * 17 % 70000 AS double) / 10 AS mean_time_ms, event_id * 7 % 5000 AS blks_hit, event_id * 3 % 4000 AS blks_read, event_id % 100 AS blks_written, event_id % 10 AS temp_read, event_id % 7 AS temp_written FROM {events}""",
    "activity": """SELECT event_id AS pid, 'u' || cast(user_id AS string) AS username, CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'idle' WHEN 2 THEN 'idle in transaction' ELSE 'disabled' END AS state, CASE event_id % 5 WHEN 0 THEN 'Lock' WHEN 1 THEN 'ClientRead' WHEN 2 THEN '' END AS wait_event_type,
        ts AS query_start, ts + INTERVAL '1' SECOND * cast(event_id % 100 AS int) AS seen_at FROM {events}""",
    "access_log": """SELECT event_id, 'u' || cast(user_id AS string) AS username, 's' || cast(event_id % 7 AS string) AS schema_name, 't' || cast(event_id % 180 AS string) AS table_name, CASE event_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'amount' ELSE 'phone' END AS column_name, event_type AS access_type, event_id % 3 <> 1 AS is_sensitive_data, ts AS access_timestamp FROM {events}""",
    "log_lines": """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '[' || cast(ts AS string) || '] [' || CASE WHEN event_id % 4 = 0 THEN 'ERROR' ELSE 'INFO' END || '] [fn' || cast(user_id % 13 AS string) || '] old ' || event_type WHEN event_id % 23 = 0 THEN 'garbage line'
        ELSE '[' || cast(ts AS string) || '] [' || CASE event_id % 5 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR' ELSE 'CRITICAL' END || '] [' || CASE event_id % 3 WHEN 0 THEN 'TRANSFER' WHEN 1 THEN 'DATABASE' ELSE 'GOVERNANCE' END || '] [fn' || cast(user_id % 13 AS string) || '] user ' || cast(user_id AS string) || ' did ' || event_type END AS line FROM {events}""",
    "app_logs": """SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR' ELSE 'CRITICAL' END AS level, CASE event_id % 3 WHEN 0 THEN 'TRANSFER' WHEN 1 THEN 'DATABASE' ELSE 'GOVERNANCE' END AS category, 'fn' || cast(user_id % 13 AS string) AS function, 'user ' || cast(user_id AS string) || ' did ' || event_type AS message FROM {events}""",
    "definitions": """SELECT o_orderkey AS def_id, 's' || cast(o_custkey % 5 AS string) AS schema_name, 'obj' || cast(o_orderkey AS string) AS object_name, CASE o_orderkey % 3 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'PROCEDURE' ELSE 'TRIGGER' END AS object_type,
        CASE o_orderkey % 4 WHEN 0 THEN 'SELECT * FROM sales.orders o JOIN customer c ON o.k = c.k' WHEN 1 THEN 'BEGIN INSERT INTO audit.log_' || cast(o_custkey % 9 AS string) || ' SELECT 1; UPDATE part SET x = 1; END' WHEN 2 THEN 'select a from lineitem, part left join t' || cast(o_custkey % 50 AS string) || ' on true' ELSE 'SELECT 1' END AS text FROM {orders}""",
    # SQL in which strings, comments, quoted names, common table expressions and lists stand where tables could.
    "definitions_odd": """SELECT o_orderkey AS def_id, 's' || cast(o_custkey % 5 AS string) AS schema_name, 'obj' || cast(o_orderkey AS string) AS object_name, CASE o_orderkey % 3 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'PROCEDURE' ELSE 'TRIGGER' END AS object_type,
        o_orderkey % 8 AS kind, o_custkey % 9 AS n, CASE o_orderkey % 8 WHEN 0 THEN 'SELECT ''-- FROM no1'' AS a FROM Sales.Orders /* JOIN no2 */ o' WHEN 1 THEN 'WITH c AS (SELECT * FROM part), d (x) AS (SELECT * FROM c JOIN lineitem ON true) SELECT * FROM c, d'
        WHEN 2 THEN 'SELECT "FROM no3", ''it'' || '' /* '' FROM supplier -- */ FROM no4' WHEN 3 THEN 'INSERT INTO "My Table" SELECT * FROM a.b.c WHERE x = ''FROM no5''' WHEN 4 THEN 'select 1 from t' || cast(o_custkey % 9 AS string) || ', region as r where exists (select 1 from nation n2, (select 1 from events) e)'
        WHEN 5 THEN 'WITH orders AS (SELECT * FROM orders) UPDATE stock SET x = extract(year from d) FROM orders' WHEN 6 THEN 'MERGE INTO tgt USING (SELECT * FROM src' || cast(o_custkey % 9 AS string) || ') s ON s.a = tgt.a WHEN MATCHED THEN UPDATE SET a = 1' ELSE 'SELECT $$ FROM no6 $$ -- FROM no7' END AS text FROM {orders}""",
    "def_lines": """SELECT def_id, schema_name, object_name, object_type, n.n AS line, CASE n.n WHEN 1 THEN substr(text, 1, 20) WHEN 2 THEN substr(text, 21, 20) ELSE substr(text, 41) END AS text FROM {definitions} CROSS JOIN (VALUES (1), (2), (3)) AS n(n)""",
    "edges": """SELECT 'e' || cast(l_partkey AS string) || '_' || cast(l_suppkey AS string) AS edge_key, 's' || cast(l_suppkey % 3 AS string) AS server_name, 'd' || cast(l_suppkey % 4 AS string) AS database_name, 't' || cast(l_partkey AS string) AS object_name, 't' || cast(l_suppkey AS string) AS target_object_name,
        CASE l_suppkey % 3 WHEN 0 THEN 'FOREIGN_KEY' WHEN 1 THEN 'READS' ELSE 'WRITES' END AS relationship_type, CASE l_suppkey % 4 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'TABLE' ELSE 'PROCEDURE' END AS object_type, cast(l_suppkey % 3 + 1 AS int) AS dependency_level, cast(50 + l_suppkey % 51 AS double) / 100 AS confidence_score, l_shipdate AS seen_at, l_orderkey * 10 + l_linenumber AS seen_id FROM {lineitem}""",
    "subjects": """SELECT c_custkey AS subject_id, 'user' || cast(c_custkey AS string) || '@mail.test' AS email, 'Name ' || cast(c_custkey % 40 AS string) AS full_name, c_mktsegment AS segment FROM {customer}""",
    "requests": """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'user' || cast(c_custkey * 3 AS string) || '@MAIL.test' END AS email, CASE WHEN c_custkey % 50 = 0 THEN 'name ' || cast(c_custkey % 40 AS string) END AS full_name, CASE c_custkey % 3 WHEN 0 THEN 'ERASURE' WHEN 1 THEN 'PORTABILITY' ELSE 'ACCESS' END AS request_type,
        CASE c_custkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'pending' WHEN 2 THEN 'COMPLETED' ELSE 'REJECTED' END AS status, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * cast(c_custkey % 500 AS int) AS requested_at FROM {customer} WHERE c_custkey % 10 = 0""",
    "consents": """SELECT event_id, 's' || cast(user_id % 2 AS string) AS schema_name, 't' || cast(user_id % 3 AS string) AS table_name, user_id AS subject_id, CASE WHEN event_id % 2 = 0 THEN 'MARKETING' ELSE 'ANALYTICS' END AS consent_type, CASE WHEN event_type = 'error' THEN 'WITHDRAWN' ELSE 'GIVEN' END AS status, ts FROM {events}""",
    "glossary": """SELECT p_partkey AS term_id, p_name AS term, 'what ' || p_type || ' is' AS definition, p_brand AS domain, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 's.t' || cast(p_partkey % 100 AS string) || ', s.t' || cast(p_partkey % 37 AS string) || ' ,, s.x' END AS related_tables FROM {part}""",
    "tasks": """SELECT table_name, schema_name, CASE cast(substr(table_name, 2) AS bigint) % 5 WHEN 0 THEN 'VACUUM' WHEN 1 THEN 'REINDEX' WHEN 2 THEN 'ANALYZE' WHEN 3 THEN 'OPTIMIZE TABLE' ELSE 'REBUILD INDEX' END AS maintenance_type, fragmentation_percentage AS fragmentation_pct,
        CASE WHEN legal_hold THEN 'COMPLETED' ELSE 'PENDING' END AS status, NOT retention_enforced AS enabled, last_analyzed + INTERVAL '1' HOUR * 24 AS next_date FROM {gov}""",
    "table_stats": """SELECT schema_name, table_name, cast(substr(table_name, 2) AS bigint) * 101 % 5000 AS dead_rows, cast(substr(table_name, 2) AS bigint) * 211 % 20000 AS live_rows, CASE WHEN legal_hold THEN NULL ELSE last_analyzed END AS last_vacuum, last_schema_change AS last_analyze, fragmentation_percentage AS fragmentation_pct, cast(substr(table_name, 2) AS bigint) % 300 AS page_count, cast(substr(table_name, 2) AS bigint) * 3 % 200 AS free_mb FROM {gov}""",
}


def sources(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]\w*)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a fixture built from given tables."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FIXTURES[name]
    text = sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    frames = {n: table(spark, sf_dir, n) for n in sources(sql)}
    for n in frames:
        text = text.replace("{" + n + "}", f"<{n}>")
    text = text.replace("{", "{{").replace("}", "}}")
    for n in frames:
        text = text.replace(f"<{n}>", "{" + n + "}")
    return spark.sql(text, **frames)


@cache
def needed(sql: str) -> tuple[str, ...]:
    """Fixtures that the SQL stands on, each after those it needs."""
    out: list[str] = []
    for n in sources(sql):
        if n in FIXTURES:
            out += [x for x in (*needed(FIXTURES[n]), n) if x not in out]
    return tuple(out)


def oracle(sql: str) -> str:
    """The SQL for DuckDB, with its fixtures as common table expressions."""
    sql = sql.strip()
    names = needed(sql)
    parts = [f"{n} AS ({FIXTURES[n]})" for n in names]
    if sql.upper().startswith("WITH "):
        parts.append(sql[5:])
        text = "WITH " + ",\n".join(parts) if names else sql
    else:
        text = ("WITH " + ",\n".join(parts) + "\n" if names else "") + sql
    return re.sub(r"\{([a-z_]\w*)\}", r"\1", text)
