"""Queries that write and read back: sinks (B) and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comply, sketches
from ..sources import deltas, scratch, sinks
from ..streaming import changes, stateful, windows
from .registry import query
from .replication import IMAGE, KEYS, LAST, PARSED


@query("b1_append", "SELECT o_orderstatus, count(*) AS n, cast(sum(o_custkey) AS bigint) AS keys FROM orders GROUP BY 1")
def b1(t):
    path = scratch.folder(t.spark, "append")
    for part in (0, 1):
        sinks.append(t.orders.where(F.col("o_orderkey") % 2 == part), path)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("b2_replace", "SELECT event_type, CASE WHEN event_type = 'click' THEN 1 ELSE count(*) END AS n FROM events GROUP BY 1")
def b2(t):
    path = scratch.folder(t.spark, "replace")
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    sinks.replace(counts, path, partitions=["event_type"])
    sinks.replace(counts.where("event_type = 'click'").withColumn("n", F.lit(1).cast("long")), path, partitions=["event_type"])
    return t.spark.read.parquet(path).select(F.col("event_type").cast("string"), "n")


@query("b3_merged_versions", "SELECT user_id, cents, kind FROM {users_source} UNION ALL SELECT user_id, cents, kind FROM {users_before} WHERE user_id NOT IN (SELECT user_id FROM {users_source})")
def b3(t):
    path = scratch.folder(t.spark, "versions")
    sinks.publish(t.users_before, path, 0, keys=["user_id"], buckets=8)
    sinks.publish(sinks.upserted(sinks.current(t.spark, path), t.users_source, ["user_id"]), path, 1, keys=["user_id"], buckets=8)
    sinks.prune(t.spark, path, keep=1)
    return sinks.current(t.spark, path)


@query("b3_merge_on_read", "SELECT user_id, cents, kind FROM {users_source} UNION ALL SELECT user_id, cents, kind FROM {users_before} WHERE user_id NOT IN (SELECT user_id FROM {users_source})")
def b3_merge(t):
    path = scratch.folder(t.spark, "deltas")
    deltas.create(t.users_before, path, ["user_id"])
    for part in range(3):
        deltas.merge(t.users_source.where(F.col("user_id") % 3 == part), path)
        if part == 1:
            deltas.compact(t.spark, path, share=0.5)
    return deltas.current(t.spark, path)


@query("b3_versions_read", "SELECT v.v AS version, count(*) AS n, cast(sum(x.cents) AS bigint) AS cents FROM (SELECT 0 AS v, cents FROM {users_before} UNION ALL SELECT 1, cents FROM {users_source} UNION ALL SELECT 1, cents FROM {users_before} WHERE user_id NOT IN (SELECT user_id FROM {users_source}) UNION ALL SELECT 2, cents FROM {users_source} WHERE user_id % 2 = 0 UNION ALL SELECT 2, cents FROM {users_before} WHERE user_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM {users_source})) x JOIN (VALUES (0), (1), (2)) AS v(v) ON v.v = x.v GROUP BY v.v")
def b3_versions(t):
    path = scratch.folder(t.spark, "deltas")
    deltas.create(t.users_before, path, ["user_id"])
    deltas.merge(t.users_source, path)
    deltas.remove(t.users_source.unionByName(t.users_before).where("user_id % 2 <> 0").select("user_id"), path)
    return sinks.union_all([deltas.current(t.spark, path, number=n).agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select(F.lit(n).alias("version"), "n", "cents") for n in range(3)])


@query("b6_archive", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00'")
def b6(t):
    path = scratch.folder(t.spark, "archive")
    comply.execute(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderdate", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), archive=path)
    return t.spark.read.schema("o_orderkey long, o_orderstatus string, o_orderdate string").option("header", True).csv(path).select("o_orderkey", "o_orderstatus")


@query("b8_formats", "SELECT f.f AS format, count(*) AS n, cast(sum(c_custkey) AS bigint) AS keys FROM customer CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) AS f(f) GROUP BY 1")
def b8(t):
    found = []
    for kind in ("csv", "json", "parquet"):
        path = scratch.folder(t.spark, kind)
        rows = t.customer.select("c_custkey", "c_mktsegment")
        sinks.write_to(rows, kind, path)
        found.append(t.spark.read.format(kind).schema(rows.schema).load(path).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).select(F.lit(kind).alias("format"), "n", "keys"))
    return sinks.union_all(found)


@query("d11_stream_apply", f"WITH {PARSED}, {LAST} SELECT user_id, cents, kind FROM l WHERE operation <> 'D'")
def d11(t):
    from ..operators import cdc

    root = scratch.folder(t.spark, "stream")
    log = t.change_log.select("change_id", "operation", "pk_values", "row_data")
    log.write.parquet(f"{root}/in")
    stream = changes.read_changes(t.spark, f"{root}/in", "change_id long, operation string, pk_values string, row_data string")
    run = changes.apply_stream(stream, f"{root}/table", f"{root}/checkpoint", keys=["user_id"], columns=["cents", "kind"], prepare=lambda b: cdc.parse(b, KEYS, IMAGE).drop("has"))
    run.awaitTermination()
    return changes.live(t.spark, f"{root}/table")


@query("d11_late_changes", f"WITH {PARSED}, {LAST} SELECT user_id, cents, kind FROM l WHERE operation <> 'D'")
def d11_late(t):
    from ..operators import cdc

    path = scratch.folder(t.spark, "late")
    log = cdc.known(cdc.parse(t.change_log.select("change_id", "operation", "pk_values", "row_data"), KEYS, IMAGE).drop("has"))
    for i, part in enumerate((2, 0, 1, 0)):  # parts of the log out of order, one of them twice
        rows = cdc.latest(cdc.keyed(log.where(F.col("change_id") % 3 == part), ["user_id"]), ["user_id"]).select("user_id", "cents", "kind", F.col("change_id").alias("_change_id"), (F.col("operation") == "D").alias("_deleted"))
        if i:
            deltas.merge(rows, path, order="_change_id")
        else:
            deltas.create(rows, path, ["user_id"])
    return changes.live(t.spark, path)


@query("d12_document_stream", """WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'D' ELSE 'U' END AS op, substr(md5(cast(event_id % 300 AS string)), 1, 24) AS _id, '{"_id": "' || substr(md5(cast(event_id % 300 AS string)), 1, 24) || '", "kind": "' || event_type || '"}' AS _document FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY event_id DESC) AS n FROM x) SELECT _id, _document FROM r WHERE n = 1 AND op = 'U'""")
def d12(t):
    root = scratch.folder(t.spark, "documents")
    id = F.substring(F.md5((F.col("event_id") % 300).cast("string")), 1, 24)
    doc = F.concat(F.lit('{"_id": "'), id, F.lit('", "kind": "'), "event_type", F.lit('"}'))
    t.events.select(F.col("event_id").alias("change_id"), F.when(F.col("event_id") % 5 == 0, "delete").otherwise("update").alias("kind"), doc.alias("doc")).write.parquet(f"{root}/in")
    stream = changes.document_changes(changes.read_changes(t.spark, f"{root}/in", "change_id long, kind string, doc string"))
    changes.apply_stream(stream, f"{root}/table", f"{root}/checkpoint", keys=["_id"], columns=["_document"], most=10_000).awaitTermination()
    return changes.live(t.spark, f"{root}/table")


@query("d11_stateful_apply", f"WITH {PARSED}, {LAST} SELECT user_id, cents, kind FROM l WHERE operation <> 'D'")
def d11_stateful(t):
    from ..operators import cdc

    root = scratch.folder(t.spark, "state")
    log = t.change_log.select("change_id", "change_time", "operation", "pk_values", "row_data")
    log.withColumn("change_time", F.col("change_time").cast("timestamp")).write.parquet(f"{root}/in")
    stream = changes.read_changes(t.spark, f"{root}/in", "change_id long, change_time timestamp, operation string, pk_values string, row_data string")
    found = stateful.effective(cdc.parse(stream, KEYS, IMAGE), ["user_id"], ["cents", "kind"], late="30 days")
    stateful.start(found, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return stateful.rows(t.spark, f"{root}/log", ["user_id"])


def _instant(c):
    """A time without zone as an instant (watermarks need one), as UTC whatever the session's zone is."""
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), F.extract(F.lit("SECOND"), c), F.lit("UTC")).alias(c)


def _closed(t, rows, build):
    """The windows that a stream over rows closes."""
    root = scratch.folder(t.spark, "windows")
    rows.write.parquet(f"{root}/in")
    windows.append(build(t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    back = lambda c: F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(unix_micros({c}) / 1000000 AS decimal(18, 6)))")
    return t.spark.read.parquet(f"{root}/out").withColumns({c: back(c) for c in ("window_start", "window_end")})


@query("k8_stream_windows", """WITH r AS (SELECT *, date_trunc('day', completed_at) AS d FROM {transfers} WHERE completed_at IS NOT NULL), x AS (SELECT d AS w, * FROM r UNION ALL SELECT d - INTERVAL 1 DAY, * FROM r)
SELECT cast(w AS timestamp) AS window_start, cast(w + INTERVAL 2 DAY AS timestamp) AS window_end, db_engine, count(*) AS transfers, cast(sum(records_transferred) AS bigint) AS records, cast(sum(bytes_transferred) AS bigint) AS bytes, max(memory_used_mb) AS memory_mb, cast(sum(io_operations) AS bigint) AS io_operations
FROM x WHERE w + INTERVAL 2 DAY <= (SELECT max(completed_at) FROM r) - INTERVAL 1 HOUR GROUP BY w, db_engine""")
def k8_windows(t):
    rows = t.transfers.select("db_engine", "records_transferred", "bytes_transferred", "memory_used_mb", "io_operations", _instant("completed_at"))
    return _closed(t, rows, lambda s: windows.engine_windows(s, size="2 days", slide="1 day", late="1 hour"))


@query("j12_stream_anomalies", """WITH r AS (SELECT *, date_trunc('day', access_timestamp) AS d FROM {access_log}), x AS (SELECT d - INTERVAL 1 DAY * n.n AS w, r.* FROM r CROSS JOIN (VALUES (0), (1), (2)) AS n(n))
SELECT cast(w AS timestamp) AS window_start, cast(w + INTERVAL 3 DAY AS timestamp) AS window_end, username, count(*) AS accesses FROM x WHERE is_sensitive_data AND w + INTERVAL 3 DAY <= (SELECT max(access_timestamp) FROM r WHERE is_sensitive_data) - INTERVAL 1 HOUR GROUP BY w, username HAVING count(*) > 3""")
def j12_windows(t):
    rows = t.access_log.select("username", "is_sensitive_data", _instant("access_timestamp"))
    return _closed(t, rows, lambda s: windows.access_anomalies(s, most=3, size="3 days", slide="1 day"))


@query("f1_stored_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")))
def f1_stored(t):
    root = scratch.folder(t.spark, "sketches")
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    for part in ("l_linenumber < 3", "l_linenumber >= 3"):  # the second time only the new files are read
        rows.where(part).write.mode("append").parquet(f"{root}/table")
        sketches.refresh(t.spark, f"{root}/table", f"{root}/store")
    return sketches.profile(sketches.stored(t.spark, f"{root}/store")).select("column_name", "rows", "nulls", "distinct_values")


@query("f5_estimated_duplicates", "SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)) AS duplicate_count, cast(0 AS double) AS standard_error FROM lineitem")
def f5_estimated(t):
    return sketches.duplicates(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], above=100_000_000)
