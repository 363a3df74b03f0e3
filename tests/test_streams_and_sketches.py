"""Keyed state, event-time windows, stored sketches, sampled duplicates, even database splits."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cdc, sketches
from tidemark.sources import scan, sinks
from tidemark.streaming import changes, stateful, windows

DDL = "k long, v string, change_id long, operation string, change_time timestamp"
T0 = dt.datetime(2024, 1, 1)


def test_keyed_state_under_replays_and_late_changes(spark, tmp_path):
    rnd = random.Random(3)
    log = [(rnd.randrange(12) if rnd.random() > 0.05 else None, rnd.choice("ab"), i, rnd.choice("IUUDX"), T0 + dt.timedelta(minutes=i)) for i in range(150)]
    shuffled = log + log[40:70]  # out of order, some delivered twice
    rnd.shuffle(shuffled)
    for i in range(0, len(shuffled), 60):
        spark.createDataFrame(shuffled[i : i + 60], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = changes.read_changes(spark, str(tmp_path / "in"), DDL, 1)
    for _ in range(2):  # the second run finds nothing new
        stateful.start(stateful.effective(stream, ["k"], ["v"], late="30 days"), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    got = stateful.rows(spark, str(tmp_path / "log"), ["k"])
    want = cdc.apply_changes(spark.createDataFrame([], "k long, v string"), spark.createDataFrame(log, DDL), ["k"], ["v"])
    assert sorted(got.select("k", "v").collect()) == sorted(want.select("k", "v").collect()) and got.count() > 0
    out = spark.read.parquet(str(tmp_path / "log"))
    assert out.count() == out.dropDuplicates(["k", "_change_id"]).count()  # nothing is given out twice


def test_tombstones_expire(spark, tmp_path):
    steps = [[(1, "a", 1, "I", T0), (1, None, 2, "D", T0)], [(1, "late", 1, "U", T0 + dt.timedelta(hours=1)), (2, "x", 3, "I", T0 + dt.timedelta(days=9))], [(3, "y", 4, "I", T0 + dt.timedelta(days=9))], [(1, "again", 1, "I", T0 + dt.timedelta(days=9))]]
    for rows in steps:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = changes.read_changes(spark, str(tmp_path / "in"), DDL, 1)
        stateful.start(stateful.effective(stream, ["k"], ["v"], late="1 day", keep_seconds=86400), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    out = sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "log")).where("not _deleted").collect())
    assert ("late" not in {v for _, v in out}) and (1, "again") in out


def test_closed_windows_equal_a_batch(spark, tmp_path):
    rnd = random.Random(4)
    ddl = "db_engine string, records_transferred long, bytes_transferred long, memory_used_mb long, io_operations long, completed_at timestamp"
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(9), 1, rnd.randrange(5), 2, None if i % 40 == 0 else T0 + dt.timedelta(minutes=i)) for i in range(400)]
    for i in range(0, 400, 100):
        spark.createDataFrame(rows[i : i + 100], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    build = lambda x: windows.engine_windows(x, size="30 minutes", slide="10 minutes", late="200 minutes")
    windows.append(build(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    mark = max(r[-1] for r in rows if r[-1]) - dt.timedelta(minutes=200)
    want = build(spark.createDataFrame(rows, ddl)).where(F.col("window_end") <= F.lit(mark))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() > 10


def test_sketches_of_files(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    df = spark.range(30_000).select("id", (F.col("id") % 100).alias("few"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id").cast("string")).alias("text"))
    df.where("id < 20000").repartition(3).write.parquet(table)
    assert len(sketches.refresh(spark, table, store)) == 3 and sketches.refresh(spark, table, store) == []
    df.where("id >= 20000").repartition(2).write.mode("append").parquet(table)
    assert len(sketches.refresh(spark, table, store)) == 2
    got = {r["column_name"]: r.asDict() for r in sketches.profile(sketches.stored(spark, store)).collect()}
    whole = {r["column_name"]: r.asDict() for r in sketches.profile(sketches.file_sketches(spark.read.parquet(table).coalesce(1))).collect()}
    assert got == whole  # a union of sketches is the sketch of the union
    assert got["few"]["distinct_values"] == 100 and got["few"]["mean"] == 49.5
    for c, n in (("id", 30_000), ("text", 20_000)):
        assert abs(got[c]["distinct_values"] - n) < 0.07 * n and (got[c]["rows"], got[c]["nulls"]) == (30_000, 30_000 - n)
    victim = next(f for f in os.listdir(table) if f.endswith(".parquet"))
    os.remove(os.path.join(table, victim))
    sketches.refresh(spark, table, store)
    assert sketches.profile(sketches.stored(spark, store)).where("column_name = 'id'").first()["rows"] == spark.read.parquet(table).count()


def test_sampled_duplicates(spark):
    rnd = random.Random(1)
    rows = [(i, None if i % 7 == 0 else "x") for i in range(6000) for _ in range(rnd.choice([1, 1, 1, 2, 5]))]
    df = spark.createDataFrame(rows, "a int, b string")
    true = len(rows) - 6000
    r = sketches.estimated_duplicates(df, one_in=10).first()
    assert r["total_rows"] == len(rows) and 0 < r["standard_error"] < 0.2 * true and abs(r["duplicate_count"] - true) < 4 * r["standard_error"]
    assert tuple(sketches.estimated_duplicates(df, one_in=1).first()) == (len(rows), true, 0.0) == tuple(sketches.duplicates(df).first())
    assert tuple(sketches.estimated_duplicates(df.limit(0)).first()) == (0, 0, 0.0)


@pytest.mark.parametrize(("keys", "n"), [(["K"], 4000), (["NAME"], 4000), (["G", "K"], 4000), (["DAY", "K"], 3000), (["K"], 3), (["K"], 0)])
def test_even_database_splits(spark, tmp_path, keys, n):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    # most keys lie close together, a few far away
    df = spark.range(n).select(F.when(F.col("id") % 100 == 0, F.col("id") * 1_000_000).otherwise(F.col("id")).alias("K"), F.concat(F.lit("it's "), F.lpad((F.col("id") % 4000).cast("string"), 9, "0")).alias("NAME"), (F.col("id") % 3).cast("int").alias("G"), F.expr("date_add(DATE'2024-01-01', cast(id % 11 as int))").alias("DAY"))
    sinks.write_to(df, "jdbc", url, "rows_of", driver=driver, createTableColumnTypes="NAME VARCHAR(40)")
    got = scan.read_jdbc_even(spark, url, "rows_of", keys=keys, partitions=8, driver=driver)
    assert got.exceptAll(df).count() == 0 and got.count() == n
    if n > 100:
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert got.rdd.getNumPartitions() == 8 and max(sizes) <= 2 * n / 8


def test_predicates_cover_every_row_once():
    parts = scan.even_predicates(["a", "b"], [(1, "x"), (1, "y"), (3, "it's")])
    assert len(parts) == 4 and "it''s" in parts[2] and scan.even_predicates(["a"], []) == ["1 = 1"]
