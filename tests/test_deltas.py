"""Tables merged on read: what a batch writes, what a reader opens, replays, conflicts, compaction."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import deltas
from tidemark.streaming import changes


def size(folder) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def table(spark, path, n=100_000, files=20):
    df = spark.range(n).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    deltas.create(df, path, ["k"], file_rows=n // files)
    return df


def test_a_batch_writes_its_own_size(spark, tmp_path):
    path = str(tmp_path / "t")
    df = table(spark, path)
    base, folders = size(path), set(os.listdir(f"{path}/data"))
    assert deltas.entries(spark, path, deltas.version(spark, path)).count() >= 20
    batch = spark.range(40_000, 41_000).select(F.col("id").alias("k"), F.lit("new").alias("v")).unionByName(spark.createDataFrame([(200_000, "more"), (None, "keyless")], "k long, v string"))
    assert deltas.merge(batch, path, batch=1)
    assert size(path) - base < base * 0.04
    v = deltas.version(spark, path)
    hurt = {r["file"] for r in deltas.dead(spark, path, v).select("file").distinct().collect()}
    assert len(hurt) <= 2 and deltas.dead(spark, path, v).count() == 1000
    got = deltas.current(spark, path)
    assert got.count() == 100_001 and got.where("v = 'new'").count() == 1000 and got.where("v = 'more'").count() == 1
    assert got.exceptAll(df).where("v <> 'new' and v <> 'more'").count() == 0
    near = deltas.current(spark, path, near=spark.createDataFrame([(77,), (40_500,)], "k long"))
    assert len(near.inputFiles()) < 10 and near.where("k in (77, 40500)").count() == 2
    assert deltas.current(spark, path, number=0).exceptAll(df).count() == 0
    assert not deltas.merge(batch, path, batch=1)  # a replay
    assert len(set(os.listdir(f"{path}/data")) - folders) == 1


def test_compaction_picks_files_by_their_dead_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = table(spark, path, 20_000, 10)
    first = deltas.entries(spark, path, deltas.version(spark, path)).orderBy("lo").first()
    gone = df.where(F.col("k").between(first["lo"]["k"], first["lo"]["k"] + first["rows"] // 2) | (F.col("k") % 5000 == 4999))
    deltas.remove(gone.select("k"), path)
    want = sorted(df.join(gone, "k", "left_anti").collect())
    assert sorted(deltas.current(spark, path).collect()) == want
    assert deltas.compact(spark, path, share=0.4) == [first["file"]]
    assert sorted(deltas.current(spark, path).collect()) == want
    v = deltas.version(spark, path)
    assert deltas.dead(spark, path, v).where(F.col("file") == first["file"]).count() == 0 and deltas.dead(spark, path, v).count() > 0
    deltas.vacuum(spark, path, keep=1)
    assert sorted(deltas.current(spark, path).collect()) == want and deltas.versions(spark, path) == [v.number]
    assert deltas.compact(spark, path, share=0) and deltas.dead(spark, path, deltas.version(spark, path)).count() == 0
    assert sorted(deltas.current(spark, path).collect()) == want
    deltas.remove(df.select("k"), path)
    assert deltas.current(spark, path).count() == 0


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    deltas.create(spark.createDataFrame([(1, "a")], "k int, v string"), path, ["k"])
    number = deltas.following(spark, path)
    monkeypatch.setattr(deltas, "following", lambda *_: number)  # both began from the same version
    deltas.merge(spark.createDataFrame([(1, "b")], "k int, v string"), path)
    with pytest.raises(deltas.Conflict):
        deltas.merge(spark.createDataFrame([(1, "c")], "k int, v string"), path)
    monkeypatch.undo()
    assert [tuple(r) for r in deltas.current(spark, path).collect()] == [(1, "b")]
    (tmp_path / "t" / "log" / "000000000009.json").write_text("")  # of a writer that was lost
    deltas.merge(spark.createDataFrame([(2, "d")], "k int, v string"), path)
    assert sorted(tuple(r) for r in deltas.current(spark, path).collect()) == [(1, "b"), (2, "d")]


def test_composite_keys_empty_tables_and_orders(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "a string, b date, v int, n long"
    deltas.create(spark.createDataFrame([], ddl), path, ["a", "b"])
    assert deltas.current(spark, path).count() == 0
    import datetime as dt

    d = dt.date(2024, 1, 1)
    rnd, want = random.Random(2), {}
    for _ in range(4):
        rows = {(rnd.choice("xyz'é"), d + dt.timedelta(rnd.randint(0, 3))): (rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(6)}
        deltas.merge(spark.createDataFrame([(*k, *v) for k, v in rows.items()] + [(None, d, 1, 1)], ddl), path, order="n")
        for k, v in rows.items():
            if k not in want or v[1] > want[k][1]:
                want[k] = v
    assert {(r["a"], r["b"]): (r["v"], r["n"]) for r in deltas.current(spark, path).collect()} == want


def test_many_keys_are_looked_up_by_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    df = table(spark, path, 20_000, 10)
    deltas.merge(df.where("k % 3 = 0").withColumn("v", F.lit("m")), path)
    got = deltas.current(spark, path)
    assert got.count() == 20_000 and got.where("v = 'm'").count() == 6667


def test_parts_of_a_batch_are_bounded(spark):
    batch = spark.range(1000).select((F.col("id") * 7).alias("change_id"))
    parts = [p.count() for p in changes.portions(batch, 130)]
    assert max(parts) <= 130 and sum(parts) == 1000 and len(changes.portions(batch, None)) == len(changes.portions(batch, 1000)) == 1


def test_changes_of_one_key_are_one_change_to_merge(spark, tmp_path):
    log = spark.range(4000).select(F.col("id").alias("change_id"), F.when(F.col("id") % 7 == 0, "D").otherwise("U").alias("operation"), (F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted((i % 300, i) for i in range(3700, 4000) if i % 7)
    for most, least in ((300, 1), (100, 3)):
        table = str(tmp_path / f"t{most}")
        stream = changes.read_changes(spark, str(tmp_path / "in"), "change_id long, operation string, k long, v long")
        changes.apply_stream(stream, table, str(tmp_path / f"c{most}"), keys=["k"], columns=["v"], most=most).awaitTermination()
        assert sorted(tuple(r) for r in changes.live(spark, table).collect()) == want
        written = [spark.read.parquet(f"{table}/data/{f}").count() for f in os.listdir(f"{table}/data")]
        assert least <= len(written) <= 4 * least - 3 and max(written) <= most and sum(written) == 300  # before: 40 merges of 100 changes
