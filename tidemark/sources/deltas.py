"""Tables merged on read (B3, D11): a batch writes its own rows and the places of those it replaces, no more.

A table is a folder of immutable Parquet files, each with its range of keys; `dead` holds the places (file and row
number) of rows that were replaced; `files` says for every commit which files came and went; and
log/<version>.json names the folders that make up a version. merge() finds the files whose key range meets a key of
the batch, reads their key columns only, and writes the places it found, the new rows, and the log entry; the
rows that stay are neither read nor written. current() reads files without dead rows as they are and joins the
others with the places of their dead rows. compact() rewrites the files whose share of dead rows is large.

A log entry is created only where there is none of its number, so that of two writers that began from one version
the second raises Conflict and can start again. Rows have unique keys without nulls; keyed rows with a null part are
left out, as by B3. With an order column an existing row of equal or higher order stays (a batch that is replayed
changes nothing). File entries are collected by the driver, as a scan of these files would do."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import cdc
from . import scratch

SPANS = 256  # key ranges by which a batch looks for files; a batch with at most so many keys looks with each key
FILE_ROWS = 5_000_000
PLACE = "file string, pos long"


class Conflict(RuntimeError):
    """Another writer has published the version this one was about to."""


@dataclass(frozen=True)
class Version:
    number: int
    keys: list[str]
    schema: str
    batch: int | None = None
    files: list[str] = field(default_factory=list)  # folders of file entries
    dead: list[str] = field(default_factory=list)  # folders of places


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in scratch.children(spark, f"{path}/log") if n.endswith(".json"))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The last version whose log entry is whole, or that of this number; None if there is none."""
    for n in reversed(versions(spark, path)):
        if number is None or n == number:
            try:
                return Version(**json.loads(scratch.text(spark, f"{path}/log/{n:012d}.json")))
            except json.JSONDecodeError:  # its writer was lost while writing it
                continue
    return None


def publish(spark: SparkSession, path: str, v: Version) -> None:
    if not scratch.create(spark, f"{path}/log/{v.number:012d}.json", json.dumps(asdict(v))):
        raise Conflict(f"version {v.number} of {path} is another writer's")


def following(spark: SparkSession, path: str) -> int:
    return max(versions(spark, path), default=-1) + 1


def placed(df: DataFrame) -> DataFrame:
    """df of data files with the place of every row."""
    return df.withColumns({"file": F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+)$", 1), "pos": F.col("_metadata.row_index")})


def entry_schema(v: Version) -> str:
    fields = {f.name: f.dataType.simpleString() for f in StructType.fromJson(json.loads(v.schema))}
    span = "struct<" + ", ".join(f"`{k}`: {fields[k]}" for k in v.keys) + ">"
    return f"file string, rows long, lo {span}, hi {span}, gone boolean"


def write_rows(rows: DataFrame, path: str, v: Version, name: str, file_rows: int, gone: list[str] = ()) -> None:
    """Write rows as files sorted by key, and their entries beside those of files that go."""
    spark, folder = rows.sparkSession, f"{path}/data/{name}"
    rows.repartitionByRange(*v.keys).sortWithinPartitions(*v.keys).write.option("maxRecordsPerFile", file_rows).parquet(folder)
    there = placed(spark.read.schema(StructType.fromJson(json.loads(v.schema))).parquet(folder))
    key = F.struct(*v.keys)
    entries = there.groupBy("file").agg(F.count("*").alias("rows"), F.min(key).alias("lo"), F.max(key).alias("hi")).withColumn("gone", F.lit(False))
    if gone:
        left = spark.createDataFrame([(g,) for g in gone], "file string").select("file", F.lit(0).cast("long").alias("rows"), *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in ("lo", "hi")], F.lit(True).alias("gone"))
        entries = entries.unionByName(left)
    entries.coalesce(1).write.parquet(f"{path}/files/{name}")


def entries(spark: SparkSession, path: str, v: Version) -> DataFrame:
    """The files of a version: file, rows, lo, hi."""
    every = spark.read.schema(entry_schema(v)).parquet(*[f"{path}/{f}" for f in v.files])
    return every.where("not gone").drop("gone").join(every.where("gone").select("file"), "file", "left_anti")


def dead(spark: SparkSession, path: str, v: Version) -> DataFrame:
    """The places of a version's dead rows."""
    return spark.read.schema(PLACE).parquet(*[f"{path}/{f}" for f in v.dead]) if v.dead else spark.createDataFrame([], PLACE)


def spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """At most SPANS ranges (lo and hi, their first and last key) that hold all keys of rows."""
    key = F.struct(*keys)
    few = rows.select(*keys).distinct().limit(SPANS + 1)
    if few.count() <= SPANS:
        return few.select(key.alias("lo"), key.alias("hi"))
    return rows.select(*keys).repartitionByRange(SPANS, *keys).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).drop("_p")


def touched(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """The entries whose key range meets one of the ranges. These come as a small frame: as literals of an expression,
    256 of them take seconds to build and to plan."""
    known = ranges.select(*[F.col(c).cast(files.schema[c].dataType).alias(f"_{c}") for c in ("lo", "hi")])
    return files.join(F.broadcast(known), (F.col("_lo") <= F.col("hi")) & (F.col("_hi") >= F.col("lo")), "left_semi")


def opened(spark: SparkSession, path: str, v: Version, files: list[str]) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(v.schema))).parquet(*[f"{path}/{f}" for f in files])


def create(df: DataFrame, path: str, keys: list[str], *, batch: int | None = None, file_rows: int = FILE_ROWS) -> None:
    """The first version of a table, or a new one in place of all that was there."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    v = Version(following(spark, path), keys, df.schema.json(), batch, [f"files/{name}"])
    write_rows(cdc.keyed(df, keys), path, v, name, file_rows)
    publish(spark, path, v)


def current(spark: SparkSession, path: str, *, number: int | None = None, near: DataFrame | None = None) -> DataFrame | None:
    """The rows of the last version (or of this number); with near only files that can hold one of its keys are read."""
    v = version(spark, path, number)
    if v is None:
        return None
    files = entries(spark, path, v)
    if near is not None:
        files = touched(files, spans(near, v.keys))
    gone = dead(spark, path, v)
    marked = {r["file"] for r in gone.select("file").distinct().collect()}
    names = [r["file"] for r in files.select("file").collect()]
    clean, hurt = [n for n in names if n not in marked], [n for n in names if n in marked]
    out = opened(spark, path, v, clean) if clean else None
    if hurt:
        rest = placed(opened(spark, path, v, hurt)).join(gone, ["file", "pos"], "left_anti").drop("file", "pos")
        out = rest if out is None else out.unionByName(rest)
    return spark.createDataFrame([], StructType.fromJson(json.loads(v.schema))) if out is None else out


def merge(rows: DataFrame, path: str, *, order: str | None = None, batch: int | None = None, file_rows: int = FILE_ROWS) -> bool:
    """Rows in place of those of equal keys, as a new version; False if this batch, or a later one, is in the table
    already."""
    spark = rows.sparkSession
    v, number = version(spark, path), following(spark, path)
    if batch is not None and v.batch is not None and batch <= v.batch:
        return False
    schema = StructType.fromJson(json.loads(v.schema))
    work, name = scratch.folder(spark, "merge"), uuid.uuid4().hex
    cdc.keyed(rows.select(*schema.names), v.keys).write.parquet(f"{work}/rows")
    rows = spark.read.schema(schema).parquet(f"{work}/rows")
    files = [r["file"] for r in touched(entries(spark, path, v), spans(rows, v.keys)).select("file").collect()]
    new = replace(v, number=number, batch=v.batch if batch is None else batch, files=[*v.files, f"files/{name}"])
    if files:
        held = placed(opened(spark, path, v, files)).select(*v.keys, *([F.col(order).alias("_held")] if order else []), "file", "pos").join(dead(spark, path, v), ["file", "pos"], "left_anti")
        newer = F.coalesce(F.col(order) > F.col("_held"), F.col("_held").isNull()) if order else F.lit(True)
        met = held.join(rows.select(*v.keys, *([order] if order else [])), v.keys).select(*v.keys, "file", "pos", newer.alias("_newer"))
        met.write.parquet(f"{work}/met")
        met = spark.read.schema(met.schema).parquet(f"{work}/met")
        rows = rows.join(met.where("not _newer").select(*v.keys), v.keys, "left_anti").select(*schema.names)
        met.where("_newer").select("file", "pos").coalesce(8).write.parquet(f"{path}/dead/{name}")
        new = replace(new, dead=[*v.dead, f"dead/{name}"])
    write_rows(rows, path, new, name, file_rows)
    publish(spark, path, new)
    scratch.remove(spark, work)
    return True


def remove(keys: DataFrame, path: str) -> None:
    """The rows of these keys go; only their places are written."""
    spark = keys.sparkSession
    v, number, name = version(spark, path), following(spark, path), uuid.uuid4().hex
    files = [r["file"] for r in touched(entries(spark, path, v), spans(keys, v.keys)).select("file").collect()]
    if files:
        held = placed(opened(spark, path, v, files)).select(*v.keys, "file", "pos").join(dead(spark, path, v), ["file", "pos"], "left_anti")
        held.join(keys.select(*v.keys).distinct(), v.keys, "left_semi").select("file", "pos").write.parquet(f"{path}/dead/{name}")
        publish(spark, path, replace(v, number=number, dead=[*v.dead, f"dead/{name}"]))


def compact(spark: SparkSession, path: str, *, share: float = 0.3, small: int = 0, keep: Column | None = None, file_rows: int = FILE_ROWS) -> list[str]:
    """Rewrite files with at least this share of dead rows, and those with fewer than `small` rows; of the rows that are
    rewritten those go for which keep does not hold. The files that were rewritten; the log starts anew from here."""
    v, number, name = version(spark, path), following(spark, path), uuid.uuid4().hex
    gone = dead(spark, path, v)
    counts = gone.groupBy("file").agg(F.count("*").alias("dead"))
    state = entries(spark, path, v).join(counts, "file", "left").na.fill(0, ["dead"])
    picked = sorted(r["file"] for r in state.where((F.col("dead") >= F.greatest(F.lit(1), F.ceil(F.col("rows") * share))) | (F.col("rows") < small) if share > 0 else F.lit(True)).select("file").collect())
    if not picked:
        return []
    live = placed(opened(spark, path, v, picked)).join(gone, ["file", "pos"], "left_anti").drop("file", "pos")
    new = replace(v, number=number, files=[f"files/{name}", f"files/{name}-kept"], dead=[])
    write_rows(live.where(keep) if keep is not None else live, path, new, name, file_rows)
    out = spark.createDataFrame([(p,) for p in picked], "file string")
    state.drop("dead").join(out, "file", "left_anti").withColumn("gone", F.lit(False)).coalesce(1).write.parquet(f"{path}/files/{name}-kept")
    rest = gone.join(out, "file", "left_anti")
    rest.coalesce(max(1, math.ceil(len(v.dead) / 8))).write.parquet(f"{path}/dead/{name}")
    publish(spark, path, replace(new, dead=[f"dead/{name}"]))
    return picked


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Forget all but the last versions, and remove the folders that none of these names. Readers of older versions must
    be done, and no writer may be at work."""
    kept = [v for n in versions(spark, path) if (v := version(spark, path, n))][-keep:]
    if not kept:
        return
    named = {f for v in kept for f in [*v.files, *v.dead]}
    data = {r["file"].rsplit("/", 1)[0] for v in kept for r in entries(spark, path, v).select("file").collect()}
    for n in versions(spark, path):
        if n < kept[0].number:
            scratch.remove(spark, f"{path}/log/{n:012d}.json")
    for kind in ("files", "dead", "data"):
        for name in scratch.children(spark, f"{path}/{kind}"):
            if f"{kind}/{name}" not in (data if kind == "data" else named):
                scratch.remove(spark, f"{path}/{kind}/{name}")
