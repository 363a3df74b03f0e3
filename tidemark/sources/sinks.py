"""Sinks (group B): append, replace, merge, archive, rejects.

A table that is merged into has its rows in buckets by key. Publishing writes the changed buckets beside the old
ones and then a manifest, a small table that names the folder of every bucket. The last manifest that is whole
is the table, so that no job reads what it overwrites, readers see whole versions, and buckets without a
change are not written again. prune() removes what no manifest that is kept names."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc
from . import scratch


def stamped(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """The time of the load."""
    return df.withColumn(column, as_of)


def append(df: DataFrame, path: str) -> None:
    """B1."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, *, partitions: list[str] | None = None) -> None:
    """B2: the whole table, or with partitions only those that df has."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic") if partitions else w).parquet(path)


def manifests(spark: SparkSession, path: str) -> list[str]:
    """Folders of whole manifests, oldest first: m<version>-<id>, so that of two of one version the same is always last."""
    names = sorted(n for n in scratch.children(spark, f"{path}/manifest") if n.startswith("m"))
    return [f"{path}/manifest/{n}" for n in names if "_SUCCESS" in scratch.children(spark, f"{path}/manifest/{n}")]


def placed(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each bucket of the present version; at most as many as the table has buckets."""
    found = manifests(spark, path)
    return {r["bucket"]: r["folder"] for r in spark.read.schema("bucket int, folder string").parquet(found[-1]).collect()} if found else {}


def current(spark: SparkSession, path: str, buckets: set[int] | None = None) -> DataFrame | None:
    """The table's present version, or these buckets of it; None if there is none."""
    where = {b: f for b, f in placed(spark, path).items() if buckets is None or b in buckets}
    return spark.read.parquet(*[f"{path}/{f}" for f in where.values()]) if where else None


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a row; rows with equal keys share it, nulls too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def publish(df: DataFrame, path: str, n: int, *, keys: list[str] | None = None, buckets: int = 1, whole: bool = True) -> None:
    """Write df as version n, in buckets by keys if there are any. If df is not the whole table, it holds all rows of
    the buckets that it has rows of, and the others stay as they were."""
    spark, version = df.sparkSession, f"v{n:012d}-{uuid.uuid4().hex[:8]}"
    rows = df.withColumn("_bucket", bucket_of(keys, buckets) if keys else F.lit(0))
    rows.write.partitionBy("_bucket").parquet(f"{path}/{version}")
    here = {int(x.split("=")[1]): f"{version}/{x}" for x in scratch.children(spark, f"{path}/{version}") if x.startswith("_bucket=")}
    if not here and whole:  # an empty table still has its columns
        df.write.parquet(f"{path}/{version}/none")
        here = {0: f"{version}/none"}
    where = ({} if whole else placed(spark, path)) | here
    spark.createDataFrame(sorted(where.items()), "bucket int, folder string").coalesce(1).write.parquet(f"{path}/manifest/m{version[1:]}")


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the last manifests, and the folders that those do not name. Readers of older versions must be done."""
    found = manifests(spark, path)
    if len(found) <= keep:
        return
    named = {r["folder"] for m in found[-keep:] for r in spark.read.schema("bucket int, folder string").parquet(m).collect()}
    last = found[-1].rsplit("/m", 1)[1]
    for m in found[:-keep]:
        scratch.remove(spark, m)
    for version in scratch.children(spark, path):
        if version.startswith("v") and version[1:] <= last:
            inside = scratch.children(spark, f"{path}/{version}")
            old = [x for x in inside if x.startswith(("_bucket=", "none")) and f"{version}/{x}" not in named]
            kept = any(f"{version}/{x}" in named for x in inside)
            for x in old if kept else [""]:
                scratch.remove(spark, f"{path}/{version}/{x}" if x else f"{path}/{version}")


def upserted(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target with rows in place of those of equal keys; rows with a null key part are left out."""
    rows = cdc.keyed(rows, keys)
    return cdc.delete_by_key(target, rows.select(*keys).distinct(), keys).unionByName(rows)


def upserted_without_key(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows are told apart by all columns, so that equal ones become one."""
    return target.unionByName(rows).distinct()


def archive_csv(df: DataFrame, path: str) -> None:
    """B6."""
    df.write.option("header", True).csv(path)


def sample(df: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The number of rows and the first n as a JSON array."""
    first = df.orderBy(*order).limit(n).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))).alias("sample")).withColumn("_k", F.lit(1))
    return df.agg(F.count("*").alias("rows")).withColumn("_k", F.lit(1)).join(first, "_k").drop("_k")


def write_to(df: DataFrame, target: str, location: str, table: str = "", **options: str) -> None:
    """Parquet, CSV or JSON folders, or a database by JDBC (location is its url)."""
    if target in ("parquet", "csv", "json"):
        df.write.mode("append").options(**options).format(target).save(location)
    else:
        df.write.mode("append").format("jdbc").options(url=location, dbtable=table, batchsize="10000", **options).save()


def split_rejects(df: DataFrame, wanted: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The rows that can be cast to the wanted types, and the others with the columns at fault; no row is lost."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in wanted.items()]))
    marked = df.withColumn("_rejected", bad)
    good = marked.where(F.size("_rejected") == 0).drop("_rejected").withColumns({c: F.col(c).try_cast(t) for c, t in wanted.items()})
    return good, marked.where(F.size("_rejected") > 0)


def reject_counts(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rejected rows by column at fault."""
    return split_rejects(df, wanted)[1].select(F.explode("_rejected").alias("column_name")).groupBy("column_name").agg(F.count("*").alias("rejected"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
