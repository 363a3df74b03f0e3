"""Profiles kept as sketches of files, and duplicates estimated from a sample with its error.

A table that grows by files keeps one row for each file and column: rows, nulls, extremes, sum, and a
HyperLogLog sketch of the values. Sketches merge, and a union of sketches is the sketch of the union, so a profile of the grown
table reads the files that came since and no others. Files that are gone are forgotten."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch

LG_K = 12  # 4,096 registers: a standard error of 1.6 %; up to some hundred values the count is exact


def file_sketches(df: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """file, column_name, rows, nulls, least, greatest, total and sketch of a table read from files; one scan."""
    parts = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        total = F.sum(c.cast("decimal(38,6)")) if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("decimal(38,6)")
        parts += [F.count_if(c.isNull()).alias(f"n{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"), total.cast("decimal(38,6)").alias(f"t{i}"), F.hll_sketch_agg(c.cast("string"), lg_k).alias(f"s{i}")]
    one = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(*parts)
    row = lambda i, f: F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("nulls"), F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("greatest"), F.col(f"t{i}").alias("total"), F.col(f"s{i}").alias("sketch"))
    return one.select("file", "rows", F.explode(F.array(*[row(i, f) for i, f in enumerate(df.schema)])).alias("p")).select("file", "rows", "p.*")


def refresh(spark: SparkSession, table: str, store: str, lg_k: int = LG_K) -> list[str]:
    """Bring the sketches in `store` up to a Parquet folder: sketch its new files and forget those that are gone. The files
    that were read. One writer at a time."""
    here = set(spark.read.parquet(table).inputFiles())
    path = lambda p: p.split(":", 1)[1].lstrip("/") if ":" in p else p.lstrip("/")
    kept = [n for n in scratch.children(spark, store) if n.startswith("s-")]
    held = spark.read.parquet(*[f"{store}/{n}" for n in kept]).select("file").distinct() if kept else None
    known = {path(r["file"]) for r in held.collect()} if held is not None else set()
    new = sorted(f for f in here if path(f) not in known)
    if new:
        schema = spark.read.parquet(table).schema
        file_sketches(spark.read.schema(schema).parquet(*new), lg_k).write.parquet(f"{store}/s-{len(kept):08d}")
    told = {r["file"] for r in spark.read.parquet(f"{store}/gone").collect()} if "gone" in scratch.children(spark, store) else set()
    gone = sorted(known - {path(f) for f in here} - told)
    if gone:
        spark.createDataFrame([(g,) for g in gone], "file string").write.mode("append").parquet(f"{store}/gone")
    return new


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The sketches of the files that the table still has."""
    every = spark.read.parquet(*[f"{store}/{n}" for n in scratch.children(spark, store) if n.startswith("s-")])
    if "gone" not in scratch.children(spark, store):
        return every
    place = F.regexp_replace(F.regexp_replace("file", "^[a-z0-9]+:", ""), "^/+", "")
    return every.withColumn("_p", place).join(spark.read.parquet(f"{store}/gone").select(F.col("file").alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def profile(sketches: DataFrame) -> DataFrame:
    """F1, F2 from sketches: rows, nulls, distinct values and mean of each column."""
    per = sketches.groupBy("column_name", "data_type").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"), F.sum("total").alias("_t"))
    filled = F.col("rows") - F.col("nulls")
    percent = lambda c: F.when(F.col("rows") > 0, F.round(100 * F.col(c) / F.col("rows"), 4)).otherwise(0.0)
    return per.withColumn("mean", F.when(filled > 0, F.col("_t").cast("double") / filled)).withColumns({"null_pct": percent("nulls"), "distinct_pct": percent("distinct_values")}).drop("_t")


def estimated_duplicates(df: DataFrame, columns: list[str] | None = None, *, one_in: int = 10) -> DataFrame:
    """F5 from a sample: total_rows, duplicate_count and standard_error.

    The sample takes one in so many *different* rows (by hash) with all their copies, so that surplus copies are seen as
    they are; a sample of rows would miss most copies. With x surplus copies of each sampled row, the estimate is
    one_in * sum(x), which is right on average, and its standard error sqrt(one_in * (one_in - 1) * sum(x * x))."""
    columns = columns or df.columns
    holes = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("long") * (1 << (i % 62)) for i, c in enumerate(columns)])
    taken = df.where(F.pmod(F.xxhash64(F.lit(11), *[F.col(f"`{c}`") for c in columns], holes), F.lit(one_in)) == 0)
    x = F.col("n") - 1
    found = taken.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(x), F.lit(0)).alias("s"), F.coalesce(F.sum((x * x).cast("double")), F.lit(0.0)).alias("q"))
    return df.agg(F.count("*").alias("total_rows")).withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k").select("total_rows", (F.col("s") * one_in).alias("duplicate_count"), F.sqrt(F.col("q") * one_in * (one_in - 1)).alias("standard_error"))


def duplicates(df: DataFrame, columns: list[str] | None = None, *, above: int = 1_000_000, one_in: int = 10) -> DataFrame:
    """exact surplus copies (standard_error 0) of tables of at most `above` rows, an estimate of larger ones."""
    from .quality import duplicate_rows

    if df.count() > above:
        return estimated_duplicates(df, columns, one_in=one_in)
    return duplicate_rows(df, columns).withColumn("standard_error", F.lit(0.0))
