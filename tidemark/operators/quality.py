"""Column profiles and data quality (group F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def profile(df: DataFrame, *, exact: bool = False) -> DataFrame:
    """a row for each column: rows, nulls, distinct values, smallest, largest and mean of numbers.

    One aggregate over one scan. Distinct values are counted approximately; exact counts of many columns at once make
    Spark expand each row once a column, which exact=True accepts."""
    count = F.count_distinct if exact else F.approx_count_distinct
    parts = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        parts += [F.count_if(c.isNull()).alias(f"n{i}"), count(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        parts.append((F.avg(c.cast("decimal(38,6)")).cast("double") if _numeric(f) else F.lit(None).cast("double")).alias(f"avg{i}"))
    one = df.agg(*parts)
    row = lambda i, f: F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct_values"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), F.col(f"avg{i}").alias("mean"))
    flat = one.select(F.explode(F.array(*[row(i, f) for i, f in enumerate(df.schema)])).alias("p")).select("p.*")
    percent = lambda c: F.when(F.col("rows") > 0, F.round(100 * F.col(c) / F.col("rows"), 4)).otherwise(0.0)
    return flat.withColumn("null_pct", percent("nulls")).withColumn("distinct_pct", percent("distinct_values"))


def null_counts(df: DataFrame) -> DataFrame:
    """null cells of all columns in one pass, for the table."""
    total = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns])
    return df.agg(F.count("*").alias("total_rows"), total.alias("null_count"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """surplus rows among equal ones (nulls equal nulls)."""
    per = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"))


def type_failures(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """by column of expected types, the values that cannot be of that type."""
    counts = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in expected.items()]
    return df.agg(*counts).unpivot([], list(expected), "column_name", "invalid_count").withColumn("expected_type", F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("column_name")])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """rows with a key that no parent has."""
    keys = parent.select(F.col(parent_key).alias("_p")).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, child[key] == keys["_p"], "left_anti")


def score(rows: Column, nulls: Column, duplicates: Column, bad_types: Column, orphan_rows: Column) -> Column:
    """F8: 100 less weighted rates by row, from 0 to 100; an empty table has 100."""
    loss = 20 * nulls / rows + 20 * duplicates / rows + 30 * bad_types / rows + 30 * orphan_rows / rows
    return F.when(rows > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - loss))).otherwise(F.lit(100.0))


def status(value: Column) -> Column:
    """F9."""
    return F.when(value >= 90, "PASSED").when(value >= 70, "WARNING").otherwise("FAILED")


def validate(df: DataFrame, name: str, *, expected: dict[str, str] | None = None, parents: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """one row of metrics. Nulls and types come from one scan, duplicates from one aggregate, references from anti-joins."""
    bad = type_failures(df, expected).agg(F.sum("invalid_count").alias("invalid_type_count")) if expected else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("invalid_type_count"))
    lost = reduce(DataFrame.unionByName, [orphans(df, k, p, pk).agg(F.count("*").alias("n")) for k, p, pk in parents]).agg(F.sum("n").alias("orphans")) if parents else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("orphans"))
    one = lambda d: d.withColumn("_k", F.lit(1))  # noqa: E731  one row each
    row = one(null_counts(df)).join(one(duplicate_rows(df).select("duplicate_count")), "_k").join(one(bad), "_k").join(one(lost), "_k").drop("_k")
    value = score(F.col("total_rows"), F.col("null_count"), F.col("duplicate_count"), F.col("invalid_type_count"), F.col("orphans"))
    out = row.select(F.lit(name).alias("table_name"), "*", F.round(value, 4).alias("quality_score"))
    details = F.to_json(F.struct("null_count", "duplicate_count", "invalid_type_count", "orphans"))
    return out.withColumn("validation_status", status(F.col("quality_score"))).withColumn("details", details)


def validate_all(tables: dict[str, tuple]) -> DataFrame:
    """validate() of every table: name -> (DataFrame, expected, parents)."""
    return reduce(DataFrame.unionByName, [validate(df, name, expected=e, parents=p) for name, (df, e, p) in tables.items()])


def latest_per(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The newest row of each key; max_by keeps one row a key map-side, where a window would sort all."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("_r")).select(*keys, "_r.*")


def governance_nulls(df: DataFrame) -> DataFrame:
    """columns that hold any null, as a percentage of all."""
    flags = [F.max(F.col(f"`{c}`").isNull().cast("int")) for c in df.columns]
    return df.agg(F.round(100 * reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(0)) for f in flags]) / len(df.columns), 4).alias("null_percentage"))


def governance_duplicates(df: DataFrame) -> DataFrame:
    """F14."""
    return duplicate_rows(df).select(F.when(F.col("total_rows") > 0, F.round(100 * F.col("duplicate_count") / F.col("total_rows"), 4)).otherwise(0.0).alias("duplicate_percentage"))


# Weights of the dimension scores.
DIMENSIONS = {"completeness": (0.1, "null"), "accuracy": (0.5, "duplicate"), "consistency": (0.2, "fragmentation"), "validity": (0.3, "null"), "timeliness": (0.1, "fragmentation"), "uniqueness": (0.8, "duplicate"), "integrity": (0.3, "fragmentation")}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def dimension_scores(df: DataFrame) -> DataFrame:
    """F15, F16 over null_, duplicate_ and fragmentation_percentage."""
    pct = {k: F.col(f"{k}_percentage") for k in ("null", "duplicate", "fragmentation")}
    out = df.withColumns({f"{name}_score": F.round(clamp(100 - w * pct[p]), 4) for name, (w, p) in DIMENSIONS.items()})
    return out.withColumn("overall_score", F.round(clamp(100 - 0.5 * pct["null"] - 0.3 * pct["duplicate"] - 0.2 * pct["fragmentation"]), 4))


def check_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rows that break each rule (name, SQL condition), in one pass; unknown counts as broken."""
    counts = [F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules]
    return df.agg(*counts).unpivot([], [n for n, _ in rules], "rule_name", "violations")


def structure(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """by table the number of columns, keys in order, and of constraints by kind."""
    c = columns.groupBy("table_name").agg(F.count("*").alias("columns"), F.count_if("is_nullable").alias("nullable_columns"))
    k = constraints.groupBy("table_name").agg(F.count_if(F.col("kind") == "FK").alias("foreign_keys"), F.count_if(F.col("kind") == "UQ").alias("unique_keys"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "PK", F.struct("position", "column_name")))), lambda x: x["column_name"]), ",").alias("pk_columns"))
    return c.join(k, "table_name", "left")


def column_catalog(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """columns with key flags; one aggregate of the constraints instead of a join for each kind."""
    flags = constraints.groupBy("table_name", "column_name").agg(*[F.bool_or(F.col("kind") == k).alias(n) for k, n in (("PK", "in_pk"), ("FK", "is_fk"), ("UQ", "is_unique"))])
    return columns.join(flags, ["table_name", "column_name"], "left").na.fill(False, ["in_pk", "is_fk", "is_unique"])
