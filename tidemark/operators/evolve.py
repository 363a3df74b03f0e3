"""Schema evolution (group E) and discovery of keys and time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that tell when a row was made or changed, the likeliest first.
TIME_COLUMNS = ["updated_at", "modified_at", "last_modified", "updated_time", "created_at", "created_time", "timestamp"]


def compatible(old: Column, new: Column) -> Column:
    """Whether a column of the old type may become one of the new type without a reload."""
    a, b = F.upper(old), F.upper(new)
    # Patterns of an old and a new type that fit together.
    pairs = [("CHAR", "CHAR"), ("NUMERIC", "NUMERIC"), ("INTEGER", "BIGINT"), ("SMALLINT", "INTEGER|BIGINT"), ("TIME", "TIME"), ("TEXT", "CHAR|TEXT"), ("CHAR", "TEXT"), ("JSONB", "TEXT|VARCHAR|JSONB"), ("TEXT|VARCHAR", "JSONB")]
    out = a == b
    for x, y in pairs:
        out |= a.rlike(x) & b.rlike(y)
    return out


def schema_diff(source: DataFrame, target: DataFrame, table: str = "table_name") -> DataFrame:
    """One row for each column to add, drop or modify; names are compared in lower case."""
    side = lambda df, p: df.select(table, F.lower("column_name").alias("column_name"), F.col("pg_type").alias(f"{p}_type"), F.col("is_nullable").alias(f"{p}_nullable"), F.col("is_pk").alias(f"{p}_pk"))
    both = side(source, "new").join(side(target, "old"), [table, "column_name"], "full_outer")
    action = F.when(F.col("old_type").isNull(), "ADD").when(F.col("new_type").isNull(), "DROP").when((F.upper("old_type") != F.upper("new_type")) | (F.col("old_nullable") != F.col("new_nullable")), "MODIFY")
    return both.withColumn("action", action).where("action is not null").withColumn("compatible", F.when(F.col("action") == "MODIFY", compatible(F.col("old_type"), F.col("new_type"))).otherwise(F.lit(True)))


def evolution_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """By table, how many columns change, and whether it is refused because a key column would go."""
    d = schema_diff(source, target)
    is_ = lambda a: F.col("action") == a
    return d.groupBy("table_name").agg(
        F.count_if(is_("ADD")).alias("added"), F.count_if(is_("DROP")).alias("dropped"), F.count_if(is_("MODIFY") & F.col("compatible")).alias("modified"), F.count_if(is_("MODIFY") & ~F.col("compatible")).alias("skipped"),
        F.bool_or(is_("DROP") & F.coalesce("old_pk", F.lit(False))).alias("refused"),
    )


def evolve(df: DataFrame, wanted: list[tuple[str, str]], *, keys: list[str] = (), defaults: dict[str, object] | None = None, compatible_types=None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """E3 to E6 on a DataFrame: add, drop and cast columns to `wanted` (name, Spark type); also the report.

    A cast that Spark cannot do, or that compatible_types(old, new) denies, is skipped. Dropping a key raises."""
    defaults, report = defaults or {}, []
    have = {f.name.lower(): f for f in df.schema}
    names = [n.lower() for n, _ in wanted]
    if lost := [k for k in keys if k.lower() not in names]:
        raise ValueError(f"key columns would be dropped: {', '.join(lost)}")
    columns = []
    for name, kind in ((n.lower(), t) for n, t in wanted):
        if name not in have:
            columns.append(F.lit(defaults.get(name)).cast(kind).alias(name))
            report.append((name, "ADD", kind))
            continue
        old = have[name].dataType.simpleString()
        if old == kind or (compatible_types and not compatible_types(old, kind)):
            columns.append(F.col(f"`{have[name].name}`").alias(name))
            report += [(name, "SKIP", f"{old} to {kind}")] if old != kind else []
        else:
            columns.append(F.col(f"`{have[name].name}`").try_cast(kind).alias(name))
            report.append((name, "MODIFY", f"{old} to {kind}"))
    report += [(n, "DROP", f.dataType.simpleString()) for n, f in have.items() if n not in names]
    return df.select(*columns), report


def nullability(df: DataFrame) -> DataFrame:
    """For each column whether any value is null, in one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "null_count").withColumn("can_be_not_null", F.col("null_count") == 0)


def count_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables whose numbers of columns differ are reset to a full load."""
    n = lambda df, a: df.groupBy("table_name").agg(F.count("*").alias(a))
    return n(source, "source_columns").join(n(target, "target_columns"), "table_name").where("source_columns <> target_columns").withColumn("new_status", F.lit("FULL_LOAD"))


def late_fields(df: DataFrame, fields: list[str], document: str = "_document") -> DataFrame:
    """Only fields that the target has, those missing as null, and always the document."""
    return df.select(*[(F.col(f) if f in df.columns else F.lit(None).cast("string")).alias(f) for f in dict.fromkeys([*fields, document])])


def time_column(columns: DataFrame, priority: list[str] = TIME_COLUMNS) -> DataFrame:
    """The first of the usual time columns that a table has."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.lower("column_name"))
    return columns.where(rank > 0).groupBy("table_name").agg(F.min_by("column_name", rank).alias("time_column"))


def primary_keys(constraints: DataFrame) -> DataFrame:
    """Key columns in the order of their positions."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    return constraints.where("kind = 'PK'").groupBy("table_name").agg(F.array_join(F.transform(ordered, lambda x: x["column_name"]), ",").alias("pk_columns"))
