"""Sources (group A): tables, documents, JSON bodies, queries and script rows."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A1: a Parquet table; columns and condition reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A1: a database table in ranges of its key, read side by side instead of by growing offsets."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), fetchsize="10000", **options).load()


def literal(value) -> str:
    """A value in SQL; dates and times in the form that JDBC drivers translate."""
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, datetime.datetime):
        return "{ts '" + value.isoformat(" ") + "'}"
    return "{d '" + value.isoformat() + "'}" if isinstance(value, datetime.date) else str(value)


def up_to(keys: list[str], bound: tuple) -> str:
    """The rows whose key is not after the bound, part by part."""
    head, value = keys[0], literal(bound[0])
    return f"{head} <= {value}" if len(keys) == 1 else f"({head} < {value} OR ({head} = {value} AND {up_to(keys[1:], bound[1:])}))"


def even_predicates(keys: list[str], bounds: list[tuple]) -> list[str]:
    """Conditions that deal the rows to len(bounds) + 1 parts: each row to the first bound that it is not after. Every row is
    in one part, even where the database orders text otherwise than Python; the first part has null keys as well."""
    if not bounds:
        return ["1 = 1"]
    under = [up_to(keys, b) for b in bounds]
    text = any(isinstance(v, str) for v in bounds[0])
    before = lambda i: [f"NOT ({u})" for u in (under[:i] if text else under[max(0, i - 1) : i])]
    nulls = " OR ".join(f"{k} IS NULL" for k in keys)
    parts = [" AND ".join([*before(i), f"({u})"]) for i, u in enumerate(under)] + [" AND ".join(before(len(under)))]
    return [f"(({parts[0]}) OR {nulls})", *[f"(({p}) AND NOT ({nulls}))" for p in parts[1:]]]


def key_bounds(spark: SparkSession, url: str, table: str, keys: list[str], partitions: int, per_part: int = 200, **options: str) -> list[tuple]:
    """Bounds of parts with about equally many rows, from one pass over the keys: a uniform sample of so many a part."""
    seen = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT {', '.join(keys)} FROM {table}) k", fetchsize="10000", **options).load().dropna()
    sample = sorted(tuple(r) for r in seen.orderBy(F.rand(7)).limit(per_part * partitions).collect())
    cuts = [sample[len(sample) * i // partitions] for i in range(1, partitions)] if sample else []
    return list(dict.fromkeys(c for c in cuts if c != sample[-1]))


def read_jdbc_even(spark: SparkSession, url: str, table: str, *, keys: list[str], partitions: int, **options: str) -> DataFrame:
    """A1: a database table in parts of about equally many rows, whatever the keys' type and spread; composite keys too."""
    bounds = key_bounds(spark, url, table, keys, partitions, **options)
    return spark.read.options(fetchsize="10000", **options).jdbc(url, table, predicates=even_predicates(keys, bounds))


def fields(docs: DataFrame, doc: str, order: str) -> DataFrame:
    """All keys of all documents, in the order in which they are first seen (by order, then place)."""
    keys = docs.select(order, F.posexplode(F.json_object_keys(doc)).alias("place", "field"))
    return keys.groupBy("field").agg(F.min(F.struct(order, "place")).alias("_f"), F.count("*").alias("documents")).select("field", F.col("_f")[order].alias("first_seen"), F.col("_f")["place"].alias("place"), "documents")


def inferred_types(docs: DataFrame, doc: str) -> DataFrame:
    """The widest type of each key over all documents: integers widen to NUMERIC, mixtures and long text to TEXT."""
    raw = F.from_json(doc, "map<string,variant>")
    kind = F.schema_of_variant(F.col("value"))
    text = F.try_variant_get("value", "$", "string")
    rows = docs.select(F.explode(raw).alias("field", "value")).select("field", F.when(kind == "BIGINT", "BIGINT").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "NUMERIC").when(kind == "BOOLEAN", "BOOLEAN").when(kind == "STRING", F.when(F.length(text) > 255, "TEXT").otherwise("VARCHAR(255)")).when(kind == "VOID", "NULL").otherwise("JSONB").alias("kind"))
    kinds = rows.groupBy("field").agg(F.collect_set(F.when(F.col("kind") != "NULL", F.col("kind"))).alias("k"))
    one = lambda *names: F.size(F.array_except("k", F.array(*map(F.lit, names)))) == 0
    return kinds.select("field", F.when(F.size("k") == 0, "TEXT").when(F.size("k") == 1, F.col("k")[0]).when(one("BIGINT", "NUMERIC"), "NUMERIC").otherwise("TEXT").alias("sql_type"))


# SQL types of the leaves of a type tree.
LEAVES = {"BIGINT": "BIGINT", "TINYINT": "BIGINT", "SMALLINT": "BIGINT", "INT": "BIGINT", "DOUBLE": "NUMERIC", "FLOAT": "NUMERIC", "BOOLEAN": "BOOLEAN", "STRING": "TEXT", "VOID": "TEXT", "VARIANT": "JSONB", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP"}
TREE = re.compile(r"(OBJECT|ARRAY)<|`((?:[^`]|``)*)`\s*:|([^\s:,<>]+)\s*:|([A-Z][A-Z_]*(?:\([^)]*\))?)|([>,])|\s+")


def tree_paths(schema: str | None) -> list[tuple[str, str]]:
    """(path, sql_type) of a type tree such as OBJECT<a: BIGINT, b: ARRAY<OBJECT<c: STRING>>>: a, b[] and b[].c."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # (kind, path) of what is open
    path = ""
    at = 0
    while schema and at < len(schema):
        m = TREE.match(schema, at)
        if not m:
            raise ValueError(f"not a type tree at {at}: {schema[at : at + 40]}")
        at = m.end()
        if m[1]:
            if path:
                out.append((path, "JSONB"))
            stack.append((m[1], path))
            path = f"{path}[]" if m[1] == "ARRAY" else path
        elif m[2] is not None or m[3]:
            name = m[2].replace("``", "`") if m[2] is not None else m[3]
            above = stack[-1][1] + ("[]" if stack[-1][0] == "ARRAY" else "")
            path = f"{above}.{name}" if above else name
        elif m[4]:
            if path:
                out.append((path, "NUMERIC" if m[4].startswith("DECIMAL") else LEAVES.get(m[4], "TEXT")))
        elif m[5] == ">":
            path = stack.pop()[1]
    return out


def nested_types(docs: DataFrame, doc: str) -> DataFrame:
    """Path and type of every field at any depth over all documents. Types of a path are merged as they are
    aggregated, before the shuffle and in any order: whole numbers widen to numbers, objects unite their fields, arrays
    unite their items; kinds that do not mix make JSONB. Documents that are not JSON say nothing."""
    tree = docs.agg(F.schema_of_variant_agg(F.try_parse_json(doc)).alias("t")).first()[0]
    found = sorted(set(tree_paths(tree)))
    return docs.sparkSession.createDataFrame(found, "path string, sql_type string")


def flatten(docs: DataFrame, doc: str, names: list[str], keep: list[str] = ()) -> DataFrame:
    """A4: scalar fields as text (object ids and dates unwrapped, nested values null), and the whole in _document."""
    def one(name: str) -> Column:
        v = F.get_json_object(doc, f"$['{name}']")
        oid = F.get_json_object(v, "$['$oid']")
        date = F.get_json_object(v, "$['$date']")
        when = F.date_format(F.coalesce(F.timestamp_millis(date.try_cast("bigint")), F.try_to_timestamp(date)), "yyyy-MM-dd HH:mm:ss")
        return F.when(v.startswith("{") | v.startswith("["), F.coalesce(oid, when)).otherwise(v).alias(name)

    return docs.select(*keep, *map(one, names), F.col(doc).alias("_document"))


def payload_rows(bodies: DataFrame, body: str, keep: list[str] = ()) -> DataFrame:
    """A5: one JSON record a row: of the array, of .data, of .results, or the object itself."""
    items = lambda c: F.from_json(c, "array<string>")
    c = F.col(body)
    array = F.coalesce(F.when(F.ltrim(c).startswith("["), items(c)), items(F.get_json_object(c, "$.data")), items(F.get_json_object(c, "$.results")), F.when(F.ltrim(c).startswith("{"), F.array(c)))
    return bodies.select(*keep, F.posexplode(array).alias("place", "record"))


def run_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Rows of a query over DataFrames, named {like_this} in it."""
    return spark.sql(sql, **tables)


def find(df: DataFrame, condition: dict[str, object]) -> DataFrame:
    """A10: rows whose columns equal the values; None finds nulls."""
    for name, value in condition.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return df


def script_rows(inputs: DataFrame, script: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows that a Python function makes of each input row, where the rows are. It is given and gives dicts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([out for row in batch.to_dict("records") for out in script(row)], columns=names)

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return inputs.mapInPandas(run, schema)


# Schemas of database systems themselves.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "pg_temp_1", "pg_toast_temp_1", "mysql", "performance_schema", "sys", "guest", "admin", "local", "config")


def folder_tables(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """table_name and columns of every table in a folder, in any store that Spark reads; schemas only, no rows."""
    found = [(n.removesuffix(suffix), len(spark.read.parquet(f"{folder}/{n}").columns)) for n in sorted(scratch.children(spark, folder)) if n.endswith(suffix)]
    return spark.createDataFrame(found, "table_name string, columns long")


def catalog_tables(spark: SparkSession, exclude: tuple[str, ...] = SYSTEM_SCHEMAS) -> DataFrame:
    """schema_name, table_name and kind of the catalog's tables and views, without those of system schemas."""
    schemas = [d.name for d in spark.catalog.listDatabases() if d.name.lower() not in exclude]
    found = [(s, t.name, t.tableType) for s in schemas for t in spark.catalog.listTables(s) if not t.isTemporary]
    return spark.createDataFrame(sorted(found), "schema_name string, table_name string, kind string")
