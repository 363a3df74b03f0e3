"""Value cleaning, naming and parsing as Column expressions (groups C and A9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Null tokens, sentinel dates and defaults of the replication rules.
NULL_TOKENS = {"mariadb": ["", "NULL", "null", r"\N", r"\0"], "mssql": ["", "NULL", "null", r"\N", r"\0"], "oracle": ["", "NULL", "null"], "mongo": ["", "NULL", "null"]}
SENTINELS = r"0000-|1900-01-01|1970-01-01"
TRUE_WORDS, FALSE_WORDS = ["Y", "1", "true", "TRUE"], ["N", "0", "false", "FALSE"]
DEFAULTS = {
    "mariadb": [("INTEGER|BIGINT|SMALLINT", "0"), ("REAL|FLOAT|DOUBLE|NUMERIC", "0.0"), ("VARCHAR|TEXT|CHAR", "DEFAULT"), ("TIMESTAMP|DATETIME", "1970-01-01 00:00:00"), ("DATE", "1970-01-01"), ("TIME", "00:00:00"), ("", "DEFAULT")],
    "mssql": [("INTEGER|BIGINT|SMALLINT", "0"), ("REAL|FLOAT|DOUBLE|NUMERIC", "0.0"), ("VARCHAR|TEXT|CHAR", ""), ("TIMESTAMP|DATETIME", "1970-01-01 00:00:00"), ("DATE", "1970-01-01"), ("TIME", "00:00:00"), ("BOOL", "false"), ("", "DEFAULT")],
    "oracle": [("INTEGER|NUMERIC|REAL|DOUBLE", "0"), ("TIMESTAMP|DATE", "1970-01-01 00:00:00"), ("BOOLEAN", "false"), ("", "")],
    "mongo": [("INTEGER|BIGINT", "0"), ("NUMERIC|REAL", "0.0"), ("BOOLEAN", "false"), ("", "NULL")],
}
MAX_BINARY = 1000


def _is(pg_type: str, names: str) -> bool:
    return any(n in pg_type.upper() for n in names.split("|"))


def strip_controls(c: Column) -> Column:
    """Control characters go, but for tab, line feed and carriage return."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def ascii_only(c: Column) -> Column:
    """Characters beyond ASCII become question marks."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def null_rule(c: Column, pg_type: str, dialect: str, strict: bool) -> Column:
    """Whether the dialect's rules call the value null. Safe mode keeps UTF-8, sentinel text and midnight."""
    rule = c.isNull() | c.isin(NULL_TOKENS[dialect])
    dated = _is(pg_type, "TIMESTAMP|DATE")
    if dialect in ("mariadb", "mssql"):
        if strict:
            rule |= c.rlike(SENTINELS) | c.rlike(r"[^\x20-\x7F]")
        if dated:
            rule |= (F.length(c) < 10) | ~c.contains("-") | c.contains("0000") | c.contains("-00")
            if strict:
                rule |= c.contains(" 00:00:00")
            else:
                rule |= c.rlike(SENTINELS)
    elif dialect == "oracle" and dated:
        rule |= c.rlike(SENTINELS)
    if dialect == "mariadb" and _is(pg_type, "BYTEA|BLOB|BIT"):
        rule |= c.rlike(r"[^0-9A-Fa-f \\x]")
    return rule


def clean(c: Column, pg_type: str, dialect: str = "mariadb", strict: bool = False) -> Column:
    """C1 to C4. strict gives the defaults of the dialect for nulls; otherwise null is null."""
    value = c
    if dialect == "mariadb" and _is(pg_type, "BYTEA|BLOB|BIT"):
        value = F.substring(value, 1, MAX_BINARY)
    if dialect in ("mssql", "mongo"):
        value = strip_controls(value)
    if dialect == "mssql" and _is(pg_type, "BOOL|BIT"):
        skip = ["Y", "N"] if not _is(pg_type, "BOOL") else []
        value = F.when(value.isin([w for w in FALSE_WORDS if w not in skip]), "false").when(value.isin([w for w in TRUE_WORDS if w not in skip]), "true").otherwise(value)
    default = next(v for names, v in DEFAULTS[dialect] if not names or _is(pg_type, names))
    return F.when(null_rule(c, pg_type, dialect, strict), F.lit(default if strict else None).cast("string")).otherwise(value)


def valid_log_text(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Bytes that are not UTF-8 are replaced; rows with a longer text than its limit go. Nulls stay."""
    df = df.withColumns({c: F.make_valid_utf8(F.col(c)) for c in limits})
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.length(c) <= n, F.lit(True)) for c, n in limits.items()]))


def identifier(c: Column) -> Column:
    """Trimmed, only letters, digits and _$#, lower case, 128 at most; null if empty or led by a digit."""
    name = F.substring(F.lower(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_$#]", "")), 1, 128)
    return F.when((name != "") & ~name.rlike("^[0-9]"), name)


def with_identifiers(df: DataFrame) -> DataFrame:
    """All columns renamed by the identifier rule (C7); clashes get a number."""
    import re

    names: list[str] = []
    for raw in df.columns:
        name = re.sub(r"[^A-Za-z0-9_$#]", "", raw.strip()).lower()[:128] or "c"
        name = f"c{name}" if name[0].isdigit() else name
        base, n = name, 2
        while name in names:
            name, n = f"{base}_{n}", n + 1
        names.append(name)
    return df.toDF(*names)


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """New name from old name; entries without a source column are left out. An empty mapping keeps all."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in mapping.items() if old in df.columns]) if mapping else df


TYPES = {
    "int": "INTEGER", "integer": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "SMALLINT", "decimal": "NUMERIC", "numeric": "NUMERIC", "number": "NUMERIC", "money": "NUMERIC(19,4)", "smallmoney": "NUMERIC(10,4)",
    "float": "REAL", "real": "REAL", "double": "DOUBLE PRECISION", "char": "TEXT", "nchar": "TEXT", "varchar": "VARCHAR", "text": "TEXT", "json": "JSON", "blob": "BYTEA", "varbinary": "BYTEA", "bit": "BIT", "boolean": "BOOLEAN", "bool": "BOOLEAN",
    "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "datetimeoffset": "TIMESTAMPTZ", "date": "DATE", "time": "TIME", "uniqueidentifier": "UUID",
}
SPARK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "NUMERIC": "decimal(38,18)", "NUMERIC(19,4)": "decimal(19,4)", "NUMERIC(10,4)": "decimal(10,4)", "REAL": "float", "DOUBLE PRECISION": "double", "BYTEA": "binary", "BOOLEAN": "boolean", "BIT": "boolean", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "DATE": "date"}


def target_type(source: Column) -> Column:
    """The PostgreSQL name of a source type such as varchar(40); lengths are kept from 1 to 65535, all else is TEXT."""
    base, length = F.lower(F.regexp_extract(source, r"^\s*([A-Za-z]+)", 1)), F.regexp_extract(source, r"\(\s*(\d+)", 1).try_cast("int")
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[base]
    return F.when((known == "VARCHAR") & length.between(1, 65535), F.concat(F.lit("VARCHAR("), length.cast("string"), F.lit(")"))).otherwise(F.coalesce(known, F.lit("TEXT")))


def spark_type(pg_type: str) -> str:
    """The Spark type of a PostgreSQL name; text for what is not known."""
    return SPARK_TYPES.get(pg_type.upper(), "string")


ENVIRONMENTS = [("PRODUCTION", "prod|production"), ("STAGING", "staging|stage"), ("DEVELOPMENT", "dev|development"), ("TESTING", "test|testing"), ("LOCAL", "local|localhost")]


def cluster_name(host: Column) -> Column:
    """Environment by a name part between - _ . marks, then by uat, qa, cluster..., db-..., else the host in capitals."""
    low = F.lower(host)
    out = F.when(host == "", "")
    for name, words in ENVIRONMENTS:
        out = out.when(low.rlike(rf"(^|[-_.])({words})($|[-_.])"), name)
    out = out.when(low.contains("uat"), "UAT").when(low.contains("qa"), "QA")
    for word in ("cluster", "db-"):
        out = out.when(low.contains(word), F.upper(F.regexp_extract(low, rf"({word}.*)$", 1)))
    return out.otherwise(F.upper(host))


def host_from_connection(c: Column) -> Column:
    """host= or server= of a key list, else the host of a url; null if there is none."""
    key = F.regexp_extract(c, r"(?i)(?:^|[;\s])(?:host|server)\s*=\s*([^;,\s:]+)", 1)
    url = F.regexp_extract(c, r"^[A-Za-z+]+://(?:[^@/]*@)?([^:/,?]+)", 1)
    return F.coalesce(F.nullif(key, F.lit("")), F.nullif(url, F.lit("")))


def redacted(c: Column) -> Column:
    """C14: passwords in connection strings."""
    return F.regexp_replace(c, r"(?i)(password|pwd)=[^; ]*", "$1=***")


def string_array(c: Column) -> Column:
    """The strings of a JSON array; anything else gives an empty array."""
    items = F.filter(F.from_json(c, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def coerced(c: Column) -> dict[str, Column]:
    """Text as boolean, whole number or double by its look; the columns kind, as_bool, as_long, as_double."""
    kind = F.when(c.isin("t", "f", "true", "false"), "bool").when(c.contains(".") & c.try_cast("double").isNotNull(), "double").when(c.try_cast("bigint").isNotNull() & ~c.contains("."), "long").when(c.isNotNull(), "string")
    return {"kind": kind, "as_bool": F.when(kind == "bool", c.isin("t", "true")), "as_long": F.when(kind == "long", c.try_cast("bigint")), "as_double": F.when(kind == "double", c.try_cast("double"))}
