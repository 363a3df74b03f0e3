"""What SQL text says of itself: features, operation, category, fingerprint (J2 to J5) and table names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLES = r"(?i)(?:^|[^0-9A-Za-z_])(?:FROM|JOIN|INTO|UPDATE)\s+((?:[0-9A-Za-z_]+\.)?[0-9A-Za-z_]+)"


def any_of(q: Column, *parts: str) -> Column:
    out = q.contains(parts[0])
    for p in parts[1:]:
        out |= q.contains(p)
    return out


def features(text: Column) -> dict[str, Column]:
    """J2."""
    q = F.lower(text)
    return {
        "has_joins": any_of(q, " join ", "inner join", "left join", "right join"), "has_subqueries": any_of(q, "(select", "( select"), "has_cte": q.contains("with ") & q.contains(" as ("), "has_window": any_of(q, "over (", "row_number()", "rank()"),
        "has_functions": any_of(q, "count(", "sum(", "avg(", "max(", "min("), "tables_count": F.regexp_count(q, F.lit(r"(?:^|[^0-9a-z_])from\s+[0-9a-z_]+|join\s+[0-9a-z_]+")).cast("long"),
    }


def operation(text: Column) -> Column:
    """J3."""
    word = F.upper(F.regexp_extract(text, r"^(?i)(select|insert|update|delete|create|alter|drop)", 1))
    return F.when(word != "", word).otherwise("UNKNOWN")


def category(text: Column) -> Column:
    """J4."""
    q = F.lower(text)
    select = F.when(any_of(q, "count", "sum", "avg"), "ANALYTICS").when(q.contains("join"), "JOIN_QUERY").otherwise("SELECT")
    out = F.when(q.startswith("select"), select)
    for w in ("insert", "update", "delete"):
        out = out.when(q.startswith(w), w.upper())
    return out.when(q.rlike("^(create|alter|drop)"), "DDL").otherwise("OTHER")


def fingerprint(text: Column, collapse: bool = False) -> Column:
    """Whole numbers become ?, strings '?'; lower case; white space as it is unless collapsed."""
    out = F.regexp_replace(text, r"(?<![0-9A-Za-z_])[0-9]+(?![0-9A-Za-z_])", "?")
    out = F.lower(F.regexp_replace(out, "'[^']*'", "'?'"))
    return F.trim(F.regexp_replace(out, r"\s+", " ")) if collapse else out


def tables(text: Column) -> Column:
    """Names after FROM, JOIN, INTO and UPDATE, lower case; sqlscope tells them from strings and comments."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TABLES), 1), F.lower))
