"""Retention, data subjects, consent, catalog hygiene and glossary (group M), maintenance advice (group N)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import manysearch
from ..sources import scratch

YEARS = [("7_YEARS", 7), ("5_YEARS", 5), ("3_YEARS", 3), ("2_YEARS", 2), ("1_YEAR", 1)]


def legal_hold(as_of: Column) -> Column:
    """M1: held without end, or until a later time."""
    return F.coalesce(F.col("legal_hold") & (F.col("legal_hold_until").isNull() | (F.col("legal_hold_until") > as_of)), F.lit(False))


def policy_years(policy: Column) -> Column:
    return reduce(lambda out, p: out.when(policy.contains(p[0]), p[1]), YEARS, F.when(F.lit(False), 0)).otherwise(0)


def shifted(ts: Column, years: Column) -> Column:
    return ts + F.make_ym_interval(years=years)


def expiration(policy: Column, as_of: Column) -> Column:
    """M2."""
    return shifted(as_of, policy_years(policy))


def retention_plan(gov: DataFrame, as_of: Column, existing: DataFrame | None = None) -> DataFrame:
    """M3: jobs for enforced policies of tables that are not held and have no open job; rows older than cutoff are due."""
    jobs = gov.where(F.col("retention_enforced") & ~legal_hold(as_of)).select("schema_name", "table_name", "retention_policy", F.when(F.upper("retention_policy").contains("ARCHIVE"), "ARCHIVE").otherwise("DELETE").alias("job_type"), shifted(as_of, -policy_years(F.col("retention_policy"))).alias("cutoff"))
    return jobs.join(existing.select("schema_name", "table_name").distinct(), ["schema_name", "table_name"], "left_anti") if existing is not None else jobs


def expire(df: DataFrame, created: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """M4: the rows that stay (those without a date too) and those that expired."""
    old = F.coalesce(F.col(created) < cutoff, F.lit(False))
    return df.where(~old), df.where(old)


def execute(df: DataFrame, created: str, cutoff: Column, *, archive: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that stay and a status row; expired rows go to a CSV folder first if archive names one."""
    keep, gone = expire(df, created, cutoff)
    if archive:
        gone.write.option("header", True).csv(archive)
    return keep, gone.agg(F.count("*").alias("rows_affected")).withColumn("status", F.lit("COMPLETED"))


def subject_columns(columns: DataFrame) -> DataFrame:
    """M6: columns likely to hold a subject's data."""
    return columns.where(F.col("contains_pii") | F.lower("column_name").rlike("email|name|user|person")).select("table_name", "column_name").distinct()


NAME_LETTERS = 200_000  # letters of names that one automaton holds; it is broadcast


def names_held(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """df with each name (_n) that the column holds, whatever its case. An automaton of all names runs once over each
    text; where they have more letters than one may hold, names are dealt to several, each with a run of its own. Only
    rows that hold a name go on."""
    words = names.where(F.length("_n") > 0).select("_n").distinct()
    letters = words.agg(F.sum(F.length("_n"))).first()[0] or 0
    blocks = -(-letters // NAME_LETTERS)
    found = []
    for k in range(blocks):
        find = manysearch.finder(df.sparkSession, [r["_n"] for r in words.where(F.pmod(F.xxhash64("_n"), F.lit(blocks)) == k).collect()])
        found.append(df.withColumn("_n", F.explode(find(F.lower(column)))))
    return reduce(DataFrame.unionByName, found) if found else df.limit(0).withColumn("_n", F.lit(None).cast("string"))


def holding(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """df with the request_id of each name (request_id, _n) that the column holds."""
    return names_held(df, column, names).join(names, "_n").select("request_id", *df.columns)


def sought(requests: DataFrame, *, email: list[str], name: list[str]) -> DataFrame:
    """What each request looks for, once: request_id, _t (the address after e, the name after n, in lower case)."""
    mark = lambda kind, c: requests.where(f"{c} is not null and ('{kind}' = 'e' or {c} <> '')").select("request_id", F.concat(F.lit(kind), F.lower(c)).alias("_t"))
    return reduce(DataFrame.unionByName, ([mark("e", "email")] if email else []) + ([mark("n", "full_name")] if name else [])).distinct()


def subject_rows(df: DataFrame, wanted: DataFrame, *, email: list[str], name: list[str]) -> DataFrame:
    """The rows of df that something wanted finds, equal ones once, with all that finds them (_found)."""
    addresses, names = wanted.where("_t like 'e%'").select("_t").distinct(), wanted.where("_t like 'n%'").select(F.substr("_t", F.lit(2)).alias("_n"))
    met = [df.withColumn("_t", F.concat(F.lit("e"), F.lower(c))).join(addresses, "_t", "left_semi").select(*df.columns, "_t") for c in email]
    met += [names_held(df, c, names).select(*df.columns, F.concat(F.lit("n"), "_n").alias("_t")) for c in name]
    return reduce(DataFrame.unionByName, met).groupBy(*df.columns).agg(F.collect_set("_t").alias("_found"))


CELL = 1024  # rows and requests of one address or name that meet at a time
PAIRS = 16_000_000  # a task


def paired(rows: DataFrame, wanted: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """request_id and columns of rows (told apart by `by`) for what is wanted (request_id, _t, _less): one row for each
    pair that _t finds and _less does not. Where many rows and many requests share a name, both are dealt to cells by their
    hashes, each row to a line of cells and each request to a column of them, so that no task makes all pairs of a name."""
    spark, place = rows.sparkSession, ["_t", "_a", "_b"]
    rows = rows.withColumn("_t", F.explode("_found"))
    sizes = rows.groupBy("_t").agg(F.count("*").alias("_an")).join(wanted.groupBy("_t").agg(F.count("*").alias("_bn")), "_t")
    pairs = sizes.agg(F.sum(F.col("_an").cast("double") * F.col("_bn"))).first()[0] or 0
    large = sizes.withColumns({c: F.ceil(F.col(c) / CELL) for c in ("_an", "_bn")}).where("_an > 1 or _bn > 1")

    def dealt(df: DataFrame, own: str, other: str, key: list[str]) -> DataFrame:
        n, m = (F.coalesce(f"{c}n", F.lit(1).cast("long")) for c in (own, other))
        spread = df.join(large, "_t", "left").withColumn(own, F.pmod(F.xxhash64(*key), n))
        return spread.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), m - 1))).drop("_an", "_bn")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs / PAIRS))
    a = dealt(rows, "_a", "_b", by).select(*place, *columns, "_found").repartition(tasks, *place)
    met = a.join(dealt(wanted, "_b", "_a", ["request_id"]).hint("merge"), place)  # a broadcast of either side leaves all pairs to the other's few tasks
    return met.where("_less is null or not array_contains(_found, _less)").select("request_id", *columns)


def subject_pairs(df: DataFrame, requests: DataFrame, shown: dict[str, Column], *, email: list[str], name: list[str]) -> DataFrame:
    """request_id and what is shown of the rows of df that belong to it. Rows and requests are made unlike before they
    meet, and a request with an address and a name gives a row by the greater of them only where the other does not find
    it, so pairs need no distinct; those of a request_id that looks for more than two things do."""
    spark, wanted = df.sparkSession, sought(requests, email=email, name=name)
    work = scratch.folder(spark, "subjects")
    subject_rows(df, wanted, email=email, name=name).write.parquet(work)  # the search runs once
    staged = spark.read.parquet(work)
    rows = staged.withColumns({f"_s_{c}": x for c, x in shown.items()})
    columns = {f"_s_{c}": c for c in shown}
    each = wanted.groupBy("request_id").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count("*").alias("_n"))
    two = F.filter(F.array(F.struct(F.col("_first").alias("_t"), F.lit(None).cast("string").alias("_less")), F.struct(F.col("_last").alias("_t"), F.col("_first").alias("_less"))), lambda x: x["_less"].isNull() | (x["_less"] < x["_t"]))
    out = paired(rows, each.where("_n <= 2").select("request_id", F.inline(two)), list(columns), df.columns)
    more = each.where("_n > 2").select(F.col("request_id").alias("_r"))
    if not more.isEmpty():
        many = wanted.join(more, F.col("request_id").eqNullSafe(F.col("_r")), "left_semi").withColumn("_less", F.lit(None).cast("string"))
        out = out.unionByName(paired(rows, many, [*df.columns, *columns], df.columns).distinct().select("request_id", *columns))
    return out.withColumnsRenamed(columns)


def subject_matches(df: DataFrame, requests: DataFrame, *, email: list[str], name: list[str]) -> DataFrame:
    """Rows of df that belong to subjects, with request_id: an address column equals the address (whatever its case),
    or a name column holds the name. Requests without both raise no rows. All meet by equi-joins; rows that several
    columns find, or that are equal, come once."""
    return subject_pairs(df, requests, {c: F.col(c) for c in df.columns}, email=email, name=name)


def forget(df: DataFrame, requests: DataFrame, keys: list[str], *, email: list[str], name: list[str]) -> DataFrame:
    """M7: df without the rows of the subjects."""
    gone = subject_rows(df, sought(requests, email=email, name=name), email=email, name=name)
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def export(df: DataFrame, requests: DataFrame, *, email: list[str], name: list[str]) -> DataFrame:
    """M8: the subjects' rows as JSON, which is made once a row, however many requests it belongs to."""
    return subject_pairs(df, requests, {"row": F.to_json(F.struct(*df.columns))}, email=email, name=name)


def pending(requests: DataFrame) -> DataFrame:
    """M9: valid open requests, oldest first."""
    valid = F.col("email").contains("@") & F.col("request_type").isin("ACCESS", "ERASURE", "PORTABILITY")
    return requests.where((F.upper("status") == "PENDING") & F.coalesce(valid, F.lit(False))).orderBy("requested_at", "request_id")


def consent_state(consents: DataFrame, order: str = "event_id") -> DataFrame:
    """M10."""
    when = lambda s: F.max(F.when(F.col("status") == s, F.col("ts")))
    return consents.groupBy("schema_name", "table_name", "subject_id", "consent_type").agg(F.max_by("status", order).alias("status"), when("GIVEN").alias("given_at"), when("WITHDRAWN").alias("withdrawn_at"))


def without_consent(df: DataFrame, state: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows whose subject has not given consent of this kind."""
    valid = state.where((F.col("status") == "GIVEN") & (F.col("consent_type") == kind)).select(F.col("subject_id").alias(key)).distinct()
    return df.join(valid, key, "left_anti")


def orphan_rows(rows: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Rows about tables that the catalog does not have; nulls never hide them."""
    known = catalog.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return rows.join(known, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")


def invalid_entries(catalog: DataFrame, engines: list[str]) -> DataFrame:
    """By reason, the rows that are not usable."""
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = F.when(empty("connection_string"), "NO_CONNECTION").when(~F.coalesce(F.col("db_engine").isin(engines), F.lit(False)), "UNKNOWN_ENGINE").when(empty("schema_name") | empty("table_name"), "NO_NAME")
    return catalog.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("entries"))


def keep_recent(logs: DataFrame, column: str, as_of: Column, hours: int) -> DataFrame:
    """M15."""
    return logs.where(F.col(column) >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def merge_catalog(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """New tables come inactive as FULL_LOAD; a changed key or strategy asks for a full load; else only the size is new."""
    keys = ["schema_name", "table_name", "db_engine"]
    f = found.select(*keys, F.col("pk_columns").alias("_pk"), F.col("pk_strategy").alias("_ps"), F.col("table_size").alias("_size"))
    j = catalog.withColumn("_there", F.lit(True)).join(f, keys, "full_outer")
    new, seen = F.col("_there").isNull(), F.col("_pk").isNotNull()
    changed = seen & ~new & (~F.col("pk_columns").eqNullSafe(F.col("_pk")) | ~F.col("pk_strategy").eqNullSafe(F.col("_ps")))
    return j.select(*keys, F.when(new | changed, "FULL_LOAD").otherwise(F.upper("status")).alias("status"), F.when(new, F.lit(False)).otherwise(F.col("active")).alias("active"), F.coalesce("_pk", "pk_columns").alias("pk_columns"), F.coalesce("_ps", "pk_strategy").alias("pk_strategy"), F.coalesce("_size", "table_size").alias("table_size"))


def activation(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Tables with rows come back, those without go, inactive ones are skipped."""
    j = catalog.join(counts, ["schema_name", "table_name"], "left").withColumn("live", F.coalesce("live_rows", F.lit(0)))
    s = F.upper("status")
    active = F.when((s == "NO_DATA") & (F.col("live") > 0), True).when((s == "NO_DATA") & (F.col("live") == 0), False).otherwise(F.col("active"))
    status = F.when((s == "NO_DATA") & (F.col("live") > 0), "FULL_LOAD").when(~active, "SKIP").otherwise(s)
    return j.select("schema_name", "table_name", status.alias("new_status"), active.alias("new_active"), "live")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """M18."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()])


def glossary_search(terms: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """M19."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns])
    return terms.where(hit)


def term_links(terms: DataFrame) -> DataFrame:
    """One row for each term and related table, by whole names."""
    names = F.filter(F.transform(F.split("related_tables", ","), lambda x: F.trim(x)), lambda x: x != "")
    return terms.select("term_id", "term", F.explode(F.array_distinct(names)).alias("table_name"))


def breach_flags(tables: DataFrame, policies: DataFrame) -> DataFrame:
    """M21."""
    p = policies.select("schema_name", "table_name", (F.col("sensitivity_level") == "CRITICAL").alias("_b"))
    return tables.join(p, ["schema_name", "table_name"], "left").withColumn("breach_notification", F.coalesce("_b", F.lit(False))).drop("_b")


# Maintenance advice (N).
def compaction_needs(stats: DataFrame, as_of: Column) -> DataFrame:
    """Many dead rows, a share over 10 %, or no cleaning in 7 days."""
    share = F.try_divide(100 * F.col("dead_rows"), F.col("live_rows"))
    late = F.col("last_vacuum").isNull() | (F.col("last_vacuum") < as_of - F.expr("interval 7 days"))
    need = (F.col("dead_rows") > 1000) | F.coalesce(share > 10, F.lit(False)) | late
    return stats.where(need).select("schema_name", "table_name", F.lit("VACUUM").alias("maintenance_type"), "fragmentation_pct")


def stale_statistics(stats: DataFrame, as_of: Column) -> DataFrame:
    """N2."""
    return stats.where(F.col("last_analyze").isNull() | (F.col("last_analyze") < as_of - F.expr("interval 1 day"))).select("schema_name", "table_name", F.lit("ANALYZE").alias("maintenance_type"), "fragmentation_pct")


def index_needs(stats: DataFrame) -> DataFrame:
    """N3."""
    f = F.col("fragmentation_pct")
    kind = F.when((f > 30) & (F.col("page_count") > 100), "REBUILD INDEX").when((f > 10) & (F.col("page_count") > 100), "REORGANIZE INDEX").when(f > 30, "REINDEX")
    return stats.withColumn("maintenance_type", kind).where("maintenance_type is not null").select("schema_name", "table_name", "maintenance_type", "fragmentation_pct")


def optimize_needs(stats: DataFrame) -> DataFrame:
    """N4."""
    return stats.where((F.col("free_mb") > 100) | (F.col("fragmentation_pct") > 20)).select("schema_name", "table_name", F.lit("OPTIMIZE TABLE").alias("maintenance_type"), "fragmentation_pct")


def priority(kind: Column, fragmentation: Column) -> Column:
    """N5."""
    vacuum = F.when(fragmentation > 50, 9).when(fragmentation > 30, 7).otherwise(5)
    index = F.when(fragmentation > 50, 8).when(fragmentation > 30, 6).otherwise(5)
    return F.when(kind == "VACUUM", vacuum).when(kind.isin("REINDEX", "REBUILD INDEX"), index).otherwise(5)


def next_date(kind: Column, as_of: Column) -> Column:
    """N6."""
    days = F.when(kind.isin("VACUUM", "OPTIMIZE TABLE"), 7).when(kind.isin("REINDEX", "REBUILD INDEX"), 30).otherwise(1)
    return as_of + F.make_dt_interval(days=days)


def all_needs(stats: DataFrame, as_of: Column) -> DataFrame:
    """N1 to N6 as one task list."""
    tasks = reduce(DataFrame.unionByName, [compaction_needs(stats, as_of), stale_statistics(stats, as_of), index_needs(stats), optimize_needs(stats)])
    return tasks.withColumn("priority", priority(F.col("maintenance_type"), F.col("fragmentation_pct"))).withColumn("next_date", next_date(F.col("maintenance_type"), as_of))


def merge_tasks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tasks by (schema, table, type); a found need renews the task and makes it pending."""
    keys = ["schema_name", "table_name", "maintenance_type"]
    n = new.select(*keys, F.col("priority").alias("_p"), F.col("next_date").alias("_d"))
    j = old.select(*keys, "status", "next_date").join(n, keys, "full_outer")
    return j.select(*keys, F.when(F.col("_p").isNotNull(), "PENDING").otherwise(F.col("status")).alias("status"), F.coalesce("_d", "next_date").alias("next_date"), F.coalesce("_p", F.lit(5)).alias("priority"))


def due(tasks: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    """N8."""
    rows = tasks.where((F.col("status") == "PENDING") & F.col("enabled") & (F.col("next_date") <= as_of)).withColumn("priority", priority(F.col("maintenance_type"), F.col("fragmentation_pct")))
    return rows.orderBy(F.desc("priority"), "next_date", "schema_name", "table_name", "maintenance_type").limit(limit)


def impact(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What a task gained, where both sides have figures above zero."""
    b, a = before.select(*keys, F.col("size_mb").alias("b_size"), F.col("frag").alias("b_frag")), after.select(*keys, F.col("size_mb").alias("a_size"), F.col("frag").alias("a_frag"))
    both = lambda c: (F.col(f"b_{c}") > 0) & (F.col(f"a_{c}") > 0)
    return b.join(a, keys).select(*keys, F.when(both("size"), F.col("b_size") - F.col("a_size")).alias("space_reclaimed_mb"), F.when(both("frag"), F.round(F.col("b_frag") - F.col("a_frag"), 4)).alias("improvement_pct"))


def maintenance_report(tasks: DataFrame) -> DataFrame:
    """N10."""
    return tasks.groupBy("maintenance_type").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.max("next_date").alias("last_date"))
