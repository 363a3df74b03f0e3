"""Sensitive columns, classification and access decisions (group G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pii


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where its files make fewer tasks than there are cores; the patterns' work outweighs the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def content(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """Keep, is_pii, is_phi and category of each value; every pattern is tried once at most."""
    v = F.col(value)
    named = df.select(*keep, v, pii.pii_category(v).alias("category"))
    return named.select(*keep, pii.pii_by_content(v, F.col("category")).alias("is_pii"), pii.phi_by_content(v).alias("is_phi"), "category")


def verdicts(df: DataFrame, name: str, *, ratio: float = 0.1) -> DataFrame:
    """A row for each text column: shares of values with personal or health data over all rows, method, category, confidence."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    judged = content(long, "v", keep=["column_name"])
    stats = judged.groupBy("column_name").agg(F.count("*").alias("values"), F.count_if("is_pii").alias("pii_hits"), F.count_if("is_phi").alias("phi_hits"), *[F.count_if(F.col("is_pii") & (F.col("category") == k)).alias(k) for k in CATEGORIES])
    by_content = F.col("pii_hits") > ratio * F.col("values")
    is_pii, phi_content = by_content | pii.pii_by_name(F.col("column_name")), F.col("phi_hits") > ratio * F.col("values")
    is_phi = phi_content | pii.phi_by_name(F.col("column_name"))
    common = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(CATEGORIES)]))
    return stats.select(
        F.lit(name).alias("table_name"), "column_name", "values", "pii_hits", "phi_hits", is_pii.alias("contains_pii"), F.when(is_pii, F.when(by_content, "CONTENT_ANALYSIS").otherwise("NAME_BASED")).alias("pii_method"),
        F.when(is_pii, F.when(F.col("pii_hits") > 0, common["k"]).otherwise("UNKNOWN")).alias("pii_category"), F.when(is_pii, pii.confidence(F.col("column_name"), F.lit(True), by_content)).alias("pii_confidence"),
        is_phi.alias("contains_phi"), F.when(is_phi, F.when(phi_content, 0.85).otherwise(0.60)).alias("phi_confidence"),
    )


CATEGORIES = ["EMAIL", "PHONE", "SSN", "CREDIT_CARD", "ZIP_CODE", "IDENTIFIER"]


def occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """How often each pattern occurs in each text, where it does."""
    counts = [F.struct(F.lit(k).alias("category"), pii.count_of(F.col(text), k).alias("n")) for k in pii.PATTERNS]
    return spread(df.select(key, text)).select(key, F.explode(F.array(*counts)).alias("x")).select(key, "x.category", F.col("x.n").cast("long").alias("n")).where("n > 0")


def classify(tables: DataFrame, rules: DataFrame, kind: str, default: str) -> DataFrame:
    """The label of the first rule of this kind (rule_order) whose keyword the schema or table name holds.

    Rules are a dimension of at most some thousand rows; the check is a nested loop over the broadcast rules."""
    if rules.count() > 10_000:
        raise ValueError("more than 10000 classification rules")
    r = rules.where(F.col("kind") == kind).select("rule_order", "match_on", "keyword", "label")
    subject = F.when(F.col("match_on") == "schema", F.lower("schema_name")).otherwise(F.lower("table_name"))
    hit = tables.join(F.broadcast(r), F.contains(subject, F.lower("keyword")), "left")
    keys = tables.columns
    return hit.groupBy(*keys).agg(F.coalesce(F.min_by("label", "rule_order"), F.lit(default)).alias(kind))


def retention_policy(category: Column, sensitivity: Column) -> Column:
    """G10."""
    return F.when(sensitivity == "CRITICAL", "7_YEARS").when(sensitivity == "HIGH", "5_YEARS").when(category.isin("ANALYTICAL", "SPORTS"), "3_YEARS").when(category == "TRANSACTIONAL", "2_YEARS").otherwise("1_YEAR")


def backup_frequency(category: Column, access: Column) -> Column:
    """G11."""
    return F.when(access.isin("REAL_TIME", "HIGH"), "HOURLY").when(category.isin("TRANSACTIONAL", "MASTER_DATA", "SPORTS"), "DAILY").when(category == "ANALYTICAL", "WEEKLY").otherwise("MONTHLY")


def compliance(sensitivity: Column, domain: Column) -> Column:
    """G12."""
    high = sensitivity.isin("CRITICAL", "HIGH")
    return F.when(domain == "HEALTHCARE", "HIPAA").when(domain == "FINANCE", F.when(high, "SOX,PCI").otherwise("SOX")).when(domain == "SPORTS", F.when(high, "GDPR,PCI,AML").otherwise("GDPR,AML")).otherwise("GDPR")


def table_rollup(columns: DataFrame) -> DataFrame:
    """G13."""
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("contains_pii"), F.col("pii_category")))), ",")
    return columns.groupBy("table_name").agg(F.count_if("contains_pii").alias("pii_columns"), F.count_if("contains_phi").alias("phi_columns"), F.max("pii_confidence").alias("max_confidence"), names.alias("pii_categories"))


def sensitive_rows(rows: DataFrame, sensitive: DataFrame, keys: list[str]) -> DataFrame:
    """Rows about sensitive objects."""
    return rows.join(sensitive.select(*keys).distinct(), keys, "left_semi")


def masking(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """should_mask where the column is sensitive and its table has the policy; allowed unless CRITICAL or HIGH without one."""
    p = policies.select("schema_name", "table_name", "sensitivity_level", "masking_policy_applied")
    joined = rows.join(p, ["schema_name", "table_name"], "left")
    policy = F.coalesce("masking_policy_applied", F.lit(False))
    return joined.withColumn("should_mask", F.col("is_sensitive_data") & policy).withColumn("allowed", ~(F.coalesce("sensitivity_level", F.lit("")).isin("CRITICAL", "HIGH") & ~policy))


def mask_columns(df: DataFrame, columns: list[str], salt: str = "") -> DataFrame:
    """Masked text for the columns that masking() names: a salted hash, so that joins still work."""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in columns})


def catalog_report(columns: DataFrame, by: str) -> DataFrame:
    """G14."""
    return columns.groupBy(by).agg(F.count("*").alias("columns"), F.count_distinct("table_name").alias("tables"), F.count_if("is_pk").alias("key_columns"), F.count_if("is_nullable").alias("nullable_columns"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
