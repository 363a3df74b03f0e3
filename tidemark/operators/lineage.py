"""Lineage edges from constraints, SQL text and documents (group I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqlscope, sqltext


def edge_key(*parts: str) -> Column:
    """Parts joined by |, with |, line feeds and carriage returns escaped."""
    def safe(c):
        c = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), "\n", r"\\n"), "\r", r"\\r")

    return F.concat_ws("|", *map(safe, parts))


def foreign_keys(constraints: DataFrame) -> DataFrame:
    """I1."""
    fk = constraints.where("kind = 'FK' and ref_table is not null")
    edges = fk.select(F.col("table_name").alias("object_name"), "column_name", F.col("ref_table").alias("target_object_name"), F.col("ref_column").alias("target_column_name"), F.lit("FOREIGN_KEY").alias("relationship_type"), F.lit(1).alias("dependency_level"), F.lit(1.0).alias("confidence_score"))
    return edges.withColumn("edge_key", edge_key("object_name", "column_name", "target_object_name", "relationship_type"))


# Confidence by kind of object.
CONFIDENCE = {"PROCEDURE": 0.8, "VIEW": 0.9, "TRIGGER": 0.85}


def text_references(definitions: DataFrame, *, clean: bool = False) -> DataFrame:
    """An edge for each table that a definition's text names; self-references go. By patterns, or with clean by
    tokens and scopes: then strings, comments and common table expressions name no tables, and quoted names and lists do."""
    parts = sqlscope.scoped_tables(F.col("text")) if clean else F.transform(sqltext.tables(F.col("text")), lambda n: F.split(n, r"\."))
    rows = definitions.select("schema_name", "object_name", "object_type", F.explode(parts).alias("parts"))
    last = lambda n: F.element_at("parts", -n)
    schema = F.when(F.size("parts") > 1, F.get("parts", F.size("parts") - 2)).otherwise(F.col("schema_name"))
    edges = rows.select("schema_name", "object_name", "object_type", schema.alias("target_schema_name"), last(1).alias("target_object_name"))
    score = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("object_type")]
    edges = edges.where(~((F.lower("object_name") == F.lower("target_object_name")) & (F.lower("schema_name") == F.lower("target_schema_name")))).distinct()
    return edges.withColumn("confidence_score", score).withColumn("dependency_level", F.lit(2)).withColumn("edge_key", edge_key("schema_name", "object_name", "target_schema_name", "target_object_name", "object_type"))


def reassembled(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Source text from its lines."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "")
    return lines.groupBy(*keys).agg(text.alias("text"))


def dependencies(rows: DataFrame) -> DataFrame:
    """Rows of a dependency table (object, target, kind) as edges; self-references and unknown kinds go."""
    kinds = {"EXPRESSION": 0.85, "PROCEDURE": 0.95, "TABLE": 0.9}
    score = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("kind")]
    return rows.where(F.col("object_name") != F.col("target_object_name")).withColumn("confidence_score", score).where("confidence_score is not null").distinct()


def document_references(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Fields of documents that look like references: object ids (0.7) and 24 hex digits (0.6)."""
    fields = F.from_json(doc, "map<string,string>")
    rows = docs.select(F.explode(F.map_filter(fields, lambda k, v: k != "_id")).alias("field", "value"))
    kind = F.when(F.get_json_object("value", "$['$oid']").rlike("^[0-9a-fA-F]{24}$"), 0.7).when(F.col("value").rlike("^[0-9a-fA-F]{24}$"), 0.6)
    return rows.withColumn("confidence_score", kind).where("confidence_score is not null").groupBy("field").agg(F.max("confidence_score").alias("confidence_score"), F.count("*").alias("documents"))


def containment(references: DataFrame, ids: DataFrame, *, least: float = 0.5, sample: int = 4096) -> DataFrame:
    """For each reference field the collection that holds its values: field, collection, share of the field's
    different values that the collection has, and how many there are. references: field, value; ids: collection, id.

    About `sample` different values of a field, taken by hash, are looked up in all collections; that tells the likeliest
    one (a share is off by 0.01 or so). Only fields and collections so matched are then joined whole, for the exact
    share. Fields whose best share is below `least` have no row; of equal shares the first collection by name counts."""
    values = references.where("value is not null").select("field", "value").distinct()
    sizes = values.groupBy("field").agg(F.count("*").alias("n_values"))
    unit = F.pmod(F.xxhash64(F.lit(5), "value"), F.lit(1 << 30)) / (1 << 30)
    taken = values.join(sizes, "field").where(unit * F.col("n_values") < sample).select("field", "value")
    of_sample = taken.groupBy("field").agg(F.count("*").alias("m"))
    met = ids.where("id is not null").select("collection", F.col("id").alias("value")).join(taken, "value").select("field", "collection", "value").distinct()
    shares = met.groupBy("field", "collection").agg(F.count("*").alias("hits")).join(of_sample, "field").withColumn("share", F.col("hits") / F.col("m"))
    top = shares.groupBy("field").agg(F.max("share").alias("top"))
    best = shares.join(top, "field").where("share = top").groupBy("field").agg(F.min("collection").alias("collection"))
    whole = values.join(best, "field").join(ids.select("collection", F.col("id").alias("value")).distinct(), ["collection", "value"], "left_semi")
    exact = whole.groupBy("field", "collection").agg(F.count("*").alias("held"))
    return exact.join(sizes, "field").select("field", "collection", (F.col("held") / F.col("n_values")).alias("share"), "n_values").where(F.col("share") >= least)


def view_edges(collections: DataFrame) -> DataFrame:
    """I8: views and the collection that each is on."""
    return collections.where("kind = 'view' and view_on is not null").select(F.col("name").alias("object_name"), F.col("view_on").alias("target_object_name"), F.lit("VIEW_ON").alias("relationship_type"), F.lit(1.0).alias("confidence_score"))


def merged(edges: DataFrame, attributes: list[str], seen: str = "seen_at", order: str = "seen_id") -> DataFrame:
    """One row an edge: when it was first and last seen, and its attributes as last seen."""
    last = F.max_by(F.struct(*attributes), F.struct(seen, order))
    return edges.groupBy("edge_key").agg(F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"), last.alias("_r")).select("edge_key", "first_seen_at", "last_seen_at", "_r.*")


def metrics(edges: DataFrame, as_of: Column) -> DataFrame:
    """I11, I12."""
    objects = edges.select(F.explode(F.array("object_name", "target_object_name")).alias("o")).agg(F.count_distinct("o").alias("distinct_objects")).withColumn("_k", F.lit(1))
    c = F.col("confidence_score")
    one = edges.agg(
        F.count("*").alias("relationships"), F.count_distinct("edge_key").alias("edges"), F.count_if(c >= 0.9).alias("high_confidence"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium_confidence"), F.count_if(c < 0.7).alias("low_confidence"),
        F.round(F.avg(c.cast("decimal(10,4)")).cast("double"), 4).alias("avg_confidence"), F.max("dependency_level").alias("max_level"), F.count_if(F.col("seen_at") >= as_of - F.expr("interval 7 days")).alias("seen_in_week"),
    ).withColumn("_k", F.lit(1))
    return one.join(objects, "_k").drop("_k")


def tree(edges: DataFrame) -> DataFrame:
    """Targets of each object."""
    names = F.array_join(F.array_sort(F.collect_set("target_object_name")), ",")
    return edges.groupBy("object_name", "object_type").agg(F.count_distinct("target_object_name").alias("targets"), F.md5(names).alias("target_list_md5"))


def reachable(edges: DataFrame, hops: int = 3, start: DataFrame | None = None) -> DataFrame:
    """Extension: pairs within so many hops, by joins, distinct after each hop. In a dense graph these can be nearly all
    pairs; start (object_name) asks for those from some objects only and keeps the work to what they reach."""
    base = edges.select(F.col("object_name").alias("a"), F.col("target_object_name").alias("b")).distinct()
    last = base if start is None else base.join(start.select(F.col("object_name").alias("a")).distinct(), "a", "left_semi")
    found = last.withColumn("hops", F.lit(1))
    for h in range(2, hops + 1):
        last = last.join(base.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        found = found.unionByName(last.withColumn("hops", F.lit(h)))
    return found.groupBy("a", "b").agg(F.min("hops").alias("hops"))
