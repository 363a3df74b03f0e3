"""Change data capture (group D): parsing, latest change, apply, snapshot diff, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(log: DataFrame, cursor: int, limit: int | None = None) -> DataFrame:
    """A2: changes after the cursor; with a limit the first so many of them by change_id."""
    out = log.where(F.col("change_id") > cursor)
    return out.orderBy("change_id").limit(limit) if limit else out


def parse(log: DataFrame, keys: str, image: str) -> DataFrame:
    """Typed key and image columns. keys and image are DDL; `has` lists the keys that the image names."""
    k, v = F.from_json("pk_values", keys), F.from_json("row_data", image)
    rest = [c for c in log.columns if c not in ("pk_values", "row_data")]
    parsed = log.select(*rest, k.alias("_k"), v.alias("_v"), F.coalesce(F.json_object_keys("row_data"), F.array().cast("array<string>")).alias("has"))
    return parsed.select(*rest, "_k.*", "_v.*", "has")


def known(changes: DataFrame) -> DataFrame:
    """Changes that insert, update or delete; a null or another operation says nothing about the row."""
    return changes.where(F.col("operation").isin("I", "U", "D"))


def keyed(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes whose key parts are all there."""
    return changes.dropna(subset=keys, how="any")


def latest(changes: DataFrame, keys: list[str], order: str = "change_id") -> DataFrame:
    """The change with the highest order of each key. max_by combines map-side, so hot keys do not meet in one task."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def delete_by_key(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """D3: target without the keys in gone; null parts equal null parts."""
    return target.join(gone, same(target, gone, keys), "left_anti")


def row_hash(columns: list[str]) -> Column:
    """md5 of the columns as text, joined by |, null as nothing. Rows that differ in nulls or bars can share it, so
    it serves as a key of rows without one and decides no equality here."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def delete_by_image(target: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """Target without the rows that equal an image in gone; null equals null and nothing else."""
    images = gone.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(columns)]).distinct()
    return target.join(images, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(columns)]), "left_anti")


def complete(changes: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values whose key is missing from the image come from the source's present row; a JSON null stays null."""
    current = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns])
    joined = changes.join(current, keys, "left")
    filled = {c: F.when(F.array_contains("has", c), F.col(c)).otherwise(F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(filled).drop(*[f"_s_{c}" for c in columns])


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Target after a batch: the last known change of a key decides; one full outer join on the key."""
    last = latest(keyed(known(changes), keys), keys).select(*keys, F.col("operation").alias("_op"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = target.withColumn("_there", F.lit(True)).join(last, keys, "full_outer")
    fresh = F.col("_op").isNotNull()
    return joined.where(~fresh | (F.col("_op") != "D")).select(*keys, *[F.when(fresh, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def apply_versioned(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """apply_changes that may be replayed: target keeps _change_id and _deleted, and older changes do nothing."""
    last = latest(keyed(known(changes), keys), keys)
    rows = last.select(*keys, *columns, F.col("change_id").alias("_change_id"), (F.col("operation") == "D").alias("_deleted"))
    return latest(target.select(*keys, *columns, "_change_id", "_deleted").unionByName(rows), keys, "_change_id")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The change log between two versions: operation, key and image as JSON. Columns and keys are compared
    themselves, null equal to null only."""
    columns = [c for c in new.columns if c not in keys]
    a = old.select(*[F.col(c).alias(f"_o_{c}") for c in [*keys, *columns]], F.lit(True).alias("_old"))
    b = new.select(*keys, *columns, F.lit(True).alias("_new"))
    every = lambda names: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in names], F.lit(True))
    joined = a.join(b, every(keys), "full_outer")
    op = F.when(F.col("_old").isNull(), "I").when(F.col("_new").isNull(), "D").when(~every(columns), "U")
    image = F.when(op != "D", F.to_json(F.struct(*columns)))
    found = joined.withColumn("operation", op).where("operation is not null").withColumn("row_data", image)
    return found.select("operation", "row_data", *[F.when(F.col("_new"), F.col(k)).otherwise(F.col(f"_o_{k}")).alias(k) for k in keys]).select("operation", F.to_json(F.struct(*keys)).alias("pk_values"), "row_data", *keys)


def copies(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Each different row once, with the number of its copies. Copies are combined before the shuffle, however many."""
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """D7 for tables without a key: the rows of which the versions hold different numbers: operation I or D, and copies,
    by how many. Null equals null."""
    columns = new.columns
    a = copies(old.select(*columns), columns, "_a").select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(columns)], "_a")
    both = copies(new, columns, "_b").join(a, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(columns)]), "full_outer")
    more = F.coalesce(F.col("_b"), F.lit(0)) - F.coalesce(F.col("_a"), F.lit(0))
    found = both.select(*[F.when(F.col("_b").isNotNull(), F.col(c)).otherwise(F.col(f"_o{i}")).alias(c) for i, c in enumerate(columns)], more.alias("_more")).where("_more <> 0")
    return found.select(*columns, F.when(F.col("_more") > 0, "I").otherwise("D").alias("operation"), F.abs("_more").alias("copies"))


def numbered(counts: DataFrame, name: str = "copies", block: int = 1000) -> DataFrame:
    """Each row as often as its count says, with nth from 0: together they name an occurrence. Blocks of copies are spread
    before they are unfolded, so that a row with a third of all copies is not one task's."""
    blocks = counts.where(F.col(name) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(name) - 1) / block).cast("long"))))
    first = F.col("_block") * block
    spread = blocks.repartition(*blocks.columns)
    return spread.withColumn("nth", F.explode(F.sequence(first, F.least(F.col(name), first + block) - 1))).drop("_block", name)


def multiset_apply(target: DataFrame, changes: DataFrame) -> DataFrame:
    """B4, D4, D6 for tables without a key: target after changes (its columns, operation, copies): a delete takes as many
    copies as it says, and no more than there are."""
    columns = target.columns
    signed = F.when(F.col("operation") == "D", -F.col("copies")).otherwise(F.col("copies"))
    every = copies(target, columns, "_n").unionByName(changes.where(F.col("operation").isin("I", "D")).select(*columns, signed.alias("_n")))
    return numbered(every.groupBy(*columns).agg(F.sum("_n").alias("copies"))).select(*columns)


def changed_fields(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in both versions that differ, with the names of the columns that do."""
    columns = [c for c in new.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.lit(c)) for c in columns]))
    return new.join(o, keys).withColumn("changed", names).where(F.size("changed") > 0).select(*keys, *columns, "changed")


def reconcile(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Row counts of both sides and what follows from them."""
    s = source.groupBy(*by).agg(F.count("*").alias("source_rows"))
    t = target.groupBy(*by).agg(F.count("*").alias("target_rows"))
    both = s.join(t, by, "full_outer").na.fill(0, ["source_rows", "target_rows"])
    action = F.when(F.col("source_rows") < F.col("target_rows"), "FULL_LOAD").when(F.col("source_rows") > F.col("target_rows"), "INCREMENTAL").otherwise("IN_SYNC")
    return both.withColumn("diff", F.col("source_rows") - F.col("target_rows")).withColumn("next_action", action)


def next_action(tables: DataFrame) -> DataFrame:
    """What to do with each table from status, primary key and the counts of both sides."""
    status = F.upper("status")
    action = (
        F.when(status.isin("FULL_LOAD", "RESET"), "FULL_LOAD").when((F.col("source_rows") == 0) & (F.col("target_rows") == 0), "NO_DATA").when(F.col("source_rows") < F.col("target_rows"), "FULL_LOAD")
        .when(status == "LISTENING_CHANGES", "CDC").when(F.col("source_rows") == F.col("target_rows"), "LISTENING_CHANGES").otherwise("INCREMENTAL")
    )
    return tables.withColumn("next_action", action)


def key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, surplus rows of repeated keys and rows with a null key part, over the whole table."""
    holes = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(holes).alias("hole"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(~F.col("hole"), F.col("n") - 1)), F.lit(0)).alias("surplus"), F.coalesce(F.sum(F.when(F.col("hole"), F.col("n"))), F.lit(0)).alias("null_keys"))
    return out.withColumn("is_key", (F.col("surplus") == 0) & (F.col("null_keys") == 0))


def resync_due(tables: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Full loads and those in progress whose last sync is hours ago or never was."""
    old = F.col("last_sync").isNull() | (F.col("last_sync") <= as_of - F.make_dt_interval(hours=F.lit(hours)))
    return tables.where(F.upper("status").isin("FULL_LOAD", "IN_PROGRESS") & old)


def work_order(tables: DataFrame, per_cycle: int) -> DataFrame:
    """FULL_LOAD, RESET, LISTENING_CHANGES, the rest; so many tables a cycle."""
    rank = F.when(F.upper("status") == "FULL_LOAD", 0).when(F.upper("status") == "RESET", 1).when(F.upper("status") == "LISTENING_CHANGES", 2).otherwise(3)
    return tables.withColumn("work_rank", rank).orderBy("work_rank", "schema_name", "table_name").limit(per_cycle)


def apply_statistics(log: DataFrame, batch: Column) -> DataFrame:
    """Changes, upserts, deletes and the cursor of every table and batch."""
    op = F.col("operation")
    return log.groupBy("schema_name", "table_name", batch.alias("batch")).agg(F.count("*").alias("changes"), F.count_if(op != "D").alias("upserts"), F.count_if(op == "D").alias("deletes"), F.max("change_id").alias("cursor"))
