"""Digest trees (D7, D15, D20): two versions of a table compared by sums of row hashes.

A row's key puts it in one of 2^bits leaves. A leaf's digest is its number of rows and four sums over two 64-bit
hashes of each row, so that digests of parts of a table add up, whatever the order of rows, and are combined before any
shuffle. 256 leaves make a node, 256 nodes the next, up to the root. Two trees are compared from the root
on, and below a node only where it differs; rows are read again in the leaves that differ and nowhere else.
store() lays a table out by leaves beside its tree, so that equal parts are not even opened.

Nulls are told apart from each other's places and from empty texts. Equal digests of different leaves would
need a collision of 128 bits."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import scratch
from . import cdc

BITS, FAN = 16, 8  # leaves as a power of two; bits of a node's number that its parent drops
PARTS = 6  # bits of a leaf that name its folder
SUMS = ["n", "s0", "s1", "s2", "s3"]


def hashed(columns: list[str], seed: int) -> Column:
    """A 64-bit hash of the columns in which each null counts with its place."""
    holes = [reduce(Column.__add__, [F.col(c).isNull().cast("long") * F.lit(1 << i) for i, c in enumerate(columns[a : a + 62])]) for a in range(0, len(columns), 62)]
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], *holes)


def leaf(keys: list[str], bits: int = BITS) -> Column:
    return hashed(keys, 1).bitwiseAND((1 << bits) - 1).cast("int")


def sums(columns: list[str]) -> list[Column]:
    """The digest of a group of rows: its count, and sums of the halves of two hashes (no overflow below 2^31 rows)."""
    halves = [half for seed in (2, 3) for h in [hashed(columns, seed)] for half in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    return [F.count("*").alias("n"), *[F.sum(h).alias(s) for h, s in zip(halves, SUMS[1:], strict=True)]]


def leaves(df: DataFrame, keys: list[str], columns: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """node, n and sums of the lowest level. columns: what rows are compared by, all by default."""
    return df.groupBy(leaf(keys, bits).alias("node")).agg(*sums(columns or df.columns))


def added(*digests: DataFrame) -> DataFrame:
    """The leaves of a table from those of its parts."""
    return reduce(DataFrame.unionByName, digests).groupBy("node").agg(*[F.sum(s).alias(s) for s in SUMS])


def tree(lowest: DataFrame, bits: int = BITS) -> DataFrame:
    """All levels (level, node, n, sums): level 0 is the root, the last one the leaves."""
    levels, at = [lowest.withColumn("level", F.lit(-(-bits // FAN)))], lowest
    for level in reversed(range(-(-bits // FAN))):
        at = at.groupBy(F.shiftright("node", FAN).alias("node")).agg(*[F.sum(s).alias(s) for s in SUMS])
        levels.append(at.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, levels).select("level", "node", *SUMS)


def differing(a: DataFrame, b: DataFrame, bits: int = BITS) -> list[int]:
    """The leaves in which two trees differ, from the root down; at most 2^bits numbers."""
    found = [0]
    for level in range(-(-bits // FAN) + 1):
        if level:  # the children of nodes that differ
            inside = F.shiftright("node", FAN).isin(found) if len(found) <= 1024 else F.lit(True)
        else:
            inside = F.lit(True)
        x, y = (t.where((F.col("level") == level) & inside).select("node", F.struct(*SUMS).alias(name)) for t, name in ((a, "_a"), (b, "_b")))
        rows = x.join(y, "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node").collect()
        parents = set(found)
        found = sorted(r["node"] for r in rows if not level or r["node"] >> FAN in parents)
        if not found:
            return []
    return found


def within(df: DataFrame, keys: list[str], found: list[int], bits: int = BITS) -> DataFrame:
    """The rows of df in these leaves (at most 2^bits, which are broadcast)."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in found], "_leaf int")
    return df.withColumn("_leaf", leaf(keys, bits)).join(F.broadcast(wanted), "_leaf", "left_semi").drop("_leaf")


def diff(old: DataFrame, new: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """The change log between two versions; only rows in leaves that differ are joined."""
    found = differing(tree(leaves(old, keys, new.columns, bits), bits), tree(leaves(new, keys, None, bits), bits), bits)
    return cdc.diff(within(old, keys, found, bits), within(new, keys, found, bits), keys)


def deleted_keys(old: DataFrame, new: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """Keys of old that new has no row of."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    found = differing(tree(leaves(a, keys, None, bits), bits), tree(leaves(b, keys, None, bits), bits), bits)
    return cdc.delete_by_key(within(a, keys, found, bits), within(b, keys, found, bits), keys)


def reconcile(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Rows of both sides in each group, and whether they are the same rows."""
    s, t = (df.groupBy(*by).agg(*sums(source.columns)).select(*by, F.struct(*SUMS).alias(name)) for df, name in ((source, "_s"), (target, "_t")))
    right = t.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_t")
    both = s.join(right, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]), "full_outer")
    here = F.col("_s").isNotNull()
    n = lambda c: F.coalesce(F.col(c)["n"], F.lit(0)).alias
    return both.select(*[F.when(here, F.col(c)).otherwise(F.col(f"_by{i}")).alias(c) for i, c in enumerate(by)], n("_s")("source_rows"), n("_t")("target_rows"), F.col("_s").eqNullSafe(F.col("_t")).alias("in_sync"))


def store(df: DataFrame, path: str, keys: list[str], bits: int = BITS) -> None:
    """df laid out by leaves, and its tree. Bits must be at least PARTS."""
    rows = df.withColumn("_leaf", leaf(keys, bits)).withColumn("_part", F.shiftright("_leaf", bits - PARTS))
    rows.repartitionByRange("_part", "_leaf").sortWithinPartitions("_part", "_leaf").write.partitionBy("_part").parquet(f"{path}/rows")
    scratch.create(df.sparkSession, f"{path}/schema.json", rows.schema.json())
    there = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").select(*df.columns)
    tree(leaves(there, keys, sorted(df.columns), bits), bits).write.partitionBy("level").parquet(f"{path}/tree")


def stored(spark: SparkSession, path: str, found: list[int] | None = None, bits: int = BITS) -> DataFrame:
    """A stored table, or the rows of these leaves only."""
    rows = spark.read.schema(StructType.fromJson(json.loads(scratch.text(spark, f"{path}/schema.json")))).parquet(f"{path}/rows")
    if found is not None:
        parts: dict[int, list[int]] = {}
        for x in sorted(found):
            parts.setdefault(x >> (bits - PARTS), []).append(x)
        wanted = spark.createDataFrame([(x,) for x in found], "_leaf int")
        spans = [(F.col("_part") == p) & F.col("_leaf").between(xs[0], xs[-1]) for p, xs in parts.items()]  # prunes folders and row groups
        rows = rows.where(reduce(Column.__or__, spans) if spans else F.lit(False)).join(F.broadcast(wanted), "_leaf", "left_semi")
    return rows.drop("_leaf", "_part")


def stored_diff(spark: SparkSession, old: str, new: str, keys: list[str], bits: int = BITS) -> DataFrame:
    """The change log between two stored versions; folders of equal leaves are not opened."""
    trees = [spark.read.schema("node int, n long, s0 long, s1 long, s2 long, s3 long, level int").parquet(f"{p}/tree") for p in (old, new)]
    found = differing(*trees, bits)
    return cdc.diff(stored(spark, old, found, bits), stored(spark, new, found, bits), keys)
