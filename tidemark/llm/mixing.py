"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone.

The words of a source form a stream: its documents in an order shuffled by hash, one after the
other, three times over. Streams are cut into equal blocks of words. A schedule deals them out: of 2^m
slots, slot i gets the van der Corput point of i, which falls into one source's part of [0, 1), a part
as wide as its blocks, or into none. The k-th slot of a source takes the k-th block of its stream, so that the slots
a source gets are what it gives, and their order is the order of the mix. A source has as many blocks as its target,
rounded to words, fills; its last block is as short as what is left, so that every source gives its target to
half a word. Blocks have a 2^18th of all words (at least one), or `block`, so that the schedule has some 2^18 slots
and one for each source at any size.

Ranks and stream offsets are prefix sums in two levels (within a chunk, then over the chunks), so a
source with a third of the rows is never in one task; many sources are ranked in the same way, by ranges. Rows that
are equal in all columns used are one stretch of the stream, so that many of them meet in no window.

Defined cases: a null text has size 0 and is never taken. Null sources are one source, the last.
A document without words is in the result with taken 0 and no slot. Repeated rows are documents of their own.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

WEIGHTS = (1, 2, 3)
FEW = 10_000  # sources that one task may rank and a join may broadcast; more are ranked by ranges and shuffled
EPOCHS = 3  # a source gives its words three times at most
SLOT_BITS = 18
BUCKET_ROWS = 4096  # documents of a source that are ordered in one window


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sums_before(df: DataFrame, order: list[str], sums: dict[str, str], few: bool = False) -> DataFrame:
    """df and, by new name, the sum of a column over all rows before in this order (no ties): in one window where
    the rows are few, else within ranges of the order and then over the ranges, as many as shuffle partitions at most."""
    so_far = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if few:
        return df.withColumns({n: so_far(c, Window.orderBy(*order)) for n, c in sums.items()})
    parts = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    offsets = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    offsets = offsets.select("_part", *[so_far(f"_{n}", Window.orderBy("_part")).alias(f"_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy(*order)
    return parts.join(offsets, "_part").withColumns({n: F.col(f"_{n}") + so_far(c, within) for n, c in sums.items()}).drop("_part", *[f"_{n}" for n in sums])


def targets(sized: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source of sized (source, size): nth, docs, source_size and target.

    Weights repeat over the sources by code point, null last. Targets share all sizes; one that would be
    above epochs times its source stops there, and what is left is shared by weight. In closed form: by
    rising ratio of limit to weight, sources stop as long as their ratio is below the level of the rest."""
    sums = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    total, n = sums.agg(F.sum("source_size"), F.count("*")).first()
    few = n <= FEW
    keyed = sums.withColumns({"void": F.col("source").isNull(), "bytes": F.coalesce(F.col("source").cast("binary"), F.lit(b"")), "one": F.lit(1)})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums_before(keyed, ["void", "bytes"], {"nth": "one"}, few).withColumn("weight", F.element_at(cycle, (F.pmod("nth", F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", (epochs * F.col("source_size")).cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    rising = sums_before(ranked, ["ratio", "nth"], {"stopped": "limit", "passed": "weight"}, few)
    weight = n // len(weights) * sum(weights) + sum(weights[: n % len(weights)])
    leveled = rising.withColumn("level", (F.lit(total).cast("double") - F.col("stopped")) / (F.lit(float(weight)) - F.col("passed")))
    level = leveled.where("ratio > level").agg(F.min(F.struct("ratio", "nth", "level"))["level"]).first()[0]
    return rising.select("source", "nth", "docs", "source_size", F.least("limit", F.col("weight") * F.lit(level)).alias("target"))


def schedule(parts: DataFrame, slots: int, chunk: int = 1 << 14) -> DataFrame:
    """(nth, k): the source of each slot and the slot's rank in it. parts: nth, lo, hi in slots' grid points."""
    spark = parts.sparkSession
    bits = slots.bit_length() - 1
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")
    cells = min(slots, 4096)
    width = slots // cells
    dealt = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / width))
    ranges = parts.where("hi > lo").select("nth", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    owned = dealt.join(ranges, "cell").where("point >= lo and point < hi").select("nth", "slot", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = owned.groupBy("nth", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("nth").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("nth", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("nth", "chunk").orderBy("slot")
    return owned.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["nth", "chunk"]).select("nth", "slot", (F.col("offset") + F.col("r")).alias("k"))


def mix(sized: DataFrame, *, keep: tuple[str, ...] = (), weights=WEIGHTS, epochs: int = EPOCHS, block: int | None = None, seed: int = 7) -> DataFrame:
    """sized (doc_id, source, size and the columns in keep) with source_size, target, taken (the words that the mix
    takes) and first_slot (where it first does; null if never)."""
    alike = ["doc_id", "source", "size", *keep]
    sized = staged(sized.select(*alike))
    goal = staged(targets(sized, weights, epochs))
    total, n = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    block, few = block or max(1, total >> SLOT_BITS), n <= FEW
    goal = goal.withColumn("give", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("give") / block).cast("long"))
    goal = sums_before(goal, ["nth"], {"lo": "blocks"}, few)
    blocks = goal.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    dealt = staged(schedule(goal.select("nth", "lo", (F.col("lo") + F.col("blocks")).alias("hi")), 1 << max(0, int(blocks - 1).bit_length())))
    side = goal.select("nth", F.col("source").alias("_source"), "source_size", "target", "give", F.ceil(F.col("docs") / BUCKET_ROWS).alias("buckets"))
    side = F.broadcast(side) if few else staged(side)
    rows = sized.groupBy(*alike).agg(F.count("*").alias("copies")).join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("mixed", F.xxhash64(F.lit(seed), *alike)).withColumn("bucket", F.pmod("mixed", F.col("buckets")))
    rows = staged(rows.withColumn("words", F.col("size") * F.col("copies")))
    sums = rows.groupBy("nth", "bucket").agg(F.sum("words").alias("n"))
    earlier = Window.partitionBy("nth").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("nth", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("nth", "bucket").orderBy("mixed", *alike)
    placed = rows.withColumn("place", F.row_number().over(within)).withColumn("ahead", F.coalesce(F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(offsets, ["nth", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    placed = staged(placed.withColumn("start", F.col("offset") + F.col("ahead") + (F.col("copy") - 1) * F.col("size")).select(*alike, "nth", "bucket", "place", "copy", "start", "source_size", "target", "give"))

    # A document lies in the stream once an epoch; each of these stretches, up to what the source gives, touches a range of blocks.
    lies = placed.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.col("start") + e * F.col("source_size"))))
    lies = lies.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("give"))).where(F.col("end") > F.col("at"))
    pieces = lies.select("nth", "bucket", "place", "copy", "at", "end", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))).alias("k"))
    overlap = F.least(F.col("end"), (F.col("k") + 1) * block) - F.greatest("at", F.col("k") * block)
    got = pieces.join(dealt, ["nth", "k"]).groupBy("nth", "bucket", "place", "copy").agg(F.sum(overlap).alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(got, ["nth", "bucket", "place", "copy"], "left").select("doc_id", "source", *keep, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def op2_mixing(docs: DataFrame) -> DataFrame:
    """The contract's query over documents."""
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).drop("source")
