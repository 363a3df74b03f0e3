"""Streaming apply of change logs and document streams.

A micro-batch is merged on read into its table: it writes the latest row of each key that it changes and the places
of those it replaces (sources/deltas.py). Rows carry the change that made them, and deletes stay as tombstones, so a
batch that is replayed after a failure changes nothing, and a change that comes late does not undo a newer one.
compact() drops tombstones when no batch can be replayed any more."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cdc
from ..sources import deltas


def read_changes(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Change files (Parquet) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def portions(batch: DataFrame, most: int | None) -> list[DataFrame]:
    """A batch as parts of at most so many changes, in the order of change_id (unique)."""
    n = batch.count() if most else 0
    if not most or n <= most:
        return [batch]
    step = 0.8 * most / n  # cuts are off by a tenth of a part at most
    cuts = batch.approxQuantile("change_id", [i * step for i in range(1, math.ceil(1 / step))], 0.1 * most / n)
    edges = [None, *sorted(set(cuts)), None]
    c = F.col("change_id")
    return [batch.where((F.lit(True) if a is None else c > a) & (F.lit(True) if b is None else c <= b)) for a, b in zip(edges, edges[1:], strict=False)]


def apply_stream(changes: DataFrame, table: str, checkpoint: str, *, keys: list[str], columns: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None, most: int | None = None, every: int | None = None) -> StreamingQuery:
    """Parsed changes applied to the table; prepare shapes a batch first. Of a batch the last change of each
    key is merged, at most `most` of them at a time: how often a key changes makes no merges. The stream ends when no file
    is left, or looks again every so many seconds."""

    def one(batch: DataFrame, n: int) -> None:
        rows = cdc.latest(cdc.keyed(cdc.known(prepare(batch) if prepare else batch), keys), keys).persist()
        parts = portions(rows, most)
        for i, part in enumerate(parts):
            part = part.select(*keys, *columns, F.col("change_id").alias("_change_id"), (F.col("operation") == "D").alias("_deleted"))
            number = n if i == len(parts) - 1 else None
            if deltas.version(batch.sparkSession, table) is None:
                deltas.create(part, table, keys, batch=number)
            else:
                deltas.merge(part, table, order="_change_id", batch=number)
        rows.unpersist()

    out = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{every} seconds") if every else out.trigger(availableNow=True)).start()


def live(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows without tombstones and bookkeeping."""
    return deltas.current(spark, table).where("not _deleted").drop("_deleted", "_change_id")


def compact(spark: SparkSession, table: str, *, before: int, share: float = 0.3, small: int = 0) -> list[str]:
    """Rewrite the files with many dead rows (or few rows at all), without the tombstones of changes up to `before`,
    which no later batch may bring again."""
    return deltas.compact(spark, table, share=share, small=small, keep=~(F.col("_deleted") & (F.col("_change_id") <= before)))


def document_changes(stream: DataFrame) -> DataFrame:
    """A document change stream (change_id, kind, doc) as changes keyed by _id."""
    id = F.coalesce(F.get_json_object("doc", "$._id['$oid']"), F.get_json_object("doc", "$._id"))
    return stream.select("change_id", F.when(F.col("kind") == "delete", "D").otherwise("U").alias("operation"), id.alias("_id"), F.col("doc").alias("_document"))
