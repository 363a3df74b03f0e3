"""Trailing figures of streams by event time (K8, K11, J12, L3): sliding windows behind a watermark.

A window is given out once, when the watermark (the latest event time less `late`) has passed its end; its state goes
then, so that state holds the open windows only. A row that comes when all its windows have been given out is late and
counts nowhere. The same functions on a batch give all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(rows: DataFrame, time: str, by: list[str], measures: dict[str, Column], *, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, window_end, by and the measures. Measures that combine (counts, sums, extremes) are combined before
    the shuffle, so that a group with a third of all rows is no burden."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    found = rows.groupBy(F.window(time, size, slide or size).alias("w"), *by).agg(*[m.alias(n) for n, m in measures.items()])
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *measures)


def engine_windows(transfers: DataFrame, *, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", time: str = "completed_at") -> DataFrame:
    """Transfers, rows, bytes, memory and io of each engine in each window."""
    measures = {"transfers": F.count("*"), "records": F.sum("records_transferred"), "bytes": F.sum("bytes_transferred"), "memory_mb": F.max("memory_used_mb"), "io_operations": F.sum("io_operations")}
    return windowed(transfers.where(F.col(time).isNotNull()), time, ["db_engine"], measures, size=size, slide=slide, late=late)


def access_anomalies(accesses: DataFrame, *, most: int = 1000, size: str = "24 hours", slide: str | None = "1 hour", late: str = "1 hour", time: str = "access_timestamp") -> DataFrame:
    """Users with more than `most` accesses to sensitive data in a window."""
    found = windowed(accesses.where("is_sensitive_data"), time, ["username"], {"accesses": F.count("*")}, size=size, slide=slide, late=late)
    return found.where(F.col("accesses") > most)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows to a Parquet folder until no input is left."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
