"""Change logs kept in keyed state (D11, D12): one state a primary key instead of a table that is merged into.

The state of a key is its last change. A change of a higher id replaces it and is given out; one that is not newer, because
it came late or a file was delivered twice, gives nothing out, whatever the order of arrival. A delete leaves a
tombstone, so that late changes do not bring the row back; a timer removes the tombstone when the event time of
the stream has passed it by `keep`. What is given out is an append-only log of effective changes, in which the last one of a
key is the key's row (rows()).

transformWithState keeps state in RocksDB, by key and spread over the executors, and snapshots it to the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import cdc

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastChange(StatefulProcessor):
    """State: the id of a key's last change, whether it was a delete, and the event time in ms up to which a tombstone
    stays."""

    def __init__(self, names: list[str], keep_ms: int):
        self.names, self.keep_ms = names, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "change_id long, deleted boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = max(rows, key=lambda r: r["change_id"])
        before = self.last.get() if self.last.exists() else None
        if before is not None and before[0] >= new["change_id"]:
            return
        deleted = new["operation"] == "D"
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if deleted:
            self.handle.registerTimer(int(new["change_time"].timestamp() * 1000) + self.keep_ms)
        self.last.update((new["change_id"], deleted))
        yield Row(**{n: new[n] for n in self.names}, _change_id=new["change_id"], _deleted=deleted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[1]:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def effective(changes: DataFrame, keys: list[str], columns: list[str], *, late: str = "1 day", keep_seconds: int = 7 * 86400) -> DataFrame:
    """A stream of changes (keys, columns, change_id, operation, change_time: timestamp) as its effective changes: keys,
    columns, _change_id, _deleted. Event time runs `late` behind the latest change; a change that comes after its key's
    tombstone has gone counts as a new row."""
    known = cdc.keyed(cdc.known(changes), keys).select(*keys, *columns, "change_id", "operation", "change_time").withWatermark("change_time", late)
    names = [*keys, *columns]
    schema = StructType([known.schema[n] for n in names]).add("_change_id", "long").add("_deleted", "boolean")
    return known.groupBy(*keys).transformWithState(LastChange(names, keep_seconds * 1000), schema, "Append", "EventTime")


def start(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append effective changes to a Parquet folder until no input is left."""
    conf, before = changes.sparkSession.conf, changes.sparkSession.conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)  # a query keeps the provider with which it started
    try:
        return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)


def rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that a log of effective changes stands for."""
    return cdc.latest(spark.read.parquet(path), keys, "_change_id").where("not _deleted").drop("_deleted", "_change_id")
