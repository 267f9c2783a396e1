"""Time-gap clustering of a stream: the numbers that ``sessions.cluster`` gives the same rows in a batch.

Rows of a key wait in state until the watermark says that no earlier one can come; an event-time
timer then takes them in order of (date, file_name).  A duplicate bridges or takes over a gap as
it does in a batch.  Files without a date wait until their key has been quiet for a while, and
join its last event.  State never expires.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventloom.config import Status
from eventloom.operators.sessions import GAP, _us, micros
from eventloom.runtime import ship
from eventloom.schemas import require_columns

#: What a query with state in RocksDB is started with.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
_WAITING = "t long, name string, status string"
_PLACE = "last long, number long, begun boolean, seen long"


class _Clusterer(StatefulProcessor):
    """place: time of the last row taken, number of the last event, whether there is one, first watermark seen (ms)."""

    def __init__(self, keys: list[str], gap: int, first_id: int, quiet: int):
        self.keys, self.gap, self.first_id, self.quiet = keys, gap, first_id, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.undated = handle.getListState("undated", _WAITING)
        self.place = handle.getValueState("place", _PLACE)

    def _placed(self):
        return self.place.get() if self.place.exists() else (None, self.first_id - 1, False, None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        dated, others = [], []
        for r in rows:
            (others if r._us is None else dated).append((r._us, r.file_name, r.status))
        if dated:
            self.waiting.appendList(dated)
            self.handle.registerTimer(-(-min(x[0] for x in dated) // 1000))
        if others:
            self.undated.appendList(others)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        last, number, begun, seen = self._placed()
        seen = now if seen is None else seen
        due, later, out = [], [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (due if row[0] <= now * 1000 else later).append(tuple(row))
        due.sort(key=lambda x: (x[0], x[1] is not None, x[1]))
        for t, name, status in due:
            new = status == Status.UNKNOWN.name
            if new and (not begun or t - last > self.gap):
                number, begun = number + 1, True
            last = t
            out.append(self._row(key, t, name, status, number if new else None))
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-min(x[0] for x in later) // 1000))
        elif self.undated.exists():
            end = (seen if last is None else -(-last // 1000)) + self.quiet
            if now < end:
                self.handle.registerTimer(end)
            else:
                for row in self.undated.get():
                    new = row[2] == Status.UNKNOWN.name
                    if new and not begun:
                        number, begun = number + 1, True
                    out.append(self._row(key, None, row[1], row[2], number if new else None))
                self.undated.clear()
        self.place.update((last, number, begun, seen))
        return iter(out)

    def _row(self, key, t, name, status, number) -> Row:
        values = dict(zip(self.keys, key))
        new = number is not None
        return Row(**values, file_name=name, _us=t, status=Status.NEW_CLUSTER.name if new else status, cluster_id=number)

    def close(self) -> None:
        pass


def cluster(media: DataFrame, *keys: str, gap: timedelta = GAP, first_id: int = 1, date: str = "date", late: str = "1 day", quiet: timedelta = timedelta(days=1)) -> DataFrame:
    """Stream of (keys, file_name, date, status, cluster_id) of a stream with the columns keys, file_name, date, status.

    ``late``: how long after younger rows a row may come; rows that come later are left out.
    ``quiet``: how long a key has no row, by the watermark, before its files without a date join the last
    event.  Start the query with the settings STATE_STORE.  A key's waiting rows are held by one task, so
    at least one key is needed.
    """
    if not keys:
        raise ValueError("a stream is clustered by one key at least")
    require_columns(media, [*keys, "file_name", date, "status"])
    ship(media.sparkSession)
    rows = media.select(*keys, "file_name", F.col(date).cast("timestamp").alias("_t"), "status").withWatermark("_t", late).withColumn("_us", _us(F.col("_t")))
    fields = [T.StructField(k, media.schema[k].dataType) for k in keys]
    out = T.StructType([*fields, T.StructField("file_name", T.StringType()), T.StructField("_us", T.LongType()), T.StructField("status", T.StringType()), T.StructField("cluster_id", T.LongType())])
    made = _Clusterer(list(keys), micros(gap), first_id, quiet // timedelta(milliseconds=1))
    found = rows.groupBy(*keys).transformWithState(made, out, "Append", "EventTime")
    at = F.timestamp_micros("_us").cast(media.schema[date].dataType)
    return found.select(*keys, "file_name", at.alias(date), "status", "cluster_id")
