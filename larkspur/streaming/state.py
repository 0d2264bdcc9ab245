"""The state of incremental scans, kept by path in a stream of listings.

A listing is a stream of rows (path, mtime, size, listed_at): the files that were there at a
time. Each path has a value (mtime, size, when it was last listed, findings). A file that is new
or changed comes out as ``stale``; one that no listing has named for ``keep`` comes out
as ``gone``, by a timer on event time, and its state goes. Rows with ``findings_count`` set
tell what a scan found in a file, and change nothing else.

State is kept by Spark's state store, in RocksDB, with checkpoints: a query that is started
again goes on where it was. Rows of one path may come in any order within a batch; older ones
than the last that counted are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from larkspur.runtime import ensure_importable

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUE = "mtime bigint, size bigint, seen_at bigint, findings_count bigint"
CHANGES = "path string, mtime bigint, size bigint, findings_count bigint, kind string"


def millis(row: Row) -> int:
    return int(row.listed_at.timestamp() * 1000)


class Watch(StatefulProcessor):
    """One path: what is known of it, and a timer for when it counts as gone."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.known = handle, handle.getValueState("known", VALUE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = tuple(self.known.get()) if self.known.exists() else None
        before, stale = known, False
        for row in sorted(rows, key=millis):
            at = millis(row)
            if row.findings_count is not None:
                known = known and (*known[:3], row.findings_count)
                continue
            if known and at < known[2]:
                continue
            if not known or known[:2] != (row.mtime, row.size):
                known, stale = (row.mtime, row.size, at, 0), True
            known = (*known[:2], at, known[3])
        if known is None:
            return
        if before is None or before[2] != known[2]:
            if before:
                self.handle.deleteTimer(before[2] + self.keep)
            self.handle.registerTimer(known[2] + self.keep)
        self.known.update(known)
        if stale:
            yield Row(path=key[0], mtime=known[0], size=known[1], findings_count=known[3], kind="stale")

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.known.exists():
            mtime, size, seen_at, found = self.known.get()
            if seen_at + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
                self.known.clear()
                yield Row(path=key[0], mtime=mtime, size=size, findings_count=found, kind="gone")

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that such a query needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def changes(listings: DataFrame, keep: timedelta = timedelta(days=1), late: str = "0 seconds") -> DataFrame:
    """A stream of (path, mtime, size, listed_at, findings_count) -> files that are stale or gone."""
    ensure_importable(listings.sparkSession)
    watched = listings.withWatermark("listed_at", late).groupBy("path")
    return watched.transformWithState(statefulProcessor=Watch(int(keep.total_seconds() * 1000)), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")
