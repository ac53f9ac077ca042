"""Records from a stream: each key's record is taken once, and a failed one comes back after a while of event time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, at long, body string, status string, tries int"


class _Once(StatefulProcessor):
    """State of a key: whether it is done, when its record was made, the record, how often it came back. A done key has a
    timer that forgets it, a failed one a timer that brings it back; a key never has two."""

    def __init__(self, wait: int, remember: int) -> None:
        self.wait, self.remember = wait, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("record", "done boolean, at long, body string, tries int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        first = last = None  # the earliest good row and the latest failed one; nothing else is held
        for r in rows:
            at = (r["at"], r["body"] or "", r["body"])
            if r["error"]:
                last = at if last is None or at[:2] > last[:2] else last
            else:
                first = at if first is None or at[:2] < first[:2] else first
        known = self.state.get() if self.state.exists() else None
        if known is not None and known[0]:
            return
        tries = known[3] if known is not None else 0
        if first is not None:
            self._arm(first[0] + self.remember)
            self.state.update((True, first[0], None, tries))
            yield Row(key=key[0], at=first[0], body=first[2], status="taken", tries=tries)
        elif last is not None and (known is None or last[0] > known[1]):  # a repeat of what failed doesn't wait anew
            self._arm(last[0] + self.wait)
            self.state.update((False, last[0], last[2], tries))

    def _arm(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterable[Row]:  # noqa: N802, N803 - Spark's names
        done, at, body, tries = self.state.get()
        if done:
            self.state.clear()
            return
        self.state.update((False, at, body, tries + 1))
        yield Row(key=key[0], at=at, body=body, status="retry", tries=tries + 1)

    def close(self) -> None:
        pass


def take_once(records: DataFrame, late: str, wait: int, remember: int) -> DataFrame:
    """records, a stream of key, ts, error (boolean) and body, as key, ts, body, status and tries.

    A key's earliest good record of the first batch that has one is "taken", and nothing of that key is taken again until
    the watermark is remember milliseconds past it, when its state goes. A key that has only failed so far comes back as
    "retry" when the watermark is wait milliseconds past its latest failure; each newer failure makes it wait once more.
    tries counts how often it came back. Rows later than late (an interval) behind the newest are left out, as are rows
    without a time or key; a null error counts as none.
    """
    rows = records.where("key is not null and ts is not null").select(F.col("key").cast("string").alias("key"), "ts", F.unix_millis("ts").alias("at"), F.coalesce("error", F.lit(False)).alias("error"), "body")
    out = rows.withWatermark("ts", late).groupBy("key").transformWithState(_Once(wait, remember), OUT, "Append", "EventTime")
    return out.select("key", F.timestamp_millis("at").alias("ts"), "body", "status", "tries")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes all that has come since the last call and appends to the Parquet table at path, each row once; state and
    progress are in checkpoint, so that the next call, on other executors too, goes on from there."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
