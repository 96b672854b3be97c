"""Keyed state over streams with timers and times to live, by ``transformWithState`` (state in RocksDB).

Rows of a key come to one processor, which holds small state for each key alone: counters, a last time, a map. Nothing is held
for keys whose work has ended. The stream's session needs the RocksDB state store (``with_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TASK = "task string, deliveries long, status string"
MARK = "deliveries long, last_ms long, timer_ms long"
DELIVERY = "message string, receiver string, times long, total long, route string"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def millis(at) -> int:
    return round(at.timestamp() * 1000)


class Watched(StatefulProcessor):
    """Deliveries of a task and when it was last heard of; one timer, moved ahead by each sign of life."""

    def __init__(self, silent_ms: int, most: int, event_time: bool):
        self.silent_ms, self.most, self.event_time = silent_ms, most, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", MARK)

    def end(self) -> None:
        if self.mark.exists():
            old = self.mark.get()[2]
            if old in set(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.mark.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        deliveries, last, _ = self.mark.get() if self.mark.exists() else (0, 0, 0)
        most_done = 0.0
        for row in rows:
            deliveries += 1
            last = max(last, millis(row.ts))
            most_done = max(most_done, row.progress or 0.0)
        status = "done" if most_done >= 100 else "failed" if deliveries >= self.most else "running"
        self.end()
        if status == "running":
            now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            timer = max((last if self.event_time else now) + self.silent_ms, now + 1)
            self.handle.registerTimer(timer)
            self.mark.update((deliveries, last, timer))
        yield Row(task=key[0], deliveries=deliveries, status=status)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.mark.exists():
            return
        deliveries, _, timer = self.mark.get()
        if timer <= expiredTimerInfo.getExpiryTimeInMs():
            self.mark.clear()
            yield Row(task=key[0], deliveries=deliveries, status="zombie")

    def close(self) -> None:
        pass


def watched_tasks(progress: DataFrame, silent_ms: int = 3_600_000, most: int = 3, late: str | None = "1 minute") -> DataFrame:
    """From a stream (task string, progress double, ts timestamp): a row per batch and task with its deliveries and status.

    Status is running, done (progress 100), failed (delivered ``most`` times without an end) or zombie, when ``silent_ms``
    have passed since the task's last row. With ``late``, time is the stream's watermark, so a replay gives the same; with
    None it is the machines' clock, and the query runs until it is stopped, for Spark asks for a further batch as long as
    timers may expire. Ended tasks have no state and no timer. Null progress counts as none.
    """
    with_rocksdb(progress.sparkSession)
    timed = progress.withWatermark("ts", late) if late else progress
    return timed.groupBy("task").transformWithState(Watched(silent_ms, most, bool(late)), TASK, "Update", "EventTime" if late else "ProcessingTime")


class Deliveries(StatefulProcessor):
    """How often each receiver got a message, and all together; counts go when they weren't touched for ``ttl_ms``."""

    def __init__(self, most: int, ttl_ms: int | None):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.by_receiver = handle.getMapState("by_receiver", "receiver string", "times long", self.ttl_ms)
        self.total = handle.getValueState("total", "times long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        total, got = (self.total.get()[0] if self.total.exists() else 0), {}
        for row in rows:
            got[row.receiver] = got.get(row.receiver, 0) + 1
            total += 1
        self.total.update((total,))
        for receiver, times in sorted(got.items(), key=lambda g: g[0] or ""):
            of = (receiver or "",)
            times += self.by_receiver.getValue(of)[0] if self.by_receiver.containsKey(of) else 0
            self.by_receiver.updateValue(of, (times,))
            yield Row(message=key[0], receiver=receiver, times=times, total=total, route="fail_queue" if total >= self.most else "process")

    def close(self) -> None:
        pass


def counted_deliveries(deliveries: DataFrame, most: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """From a stream (message string, receiver string): per batch, message and receiver, how often it came there and in
    all, and its route: fail_queue from ``most`` deliveries on.

    Counts that weren't touched for ``ttl_ms`` of the machines' clock start anew; such a query runs until it is stopped. With
    None they are kept. A null receiver counts as an
    empty one. State holds a row for each message and receiver.
    """
    with_rocksdb(deliveries.sparkSession)
    return deliveries.groupBy("message").transformWithState(Deliveries(most, ttl_ms), DELIVERY, "Update", "ProcessingTime" if ttl_ms else "None")
