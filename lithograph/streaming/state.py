"""Custom keyed state over streams: retries and silent tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watched_tasks(progress: DataFrame, silent_ms: int = 3_600_000, most: int = 3, late: str = "1 minute") -> DataFrame:
    """From a stream (task string, progress double, ts timestamp): a row per batch and task with its deliveries and status.

    Status is running, done (progress 100), failed (delivered ``most`` times without an end), or zombie when the stream's
    watermark (``late`` behind its newest row) is ``silent_ms`` past the task's last row; ended tasks' state is dropped.
    Time is the rows' own, so a replay gives the same, and a query that reads what is there comes to an end.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            deliveries, status = state.get[0], "zombie"
            state.remove()
        else:
            rows = pd.concat(batches)
            deliveries, last = state.get if state.exists else (0, 0)
            deliveries, last = deliveries + len(rows), max(last, int(rows["ts"].max().timestamp() * 1000))
            status = "done" if rows["progress"].max() >= 100 else "failed" if deliveries >= most else "running"
            if status == "running":
                state.update((deliveries, last))
                state.setTimeoutTimestamp(max(last + silent_ms, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame([(key[0], deliveries, status)], columns=["task", "deliveries", "status"])

    timed = progress.withWatermark("ts", late).groupBy("task")
    return timed.applyInPandasWithState(step, "task string, deliveries long, status string", "deliveries long, last long", "update", GroupStateTimeout.EventTimeTimeout)
