"""A table that a stream keeps: a batch's changed keys become a run, runs of like size are merged, manifests name what counts.

Below the table's root lie runs (Parquet folders that never change) and ``_log``, a small JSON file for each version, which
names the version's runs with their rows and the last batch that each writer brought. A version is there when its manifest
is; a run that no manifest names doesn't count. So readers see whole versions, a batch that is given again changes nothing,
and a failure leaves files that ``vacuum`` finds.

A batch costs what it changes: it is appended, and when the run before a new one isn't more than ``GROWTH`` times as long,
the two become one. N rows lie in O(log N) runs, each row is rewritten O(log N) times, and ``current`` groups no history, but
the runs. Removed keys stay as rows with the action ``delete``, for older events may still come; ``forget`` drops those that
are so much older than the newest event when all runs are merged. One stream writes a table at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tile_sink import at, put_file
from .ingest import last_actions

LOG, GROWTH = "_log", 2
ROWS = "bucket string, key string, ts timestamp, action string"


@dataclass
class Version:
    """What a manifest tells. ``runs``: (folder's name, rows), oldest first. ``writers``: last batch by writer."""

    number: int = 0
    runs: list[tuple[str, int]] = field(default_factory=list)
    writers: dict[str, int] = field(default_factory=dict)


def versions(root: str) -> list[int]:
    """Numbers of the versions whose manifests are there, in order."""
    from pyarrow import fs

    store, base, _ = at(root)
    names = [i.base_name for i in store.get_file_info(fs.FileSelector(f"{base}/{LOG}", allow_not_found=True)) if i.is_file]
    return sorted(int(m[1]) for m in (re.fullmatch(r"([0-9]+)\.json", n) for n in names) if m)


def version(root: str, number: int | None = None) -> Version:
    """One version, the last unless asked otherwise; before the first batch, version 0 without runs."""
    there = versions(root)
    if number is None:
        number = there[-1] if there else 0
    if number == 0:
        return Version()
    if number not in there:
        raise ValueError(f"version {number} isn't there")
    store, base, _ = at(root)
    with store.open_input_stream(f"{base}/{LOG}/{number:020d}.json") as stream:
        told = json.loads(stream.read())
    return Version(number, [tuple(r) for r in told["runs"]], told["writers"])


def commit(root: str, new: Version) -> None:
    store, base, _ = at(root)
    told = {"runs": new.runs, "writers": new.writers}
    put_file(store, f"{base}/{LOG}/{new.number:020d}.json", json.dumps(told).encode())


def rows_of(spark: SparkSession, root: str, runs: list[tuple[str, int]]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(*[f"{root.rstrip('/')}/{name}" for name, _ in runs])


def put_run(rows: DataFrame, root: str) -> tuple[str, int]:
    """Write a run; its rows are counted from what was written."""
    name = f"run-{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{name}"
    rows.select("bucket", "key", "ts", "action").write.parquet(path)
    return name, rows.sparkSession.read.schema(ROWS).parquet(path).count()


def merged_runs(spark: SparkSession, root: str, runs: list[tuple[str, int]], forget: str | None) -> list[tuple[str, int]]:
    """The last runs as one, as far back as each is at most GROWTH times as long as all behind it."""
    first, behind = len(runs) - 1, runs[-1][1]
    while first > 0 and runs[first - 1][1] <= GROWTH * behind:
        first -= 1
        behind += runs[first][1]
    if first == len(runs) - 1:
        return runs
    kept = last_actions(rows_of(spark, root, runs[first:]))
    if forget and first == 0:
        newest = kept.agg(F.max("ts").alias("newest"))  # one row
        old = (F.col("action") != "build") & (F.col("ts") < F.col("newest") - F.expr(f"interval {forget}"))
        kept = kept.join(F.broadcast(newest)).where(~F.coalesce(old, F.lit(False))).drop("newest")
    return [*runs[:first], put_run(kept, root)]


def kept_in(root: str, writer: str = "stream", forget: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``ingest.run_batches``: a batch's decisions become a version of the table at ``root``.

    ``writer`` names the stream, with one checkpoint: batches up to the last one that a version holds are left out. Ignored
    events and empty batches change nothing. ``forget`` is an interval such as ``30 days``.
    """

    def apply(batch: DataFrame, number: int) -> None:
        before = version(root)
        if number <= before.writers.get(writer, -1):
            return
        runs, spark = before.runs, batch.sparkSession
        added = put_run(batch.where("action <> 'ignore'"), root)
        if added[1]:
            runs = merged_runs(spark, root, [*runs, added], forget)
        commit(root, Version(before.number + 1, runs, before.writers | {writer: number}))

    return apply


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """bucket, key, ts, action of a version: the last decision of each key, deletes too."""
    told = version(root, number)
    rows = rows_of(spark, root, told.runs)
    return last_actions(rows) if len(told.runs) > 1 else rows  # a single run has each key once


def compacted(spark: SparkSession, root: str, forget: str | None = None) -> int:
    """Merge all runs into one, as a version of its own; gives its number. Not while a stream writes."""
    before = version(root)
    if len(before.runs) < 2:
        return before.number
    longest = sum(n for _, n in before.runs)
    runs = merged_runs(spark, root, [*((name, 0) for name, _ in before.runs[:-1]), (before.runs[-1][0], longest)], forget)
    commit(root, Version(before.number + 1, runs, before.writers))
    return before.number + 1


def vacuum(root: str, keep: int = 10) -> list[str]:
    """Remove manifests but the last ``keep`` ones and all runs that those don't name; gives the removed runs' names.

    Not while a stream writes: a run under way has no manifest yet. The driver handles names of runs, never rows or keys.
    """
    from pyarrow import fs

    if keep < 1:
        raise ValueError("the last version stays")
    store, base, _ = at(root)
    there = versions(root)
    named = {name for n in there[-keep:] for name, _ in version(root, n).runs}
    found = [i.base_name for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.type == fs.FileType.Directory and i.base_name.startswith("run-")]
    gone = sorted(n for n in found if n not in named)
    for n in there[:-keep]:
        store.delete_file(f"{base}/{LOG}/{n:020d}.json")
    for name in gone:
        store.delete_dir(f"{base}/{name}")
    return gone
