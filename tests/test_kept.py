"""Tables kept from streams, keyed state with timers, and deletes of trees."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from lithograph.sources import deletes
from lithograph.streaming import ingest, stream_table, timers

EVENT = "bucket string, key string, event_name string, ts timestamp"
PUT, GONE, TAG = "ObjectCreated:Put", "ObjectRemoved:Delete", "ObjectTagging:Put"


def day(n, minutes=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, minutes=minutes)


def batch(spark, rows):
    return ingest.decided(spark.createDataFrame([("b", *r) for r in rows], EVENT))


def told(spark, root, number=None):
    return {(r.key, r.action) for r in stream_table.current(spark, root, number).collect()}


def test_batches_become_versions_and_few_runs(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert told(spark, root) == set() and stream_table.version(root).number == 0
    apply, last = stream_table.kept_in(root), {}
    for n in range(20):
        rows = [(f"k{n}", PUT, day(n)), (f"k{n // 2}", GONE, day(n)), ("other", TAG, day(n))]
        apply(batch(spark, rows), n)
        apply(batch(spark, [("again", PUT, day(n))]), n)  # a batch that is there already changes nothing
        for key, action in ((f"k{n}", "build"), (f"k{n // 2}", "delete")):
            last[key] = action if n else "delete"
        assert len(stream_table.version(root).runs) <= 6
    assert told(spark, root) == set(last.items())
    assert told(spark, root, 2) == {("k0", "delete"), ("k1", "build")}  # an earlier version
    assert stream_table.versions(root) == list(range(1, 21))
    runs = stream_table.version(root).runs
    assert all(a[1] > stream_table.GROWTH * b[1] for a, b in zip(runs, runs[1:], strict=False))
    assert sum(n for _, n in runs) < 40
    apply(batch(spark, [("k19", GONE, day(3)), ("k0", PUT, day(-1))]), 20)  # older than what is known
    assert told(spark, root) == set(last.items())
    stream_table.compacted(spark, root)
    assert len(stream_table.version(root).runs) == 1 and told(spark, root) == set(last.items())
    gone = stream_table.vacuum(root, keep=1)
    assert gone and told(spark, root) == set(last.items()) and len([f for f in os.listdir(tmp_path / "t") if f.startswith("run-")]) == 1
    with pytest.raises(ValueError):
        stream_table.version(root, 2)


def test_a_run_without_manifest_does_not_count(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    stream_table.kept_in(root)(batch(spark, [("a", PUT, day(0))]), 0)
    stream_table.put_run(batch(spark, [("a", GONE, day(1))]), root)  # a failure before the commit
    assert told(spark, root) == {("a", "build")}
    assert len(stream_table.vacuum(root, keep=1)) == 1 and told(spark, root) == {("a", "build")}
    stream_table.kept_in(root, "another stream")(batch(spark, [("b", PUT, day(0))]), 0)  # its batches are numbered apart
    assert told(spark, root) == {("a", "build"), ("b", "build")}
    stream_table.kept_in(root)(batch(spark, []), 1)
    assert told(spark, root) == {("a", "build"), ("b", "build")} and stream_table.version(root).writers == {"stream": 1, "another stream": 0}


def test_old_deletes_are_forgotten(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    apply = stream_table.kept_in(root, forget="30 days")
    apply(batch(spark, [("a", GONE, day(0)), ("b", PUT, day(0)), ("d", GONE, None)]), 0)
    apply(batch(spark, [("c", GONE, day(40)), ("e", PUT, day(41)), ("f", PUT, day(41))]), 1)
    assert told(spark, root) == {("b", "build"), ("c", "delete"), ("d", "delete"), ("e", "build"), ("f", "build")}


def test_a_stream_keeps_its_table_over_restarts(spark, tmp_path):
    root = f"file://{tmp_path}/t"

    def run():
        stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert ingest.run_batches(stream, stream_table.kept_in(root), str(tmp_path / "c")).awaitTermination(120)
        return told(spark, root)

    def add(name, rows):
        spark.createDataFrame([("b", *r) for r in rows], EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{name}"))

    add("0", [("x", PUT, day(1)), ("y", PUT, day(2))])
    assert run() == {("x", "build"), ("y", "build")}
    add("1", [("x", GONE, day(3)), ("y", TAG, day(4))])
    assert run() == {("x", "delete"), ("y", "build")}
    assert stream_table.version(root).number == 2


def run_state(spark, tmp_path, kinds, rows, of, seen):
    """Add rows as a file, go on from the checkpoint, and give what the new batches told."""
    n = len(os.listdir(tmp_path / "in")) if (tmp_path / "in").exists() else 0
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(kinds).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = []
    query = of(stream).writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    seen.extend(got)
    return sorted(got, key=str)


def test_timers_by_the_streams_time(spark, tmp_path):
    kinds, seen = "task string, progress double, ts timestamp", []
    go = lambda rows: run_state(spark, tmp_path, kinds, rows, lambda s: timers.watched_tasks(s, 3_600_000, 3), seen)
    got = go([("a", 10.0, day(0)), ("b", 100.0, day(0)), ("z", None, day(0)), ("f", 1.0, day(0)), ("f", 1.0, day(0)), ("f", 1.0, day(0))])
    assert got == [("a", 1, "running"), ("b", 1, "done"), ("f", 3, "failed"), ("z", 1, "running")]
    got = go([("a", 20.0, day(0, 50))])  # moves the timer of a
    assert got == [("a", 2, "running")]
    got = go([("c", 5.0, day(0, 100))])
    assert got == [("c", 1, "running"), ("z", 1, "zombie")]  # z alone was silent for an hour
    got = go([("z", 5.0, day(0, 101))])
    assert got == [("z", 1, "running")]  # counts start anew
    got = go([("c", 100.0, day(0, 300))])
    assert got == [("a", 2, "zombie"), ("c", 2, "done"), ("z", 1, "zombie")]


def by_the_clock(spark, tmp_path, kinds, batches, of, enough):
    """Run a query that never ends by itself, adding a file once the last one's rows were told, until ``enough`` holds."""
    seen, path = [], tmp_path / "in"
    add = lambda n: spark.createDataFrame(batches[n], kinds).coalesce(1).write.parquet(str(path / str(n)))
    add(0)
    stream = spark.readStream.schema(kinds).option("recursiveFileLookup", True).parquet(str(path))
    query = of(stream).writeStream.foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        added, until = 1, time.monotonic() + 60
        while not enough(seen) and time.monotonic() < until:
            assert query.isActive
            if seen and added < len(batches):
                time.sleep(2)  # longer than what is kept
                add(added)
                added += 1
            time.sleep(0.2)
    finally:
        query.stop()
    return seen


def test_timers_by_the_machines_clock(spark, tmp_path):
    kinds = "task string, progress double, ts timestamp"
    seen = by_the_clock(spark, tmp_path, kinds, [[("a", 10.0, day(0)), ("b", 100.0, day(0))]], lambda s: timers.watched_tasks(s, 1, 9, None), lambda seen: len(seen) > 2)
    assert sorted(seen) == [("a", 1, "running"), ("a", 1, "zombie"), ("b", 1, "done")]


def test_counts_by_receiver_over_restarts(spark, tmp_path):
    kinds, seen = "message string, receiver string", []
    go = lambda rows: run_state(spark, tmp_path, kinds, rows, lambda s: timers.counted_deliveries(s, 3), seen)
    assert go([("m", "r"), ("m", "r"), ("n", None)]) == [("m", "r", 2, 2, "process"), ("n", None, 1, 1, "process")]
    assert go([("m", "s"), ("n", None)]) == [("m", "s", 1, 3, "fail_queue"), ("n", None, 2, 2, "process")]


def test_counts_have_a_time_to_live(spark, tmp_path):
    seen = by_the_clock(spark, tmp_path, "message string, receiver string", [[("m", "r"), ("m", "r")], [("m", "r")]], lambda s: timers.counted_deliveries(s, 3, 1), lambda seen: len(seen) > 1)
    assert seen == [("m", "r", 2, 2, "process"), ("m", "r", 1, 1, "process")]


@pytest.fixture
def files(tmp_path):
    for name in ("a/0/x.png", "a/0/y.png", "a/1/.hidden", "a/1/z.pid", "b/q.png", "other/stay.png"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    (tmp_path / "root/b/empty/deep").mkdir(parents=True)
    return tmp_path / "root"


def there(folder):
    return sorted(str((at := os.path.join(d, n)))[len(str(folder)) + 1 :] for d, ds, fs in os.walk(folder) for n in (*ds, *fs))


def roots_of(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_trees_are_listed_once(spark, files, tmp_path):
    rows = deletes.tree(roots_of(spark, f"file://{files}/", f"file://{files}/a", f"file://{files}/none", None), f"file://{tmp_path}/shared").collect()
    assert sorted(r.path for r in rows) == [f"file://{files}/{p}" for p in there(files)]
    assert {r.is_folder for r in rows if r.path.endswith(("0", "empty"))} == {True} and sum(r.bytes or 0 for r in rows) == 30


def test_deletes_keep_what_is_asked(spark, files, tmp_path):
    shared, roots = f"file://{tmp_path}/shared", roots_of(spark, f"file://{files}/a", f"file://{files}/b", f"file://{files}/none")
    before, keep = there(files), F.col("path").endswith(".pid")
    short = lambda rows: {(r.path.removeprefix(f"file://{files}/"), r.outcome) for r in rows.collect()}
    dry = short(deletes.delete_trees(roots, shared, keep, dry_run=True))
    assert there(files) == before
    assert {p for p, o in dry if o == "kept"} == {"a", "a/1", "a/1/z.pid"}
    done = deletes.delete_trees(roots, shared, keep)
    assert short(done) == {(p, "deleted" if o == "would_delete" else o) for p, o in dry}
    assert there(files) == ["a", "a/1", "a/1/z.pid", "other", "other/stay.png"]
    (files / "b").mkdir()  # reading the result again deletes nothing
    assert {(r.outcome, r.is_folder, r.n, r.bytes) for r in deletes.outcome_counts(done).collect()} == {("deleted", False, 4, 20), ("kept", False, 1, 5), ("deleted", True, 5, None), ("kept", True, 2, None)}
    assert (files / "b").exists()


def test_a_second_attempt_tells_the_same(spark, files):
    rows = spark.createDataFrame([(f"file://{files}/a/0/x.png", False, 5), (f"file://{files}/a/1", True, None), (f"file://{files}/b/empty/deep", True, None)], "path string, is_folder boolean, bytes long")
    first, second = (sorted((r.path[len(f"file://{files}") :], r.outcome) for r in deletes.removed(rows).collect()) for _ in range(2))
    assert first == second == [("/a/0/x.png", "deleted"), ("/a/1", "kept"), ("/b/empty/deep", "deleted")]


def test_folders_may_stay(spark, files, tmp_path):
    done = deletes.delete_trees(roots_of(spark, f"file://{files}/b"), f"file://{tmp_path}/shared", folders=False).collect()
    assert [r.outcome for r in done] == ["deleted"] and (files / "b/empty/deep").exists() and not (files / "b/q.png").exists()
