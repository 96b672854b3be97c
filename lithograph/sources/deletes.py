"""Listing and deleting trees of files in tasks: folders are listed level by level, files deleted by batches.

The driver holds no name: what is to be listed next, and what was done, are tables in the shared folder. A task that is run
again deletes what is still there, and a file that isn't there any more counts as deleted, so the result is the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tile_sink import at

LISTED = "path string, is_folder boolean, bytes long, depth int"
DONE = "path string, is_folder boolean, bytes long, outcome string, error string"
#: Files deleted by one call of a task, and rows of a task's list that are held at once.
BATCH, ROWS_AT_ONCE = 1000, 10_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly by their path: folders' lists differ much in length."""
    return rows.repartition(F.xxhash64("path"))


def inside(folders: DataFrame, depth: int) -> DataFrame:
    """LISTED rows of what lies right inside of folders (path); folders that aren't there hold nothing."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, base, scheme = at(folder)
                found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
                for i in range(0, len(found), ROWS_AT_ONCE):
                    some = found[i : i + ROWS_AT_ONCE]
                    kinds = [f.type == fs.FileType.Directory for f in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([scheme + f.path for f in some], pa.string()), pa.array(kinds, pa.bool_()), pa.array([None if k else f.size for f, k in zip(some, kinds, strict=True)], pa.int64()), pa.array([depth] * len(some), pa.int32())],
                        ["path", "is_folder", "bytes", "depth"],
                    )

    return folders.select("path").mapInArrow(listed, LISTED)


def tree(roots: DataFrame, shared: str) -> DataFrame:
    """LISTED rows of all that lies below the roots (path), once each: one job for each level of folders.

    Roots may lie in each other or occur twice. ``shared`` is a folder that all executors see, where levels are written.
    """
    spark, place = roots.sparkSession, f"{shared.rstrip('/')}/tree-{uuid.uuid4().hex}"
    top, depth = roots.select(F.regexp_replace("path", "(?<=[^/:])/+$", "").alias("path")).where("path is not null").distinct(), 1
    while True:
        spread(inside(top, depth)).write.parquet(f"{place}/depth={depth}")
        top = spark.read.schema(LISTED).parquet(f"{place}/depth={depth}").where("is_folder").select("path")
        if top.isEmpty():
            break
        depth += 1
    found = spark.read.schema(LISTED).option("basePath", place).parquet(place)
    return found.groupBy("path").agg(F.any_value("is_folder").alias("is_folder"), F.any_value("bytes").alias("bytes"), F.max("depth").alias("depth"))


def removed(rows: DataFrame) -> DataFrame:
    """DONE rows of files and, where nothing is in them, folders (path, is_folder, bytes) that are deleted on the way.

    Outcomes: deleted (also what is gone already), kept (a folder that holds something), failed with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for part in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                outcomes, errors = [], []
                for path, is_folder in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    outcome, error = "deleted", None
                    try:
                        store, base, _ = at(path)
                        if not is_folder:
                            store.delete_file(base)
                        elif store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                            outcome = "kept"
                        else:
                            store.delete_dir(base)
                    except FileNotFoundError:
                        pass
                    except OSError as e:
                        outcome, error = "failed", str(e)
                    outcomes.append(outcome)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(outcomes, pa.string()), pa.array(errors, pa.string())], [c.split()[0] for c in DONE.split(", ")])

    return rows.select("path", "is_folder", "bytes").mapInArrow(run, DONE)


def delete_trees(roots: DataFrame, shared: str, keep: Column | None = None, dry_run: bool = False, folders: bool = True) -> DataFrame:
    """Delete all files below the roots (path) but those for which ``keep`` (of path and bytes) holds; then, with
    ``folders``, the folders that hold nothing any more, inner ones first and the roots last.

    Gives DONE rows of what was met, kept files and folders too. With ``dry_run``, nothing is deleted and what would be has
    the outcome ``would_delete``; folders are told by what would be left in them. A null ``keep`` doesn't hold. The rows are
    a table in ``shared``, so reading them again deletes nothing.
    """
    spark, place = roots.sparkSession, f"{shared.rstrip('/')}/deletes-{uuid.uuid4().hex}"
    roots = roots.select(F.regexp_replace("path", "(?<=[^/:])/+$", "").alias("path")).where("path is not null").distinct()
    tree(roots, shared).write.parquet(f"{place}/listed")
    listed = spark.read.schema(LISTED).parquet(f"{place}/listed")
    stays = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)
    told = listed.where("not is_folder").withColumn("stays", stays)
    done = told.select("path", "is_folder", "bytes", F.when(F.col("stays"), "kept").otherwise("would_delete").alias("outcome"), F.lit(None).cast("string").alias("error"))
    if not dry_run:
        done = done.where("outcome = 'kept'").unionByName(removed(spread(told.where("not stays"))))
    done.write.parquet(f"{place}/done/files")
    if not folders:
        return spark.read.schema(DONE).parquet(f"{place}/done/files")
    every = listed.where("is_folder").select("path").unionByName(roots).distinct().withColumn("parts", F.size(F.split("path", "/")))
    if dry_run:
        left = spark.read.schema(DONE).parquet(f"{place}/done/files").where("outcome = 'kept'").select(F.split("path", "/").alias("parts"))
        above = left.select(F.explode(F.expr("transform(sequence(1, size(parts) - 1), n -> array_join(slice(parts, 1, n), '/'))")).alias("path")).distinct()
        told = every.join(above.withColumn("holds", F.lit(True)), "path", "left")
        outcome = F.when(F.col("holds"), "kept").otherwise("would_delete")
        told.select("path", F.lit(True).alias("is_folder"), F.lit(None).cast("long").alias("bytes"), outcome.alias("outcome"), F.lit(None).cast("string").alias("error")).write.parquet(f"{place}/done/folders")
    else:
        for n, in every.select("parts").distinct().orderBy(F.desc("parts")).collect():  # a number for each level of folders
            level = every.where(F.col("parts") == n).select("path", F.lit(True).alias("is_folder"), F.lit(None).cast("long").alias("bytes"))
            removed(spread(level)).write.parquet(f"{place}/done/folders-{n}")
    return spark.read.schema(DONE).option("recursiveFileLookup", True).parquet(f"{place}/done")


def outcome_counts(done: DataFrame) -> DataFrame:
    """outcome, is_folder, n and bytes of what ``delete_trees`` told."""
    return done.groupBy("outcome", "is_folder").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
