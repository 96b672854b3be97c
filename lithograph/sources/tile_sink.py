"""A sink for tiles with a commit: each tile is a file of its own, and a manifest tells which of them count.

``df.write.format("tiles")`` writes rows with the columns of ``sinks.TILE`` below a root:

* A task writes each tile under a temporary name next to its place, and at its end renames all of them and writes its part of
  the manifest. If it fails before, it deletes what it wrote, and its retry writes the same places again.
* When all tasks are done, the job's commit writes one small file that names the parts of the tasks that count, so a part of
  a lost or a second attempt is never read. The driver handles one name per task, never one per tile.
* If the job fails, its abort deletes the tiles of the tasks that had ended, but for those that an earlier job committed.

``committed`` reads the manifest. Later jobs replace tiles of earlier ones with the same place.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PARTS = [("image_id", pa.string()), ("level", pa.int32()), ("col", pa.int32()), ("row", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("format", pa.string()), ("path", pa.string()), ("bytes", pa.int64())]
MANIFEST = "_manifest"
#: Tiles of a manifest's part that are written at once.
ROWS_AT_ONCE = 10_000


def put_file(store, path: str, data: bytes) -> None:
    """Write a file under another name, then put it in its place."""
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as stream:
        stream.write(data)
    store.move(part, path)


def at(root: str):
    """(file system, path, what stands before paths in URIs) of a root."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", root) else (fs.LocalFileSystem(), root)
    return store, base.rstrip("/"), root[: len(root) - len(base)] if root.endswith(base) else ""


def safe_name(name: str) -> str:
    """An image's name as that of a folder: no part of a path leads elsewhere."""
    if not name or name.startswith(".") or "/" in name or "\\" in name or name == MANIFEST:
        raise ValueError(f"no name for a folder of tiles: {name!r}")
    return name


@dataclass
class Ended(WriterCommitMessage):
    part: str
    tiles: int


class TileWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator[Row]) -> Ended:
        import pyarrow.parquet as pq

        task = TaskContext.get()
        attempt = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        store, base, scheme = at(self.root)
        part = f"{base}/{MANIFEST}/{self.job}/part-{attempt}.parquet"
        moves, rows, made = [], [], set()
        store.create_dir(f"{base}/{MANIFEST}/{self.job}", recursive=True)
        try:
            for r in iterator:
                folder = f"{base}/{safe_name(r.image_id)}/image_files/{int(r.level)}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                name = f"{int(r.col)}_{int(r.row)}.{r.format}"
                temporary, data = f"{folder}/.{name}-{self.job}-{attempt}", bytes(r.data)
                moves.append((temporary, f"{folder}/{name}"))
                with store.open_output_stream(temporary) as stream:
                    stream.write(data)
                rows.append((r.image_id, r.level, r.col, r.row, r.w, r.h, r.format, f"{scheme}{folder}/{name}", len(data)))
            with pq.ParquetWriter(store.open_output_stream(part), pa.schema(PARTS)) as out:
                for some in (rows[i : i + ROWS_AT_ONCE] for i in range(0, len(rows), ROWS_AT_ONCE)):
                    out.write_table(pa.table([pa.array(c, k) for c, (_, k) in zip(zip(*some, strict=True), PARTS, strict=True)], pa.schema(PARTS)))
            for temporary, place in moves:
                store.move(temporary, place)
        except BaseException:
            for path in [part, *(t for t, _ in moves)]:
                with contextlib.suppress(OSError):
                    store.delete_file(path)
            raise
        return Ended(part.rsplit("/", 1)[1], len(rows))

    def commit(self, messages: list[Ended | None]) -> None:
        ended = [m for m in messages if m is not None]
        store, base, _ = at(self.root)
        told = {"at": time.time_ns(), "tiles": sum(m.tiles for m in ended), "parts": sorted(m.part for m in ended)}
        put_file(store, f"{base}/{MANIFEST}/{self.job}.json", json.dumps(told).encode())

    def abort(self, messages: list[Ended | None]) -> None:
        import pyarrow.parquet as pq

        store, base, scheme = at(self.root)
        kept = {f"{base}/{MANIFEST}/{job}/{part}" for job, told in commits(self.root) for part in told["parts"]}
        for message in messages:
            if message is None:
                continue
            mine = f"{base}/{MANIFEST}/{self.job}/{message.part}"
            paths = pq.read_table(mine, columns=["path"], filesystem=store).column("path").to_pylist()
            earlier = set()
            for part in kept:  # only what was never committed goes
                earlier |= set(pq.read_table(part, columns=["path"], filesystem=store).column("path").to_pylist()) & set(paths)
            for path in [p.removeprefix(scheme) for p in paths if p not in earlier] + [mine]:
                with contextlib.suppress(OSError):
                    store.delete_file(path)


class TileSink(DataSource):
    """``df.write.format("tiles").mode("append").save(root)`` of ``sinks.TILE`` rows."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def writer(self, schema, overwrite: bool) -> TileWriter:
        missing = {n for n, _ in PARTS[:7]} | {"data"}
        missing -= set(schema.names)
        if missing:
            raise ValueError(f"tiles lack the columns {', '.join(sorted(missing))}")
        if overwrite:
            raise ValueError("tiles are appended; remove an image's folder to replace it")
        return TileWriter(self.options["path"], uuid.uuid4().hex)


def commits(root: str) -> list[tuple[str, dict]]:
    """(job, what its commit tells) below ``root``, in the order of commits."""
    from pyarrow import fs

    store, base, _ = at(root)
    found = store.get_file_info(fs.FileSelector(f"{base}/{MANIFEST}", allow_not_found=True))
    told = []
    for info in found:
        if info.is_file and info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with store.open_input_stream(info.path) as stream:
                told.append((info.base_name.removesuffix(".json"), json.loads(stream.read())))
    return sorted(told, key=lambda t: (t[1]["at"], t[0]))


def write_tiles(tiles: DataFrame, root: str) -> None:
    """Write TILE rows below ``root``, all or none."""
    tiles.sparkSession.dataSource.register(TileSink)
    tiles.write.format("tiles").mode("append").save(root)


def committed(spark: SparkSession, root: str) -> DataFrame:
    """image_id, level, col, row, w, h, format, path, bytes of the tiles that count: of each place, the last job's."""
    _, base, scheme = at(root)
    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'long' if k == pa.int64() else 'int'}" for n, k in PARTS)
    whole = None
    for number, (job, told) in enumerate(commits(root)):
        if told["tiles"]:
            rows = spark.read.schema(schema).parquet(*[f"{scheme}{base}/{MANIFEST}/{job}/{p}" for p in told["parts"]]).withColumn("_job", F.lit(number))
            whole = rows if whole is None else whole.unionByName(rows)
    if whole is None:
        return spark.createDataFrame([], schema)
    last = Window.partitionBy("image_id", "level", "col", "row").orderBy(F.desc("_job"), "path")
    return whole.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_job", "_last")
