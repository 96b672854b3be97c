"""Labelled rasters read by windows: only the bytes of a window's lines and samples are fetched, never a whole file.

Two ways lead to the same rows (WINDOW: path, band, y, x, h, w, dtype, data):

* ``spark.read.format("labelled_raster")``, a Python data source that plans one input partition per window of a file (runs of
  windows with about equal bytes, if there are more than MOST_TASKS) and leaves out files, bands and windows that filters on
  path, band, y and x rule out. The driver reads the headers, which suits up to some hundred thousand files.
* ``windows_of`` and ``read_windows``: headers and windows are rows, so that any number of files is planned by Spark too.

Sample places follow from the order of samples: BSQ has a record for each line of a band, BIL for each band of a line, BIP for
each sample of a line, and each record may begin with a prefix.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .images import SAMPLES, dealt_over, is_wrapper, label_items, wrapper_places

WINDOW = "path string, band int, y int, x int, h int, w int, dtype string, data binary"
FIELDS = [("path", pa.string()), ("band", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("dtype", pa.string()), ("data", pa.binary())]
LAYOUT = "path string, width int, height int, bands int, org string, start long, size int, prefix int, dtype string"
#: Lines and samples of a window; bytes at a file's beginning that are read to plan, and the longest label.
LINES, SAMPLES_WIDE, HEAD_BYTES, MOST_LABEL = 1024, 4096, 1 << 14, 1 << 24
#: Partitions of a scan; bytes of samples and number of files that a batch of rows holds, and what a window costs besides its
#: own bytes.
MOST_TASKS, BATCH_BYTES, MOST_FILES, WINDOW_COST = 256, 1 << 22, 256, 1 << 12


@dataclass(frozen=True)
class Layout:
    """Where the samples of a labelled raster lie in its file."""

    path: str
    width: int
    height: int
    bands: int
    org: str
    start: int
    size: int
    prefix: int
    dtype: str

    def ranges(self, bands: list[int], y: int, x: int, h: int, w: int) -> Iterator[tuple[int, int]]:
        """(offset, length) of the bytes of a window, in file order; neighbouring ones are joined."""
        record = self.prefix + self.size * (self.bands if self.org == "BIP" else self.width)
        at = end = -1
        for offset, length in self._pieces(record, bands, y, x, h, w):
            if offset == end:
                end += length
                continue
            if at >= 0:
                yield at, end - at
            at, end = offset, offset + length
        if at >= 0:
            yield at, end - at

    def _pieces(self, record: int, bands: list[int], y: int, x: int, h: int, w: int) -> Iterator[tuple[int, int]]:
        whole = w == self.width and self.org != "BIP"
        skip, length = (0, record) if whole else (self.prefix + x * self.size, w * self.size)
        if self.org == "BSQ":
            for band in bands:
                first = self.start + (band * self.height + y) * record
                if whole:
                    yield first, h * record
                else:
                    yield from ((first + line * record + skip, length) for line in range(h))
        elif self.org == "BIL":
            for line in range(y, y + h):
                yield from ((self.start + (line * self.bands + band) * record + skip, length) for band in bands)
        else:
            yield from ((self.start + (line * self.width + x) * record, w * record) for line in range(y, y + h))

    def window(self, source: pa.NativeFile, bands: list[int], y: int, x: int, h: int, w: int) -> np.ndarray:
        """bands x h x w of a window: its ranges alone are read from ``source``."""
        parts = []
        for offset, length in self.ranges(bands, y, x, h, w):
            source.seek(offset)
            data = source.read(length)
            if len(data) != length:
                raise ValueError(f"{self.path} ends before its samples do")
            parts.append(data)
        data = np.frombuffer(b"".join(parts), np.uint8)
        if self.org == "BIP":
            rows = data.reshape(h, w, self.prefix + self.bands * self.size)[:, :, self.prefix :]
            cube = np.ascontiguousarray(rows).view(self.dtype).reshape(h, w, self.bands)[:, :, bands]
            return cube.transpose(2, 0, 1)
        order = (len(bands), h) if self.org == "BSQ" else (h, len(bands))
        rows = data.reshape(*order, -1)
        rows = rows[:, :, self.prefix :] if w == self.width else rows
        cube = np.ascontiguousarray(rows).view(self.dtype).reshape(*order, w)
        return cube if self.org == "BSQ" else cube.transpose(1, 0, 2)


def opened(path: str) -> pa.NativeFile:
    """A file of any file system that the path's scheme names, open for reads at any place."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


def layout_of(path: str, source: pa.NativeFile) -> Layout:
    """The layout that a file's label tells; the label alone is read, inside a wrapper or not."""
    head, inner = source.read(HEAD_BYTES), 0
    if head[:7] != b"LBLSIZE" and is_wrapper(head):
        inner = wrapper_places(head)[0]
        source.seek(inner)
        head = source.read(HEAD_BYTES)
    found = re.match(rb"LBLSIZE\s*=\s*(\d+)", head)
    if not found or (head[:7] != b"LBLSIZE") or not 0 < int(found[1]) <= MOST_LABEL:
        raise ValueError(f"{path} has no label")
    label = int(found[1])
    if label > len(head):
        head += source.read(label - len(head))
    items = label_items(head)
    size, kind = SAMPLES[items["FORMAT"]]
    big = items.get("INTFMT", "HIGH") == "HIGH" if kind in "ui" else items.get("REALFMT", "IEEE") == "IEEE"
    start = inner + label + int(items.get("NLB", 0)) * int(items.get("RECSIZE", 0))
    return Layout(path, int(items["NS"]), int(items["NL"]), int(items["NB"]), items.get("ORG", "BSQ"), start, size, int(items.get("NBB", 0)), f"{'>' if big else '<'}{kind}{size}")


def window_rows(windows: Iterable[Window]) -> Iterator[pa.RecordBatch]:
    """Rows of windows, many small ones in a batch; a file is opened once for windows that follow each other."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=pa.schema(FIELDS))

    rows, held, source, path = [], 0, None, None
    try:
        for p in windows:
            if p.layout.path != path:
                if source is not None:
                    source.close()
                source, path = opened(p.layout.path), p.layout.path
            cube = p.layout.window(source, p.bands, p.y, p.x, p.h, p.w)
            rows += [(path, band, p.y, p.x, p.h, p.w, p.layout.dtype, cube[i].tobytes()) for i, band in enumerate(p.bands)]
            held += cube.nbytes
            if held >= BATCH_BYTES and rows:
                yield batch()
                rows, held = [], 0
    finally:
        if source is not None:
            source.close()
    if rows:
        yield batch()


# -- by rows ------------------------------------------------------------------------------------------------------------


def layouts(paths: DataFrame) -> DataFrame:
    """LAYOUT rows of the labelled rasters that ``paths`` (path) names; a task reads labels alone."""
    names = [c.split()[0] for c in LAYOUT.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in LAYOUT.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with opened(path) as source:
                    told = layout_of(path, source)
                rows.append({n: getattr(told, n) for n in names})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return paths.select("path").mapInArrow(read, LAYOUT)


def windows_of(told: DataFrame, lines: int = LINES, samples: int = SAMPLES_WIDE) -> DataFrame:
    """LAYOUT rows with y, x, h, w of each window of the grid. Filter these rows to read less."""
    cut = lambda size, step: F.explode(F.sequence(F.lit(0), F.col(size) - 1, F.lit(step)))
    grid = told.where("width > 0 and height > 0").select("*", cut("height", lines).alias("y")).select("*", cut("width", samples).alias("x"))
    return grid.withColumn("h", F.least(F.lit(lines), F.col("height") - F.col("y"))).withColumn("w", F.least(F.lit(samples), F.col("width") - F.col("x")))


def read_windows(windows: DataFrame, bands: list[int] | None = None) -> DataFrame:
    """WINDOW rows of ``windows_of`` (of these ``bands``, or all); windows are dealt evenly, also those of one large file."""
    names = [c.split()[0] for c in LAYOUT.split(", ")]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[Window]:
        for batch in batches:
            for row in batch.to_pylist():
                layout = Layout(**{n: row[n] for n in names})
                wanted = [b for b in range(layout.bands) if bands is None or b in bands]
                yield Window(layout, wanted, row["y"], row["x"], row["h"], row["w"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from window_rows(asked(batches))

    return windows.select(*names, "y", "x", "h", "w").repartition("path", "y", "x").mapInArrow(read, WINDOW)


# -- as a data source ---------------------------------------------------------------------------------------------------


@dataclass
class Window(InputPartition):
    layout: Layout
    bands: list[int]
    y: int
    x: int
    h: int
    w: int


@dataclass
class Windows(InputPartition):
    """A run of windows that one task reads."""

    windows: list[Window]


def runs(planned: list[Window], most: int) -> list[InputPartition]:
    """All windows as ``most`` partitions at most, each a run with about the same bytes."""
    if len(planned) <= most:
        return planned
    ends = np.cumsum([WINDOW_COST + len(p.bands) * p.h * p.w * p.layout.size for p in planned])
    cuts = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, most) / most, "left") + 1).tolist()
    return [Windows(planned[a:b]) for a, b in zip([0, *cuts], [*cuts, len(planned)], strict=True) if a < b]


class RasterReader(DataSourceReader):
    #: Columns whose values are known when windows are planned: filters on them are met there and then.
    PLANNED = ("path", "band", "y", "x")
    TESTS = {
        EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
        LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
    }

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.lines, self.samples = int(options.get("lines", LINES)), int(options.get("samples", SAMPLES_WIDE))
        self.tasks = max(1, int(options.get("tasks", MOST_TASKS)))
        self.suffixes = tuple(s for s in options.get("suffixes", ".img,.vic").lower().split(",") if s)
        self.filters: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in self.TESTS and len(f.attribute) == 1 and f.attribute[0] in self.PLANNED:
                self.filters.append((f.attribute[0], f))
            else:
                yield f

    def _fits(self, **values) -> bool:
        return all(self.TESTS[type(f)](values[name], f) for name, f in self.filters if name in values)

    def _files(self) -> list[str]:
        from pyarrow import fs

        scheme = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*:(?://)?)", self.path)
        store, place = fs.FileSystem.from_uri(self.path) if scheme else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(place)
        infos = [found] if found.is_file else store.get_file_info(fs.FileSelector(place, recursive=True))
        names = sorted(i.path for i in infos if i.is_file and (found.is_file or i.path.lower().endswith(self.suffixes)))
        prefix = "" if not scheme else self.path[: len(self.path) - len(place)] if self.path.endswith(place) else scheme[1]
        return [prefix + n for n in names]

    def partitions(self) -> list[InputPartition]:
        planned = []
        for path in self._files():
            if not self._fits(path=path):
                continue
            with opened(path) as source:
                layout = layout_of(path, source)
            bands = [b for b in range(layout.bands) if self._fits(band=b)]
            for y in range(0, layout.height, self.lines):
                for x in range(0, layout.width, self.samples):
                    if bands and self._fits(y=y, x=x):
                        planned.append(Window(layout, bands, y, x, min(self.lines, layout.height - y), min(self.samples, layout.width - x)))
        return runs(planned, self.tasks)

    def read(self, partition: Window | Windows | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # something was planned
            yield from window_rows(partition.windows if isinstance(partition, Windows) else [partition])


class RasterSource(DataSource):
    """``spark.read.format("labelled_raster").load(path)``: a file, or all rasters below a folder.

    Options: ``lines`` and ``samples`` of a window, ``suffixes`` of the files to take, ``tasks`` that a scan has at most.
    """

    @classmethod
    def name(cls) -> str:
        return "labelled_raster"

    def schema(self) -> str:
        return WINDOW

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


def read_rasters(spark: SparkSession, path: str, **options) -> DataFrame:
    """WINDOW rows of the labelled rasters at ``path``; filters on path, band, y and x keep what they rule out unread."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("labelled_raster").options(**{k: str(v) for k, v in options.items()}).load(path)


def window_sums(windows: DataFrame) -> DataFrame:
    """WINDOW rows without data, with n and s: number and sum of their samples."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(d, k) for d, k in zip(batch.column("data").to_pylist(), batch.column("dtype").to_pylist(), strict=True)]
            kept = [batch.column(n) for n, _ in FIELDS[:6]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(v) for v in values], pa.int64()), pa.array([float(v.astype(float).sum()) for v in values], pa.float64())], [*[n for n, _ in FIELDS[:6]], "n", "s"])

    return windows.mapInArrow(add, "path string, band int, y int, x int, h int, w int, n long, s double")


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``content`` of rows (path, content) as files ``root``/path; gives path (whole) and bytes. A retried task writes
    the same files again, each under another name first."""
    from .tile_sink import put_file

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for path, content in zip(paths, data, strict=True):
                put_file(store, f"{base}/{path}", content)
            yield pa.RecordBatch.from_arrays([pa.array([f"{root.rstrip('/')}/{p}" for p in paths], pa.string()), pa.array([len(d) for d in data], pa.int64())], ["path", "bytes"])

    return rows.select("path", "content").mapInArrow(put, "path string, bytes long")


def contents(paths: DataFrame) -> DataFrame:
    """path, content of the files that ``paths`` (path) names: for many small files that a manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda: pa.RecordBatch.from_arrays([pa.array([p for p, _ in files], pa.string()), pa.array([c for _, c in files], pa.binary())], ["path", "content"])
        files, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as source:
                    files.append((path, source.read()))
                held += len(files[-1][1])
                if held >= BATCH_BYTES or len(files) >= MOST_FILES:
                    yield made()
                    files, held = [], 0
        if files:
            yield made()

    return paths.select("path").repartition(dealt_over(paths.sparkSession), "path").mapInArrow(read, "path string, content binary")
