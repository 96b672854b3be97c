"""Helpers that the training-data operators share: the shared folder, cutting lineage, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[ \t\n\x0B\f\r]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a session on one machine (master local) may lack it; it gets a folder of its own, kept in the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lithograph.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lithograph-")
        spark.conf.set("lithograph.shared.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: With it, Spark removes a query's shuffle files when the query ends. Set once and left, for queries may run side by side.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` as Parquet; its shuffle files go at once, for nothing else reads them."""
    conf = df.sparkSession.conf
    if conf.get(CLEANUP, "false") != "true":
        conf.set(CLEANUP, "true")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows doesn't depend on executors that may be lost."""
    path = new_folder(df.sparkSession, name)
    write(df, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, in whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables made by ``written`` that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; null and blank texts give an empty array."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_PATTERN))


def word_count(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_PATTERN))).cast("long")


#: Parts that a key's rows are dealt into in ``salted_join``.
SALTS = 8


def salted_join(rows: DataFrame, per_key: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``per_key`` (a row or none for each value of ``key``, which is no null): a key's rows are dealt
    by a hash of ``by`` into SALTS parts, so that one key may have a third of all rows."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    every = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(every, [key, "_salt"], how).drop("_salt")


#: Bits of a ``Bitmap``: so many for each id, and at least and at most so many in all, which bounds what is sent to each
#: task. Beyond some 10^8 ids nearly all bits are set: the exact join behind the filter then gets nearly all rows.
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26


@dataclass(frozen=True)
class Bitmap:
    """Which remainders of hashed ids occur: tells for sure that an id isn't among those it was made of.

    Only ``words`` are ever broadcast: a plain array can be unpickled where this package isn't installed.
    """

    bits: int
    words: np.ndarray


def hits(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits ``at`` are set in a bitmap's words."""
    return ((words[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)


def bitmap_of(ids: DataFrame, hashed: Column) -> Bitmap:
    """The bitmap of ``hashed`` (a long, null as 0) over the rows of ``ids``; distinct 32-bit words come to the driver."""
    size = max(LEAST_BITS, min(MOST_BITS, 1 << max(1, BITS_PER_ID * ids.count()).bit_length()))
    bit = F.pmod(F.coalesce(hashed, F.lit(0).cast("long")), F.lit(size))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(size // 32, "<u4")
    bitmap[np.array(words["word"])] = np.array(words["bits"]).astype(np.uint32)
    return Bitmap(size, bitmap)


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, led by as many underscores as no column of ``rows`` has, whatever its case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def maybe_among(rows: DataFrame, hashed: Column, bitmap: Bitmap, among: bool = True) -> DataFrame:
    """The ``rows`` whose ``hashed`` has its bit set, or (not ``among``) those that certainly aren't among the bitmap's."""
    sent, columns, schema = rows.sparkSession.sparkContext.broadcast(bitmap.words), len(rows.columns), rows.schema

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = hits(sent.value, np.array(batch.column(columns)))
            yield batch.filter(pa.array(hit if among else ~hit)).select(range(columns))

    bit = F.pmod(F.coalesce(hashed, F.lit(0).cast("long")), F.lit(bitmap.bits))
    kept = [rows[f"`{c}`"] for c in rows.columns]
    return rows.select(*kept, bit.alias(free_name(rows, "bit"))).mapInArrow(filtered, schema)


def passing(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` (doc_id and more) without most of those whose doc_id isn't in ``wanted``; none that is gets lost.

    So large rows needn't be shuffled to be dropped in a join.
    """
    return maybe_among(rows, F.xxhash64("doc_id"), bitmap_of(wanted, F.xxhash64("doc_id")))


def without(rows: DataFrame, gone: DataFrame, on: Callable[[DataFrame], Column], same: Callable[[DataFrame, DataFrame], Column]) -> DataFrame:
    """``rows`` that have no partner in ``gone`` by ``same``; ``on`` is a hash of what ``same`` compares.

    Rows whose bit no partner sets stay where they lie; only the others are joined, at any size of the tables.
    """
    bitmap = bitmap_of(gone, on(gone))
    sure = maybe_among(rows, on(rows), bitmap, among=False)
    open_ = maybe_among(rows, on(rows), bitmap)
    gone = gone.select(*[F.col(f"`{c}`").alias(f"_gone_{c}") for c in gone.columns])
    return sure.unionByName(open_.join(gone.hint("merge"), same(open_, gone), "left_anti").select(*[f"`{c}`" for c in rows.columns]))
