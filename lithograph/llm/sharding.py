"""Contiguous shards of nearly equal bytes (operator 6).

Rows are put in ascending ``doc_id`` order over range partitions. Each partition gives its total of bytes and rows;
running sums over these few totals are the partitions' offsets, and a running sum inside each partition completes the
global position of every document. The byte axis is then cut at equal targets. No task sees more than one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written


def prefix_sums(rows: DataFrame, order: list[str], sums: dict[str, str], n: int | None = None) -> DataFrame:
    """Add exclusive running sums over ``rows`` in ``order``: ``sums`` maps a new column to the column that it adds up.

    Equal rows are in any order among themselves; nulls come first. The offsets table has one row per partition, which
    bounds what is broadcast. ``rows`` should be narrow: it is written once, so that partition numbers can't change.
    """
    n = n or partitions(rows.sparkSession)
    dealt = written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "prefix")
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_total_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_total_{k}").over(before), F.lit(0)).alias(f"_offset_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_local_{k}") for k, c in sums.items()])
    summed = local.join(F.broadcast(offsets), "_part")
    return summed.select(*rows.columns, *[(F.col(f"_local_{k}") + F.col(f"_offset_{k}")).alias(k) for k in sums])


def placed_by_bytes(rows: DataFrame, n_shards: int) -> DataFrame:
    """Rows (row, doc_id, text) as ``shard_by_bytes`` tells, with their ``row``."""
    sized = rows.select(
        "row",
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("_one"),
    )
    placed = written(prefix_sums(sized, ["doc_id", "text_crc32", "size"], {"_start": "size", "_row": "_one"}), "placed")
    total = placed.agg(F.max(F.col("_start") + F.col("size"))).first()[0] or 1
    shard = F.least(F.lit(n_shards - 1), F.expr(f"(2 * _start + size) * {n_shards} div {2 * total}")).cast("int")
    sharded = placed.withColumn("shard", shard)
    firsts = sharded.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows at most
    return sharded.join(F.broadcast(firsts), "shard").select(
        "row", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_by_bytes(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Deal documents into ``n_shards`` contiguous shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law (``bytes``), shard, slot, grown_shard (null).
    A document lies in the shard that holds the middle of its bytes, so shards differ from the target by less than the
    largest document. Null texts count as empty (size 1, crc32 0); null doc_ids come first; repeated doc_ids keep
    separate slots; an empty table gives no rows; other columns are ignored. Equal texts aren't kept together, since a
    group may hold more than a shard's share.
    """
    return placed_by_bytes(docs.select(F.lit(None).cast("long").alias("row"), "doc_id", "text"), n_shards).drop("row")


def sharded_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """``docs`` with all their columns and those of ``shard_by_bytes`` (in place of columns of the same names).

    Rows are written once with a number of their own; only narrow rows are put in order, and their shards are joined to the
    written ones by that number, so repeated rows have slots of their own.
    """
    told = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    numbered = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("whole")), "numbered")
    narrow = numbered.select("row", "whole.doc_id", "whole.text")
    placed = placed_by_bytes(narrow, n_shards).select(F.col("row").alias("of"), F.struct(*told).alias("place"))
    met = numbered.join(placed.hint("merge"), F.col("row") == F.col("of"))
    return met.select(*[F.col("whole")[c].alias(c) for c in docs.columns if c not in told], "place.*")
