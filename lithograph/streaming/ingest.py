"""Notifications of created and removed products as a stream: decoding, and idempotent batches of upserts and deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import s3_key_decoded

RECORDS = "Records array<struct<eventName: string, eventTime: string, s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>"


def notifications(messages: DataFrame) -> DataFrame:
    """bucket, key, event_name, ts of messages (body), with or without an envelope around them."""
    inner = F.coalesce(F.get_json_object("body", "$.Message"), F.col("body"))
    records = messages.select(F.explode(F.from_json(inner, RECORDS)["Records"]).alias("r"))
    return records.select(
        F.col("r.s3.bucket.name").alias("bucket"), s3_key_decoded(F.col("r.s3.object.key")).alias("key"), F.col("r.eventName").alias("event_name"),
        F.to_timestamp("r.eventTime").alias("ts"),
    )


def decided(events: DataFrame) -> DataFrame:
    """The last event of each (bucket, key) that tells of something made or removed, with its action: build or delete.

    Other events decide nothing: a key that has no more than such gets ignore. Deliveries may repeat and come in any
    order; the last event of a key decides, so applying a batch twice changes nothing.
    """
    name = F.col("event_name")
    action = F.when(name.contains("ObjectCreated"), "build").when(name.contains("ObjectRemoved"), "delete").otherwise("ignore")
    acting = events.select("bucket", "key", "ts", "event_name", action.alias("action"))
    last = acting.groupBy("bucket", "key").agg(F.max(F.struct((F.col("action") != "ignore").alias("acts"), "ts", "event_name", "action")).alias("e"))
    return last.select("bucket", "key", "e.ts", "e.action")


def last_actions(decisions: DataFrame) -> DataFrame:
    """The last decision of each (bucket, key); ignored events never take the place of a build or a delete."""
    last = decisions.groupBy("bucket", "key").agg(F.max(F.struct((F.col("action") != "ignore").alias("acts"), "ts", "action")).alias("e"))
    return last.select("bucket", "key", "e.ts", "e.action")


def applied(table: DataFrame, batch: DataFrame) -> DataFrame:
    """``table`` (bucket, key, ts, action) with the batch's later decisions in place of its own."""
    return last_actions(table.unionByName(batch))


def run_batches(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that decides each micro-batch and gives it to ``apply``; ends when the source is read."""
    return events.writeStream.foreachBatch(lambda batch, number: apply(decided(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended_to(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``run_batches``: a batch's decisions go to a place of their own below ``folder``.

    Only changed keys are written; a batch that is given again after a failure writes the same place again; nothing is
    kept but what is in the folder.
    """
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The table that the batches below ``folder`` leave: the last decision of each key."""
    return last_actions(spark.read.parquet(folder))


def routed(decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """Decisions with their outcome. ``sources``: bucket, key, supported, oversize, error (what processing said, or null).

    Products that aren't supported are rejected; oversize ones too, and forwarded to the service that can do them;
    cancelled ones and files that no reader knows end here; other errors are delivered again.
    """
    told = decisions.join(sources, ["bucket", "key"], "left")
    error, build = F.col("error"), F.col("action") == "build"
    outcome = (
        F.when(F.col("action") == "ignore", "ignored").when(build & ~F.coalesce("supported", F.lit(False)), "rejected")
        .when(build & F.coalesce("oversize", F.lit(False)), "forwarded").when(error == "cancelled", "cancelled").when(error.contains("no compatible image reader"), "failed")
        .when(error.isNotNull(), "retry").otherwise("processed")
    )
    return told.select(*decisions.columns, outcome.alias("outcome"))


def split_by_outcome(routed_rows: DataFrame, folder: str, number: int) -> None:
    """Write a micro-batch's branches below ``folder``: forwarded to the service's queue, retried and dead letters."""
    for name, kept in (("forward", "outcome = 'forwarded'"), ("retry", "outcome = 'retry'"), ("dead", "outcome in ('failed', 'rejected')")):
        routed_rows.where(kept).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")


def retry_counts(events: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """Stateful count of deliveries per message: after ``most``, they go to the fail queue. Batch or stream."""
    counts = events.groupBy(*key).agg(F.count(F.lit(1)).alias("deliveries"))
    return counts.withColumn("route", F.when(F.col("deliveries") >= most, "fail_queue").otherwise("process"))


def single_flight(requests: DataFrame, key: str = "cache_hash", at: str = "ts", within: str = "1 hour") -> DataFrame:
    """Of a stream's requests for the same work within a time, the first alone; state older than that is dropped."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
