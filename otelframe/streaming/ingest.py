"""Streaming ingest of OTLP/JSON lines, and a live rollup of number points."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from otelframe.functions.attrs import group_key
from otelframe.sources.otlp import FLATTEN, split, stamp_tenants
from otelframe.sources.store import append_batch, utc

#: What the table of rejected lines and rows holds.
REJECTED = "signal string, sender_key string, cause string, value string"


def requests(spark: SparkSession, path: str, max_files: int = 1000, sender: Column | None = None) -> DataFrame:
    """New files of request lines (value), a bounded number in each micro-batch, with the
    key of their sender (``sender``, an expression over ``value`` and the file's
    ``_metadata``; null without one)."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    return lines.select("value", (F.lit(None) if sender is None else sender).cast("string").alias("sender_key"))


def accept(lines: DataFrame, signal: str, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of request lines (value, sender_key): the signal's rows with their
    tenants stamped by ``keys`` (sender_key, tenants; without them tenants stay as sent),
    and what is refused, with the cause: lines that are no requests, and rows whose sender
    may not write their tenant (as JSON)."""
    good, bad = split(lines, signal)
    rejected = bad.select("signal", "sender_key", "cause", "value")
    if keys is None:
        return FLATTEN[signal](good), rejected
    rows, refused = stamp_tenants(FLATTEN[signal](good, ("sender_key",)), keys)
    columns = [c for c in refused.columns if c != "sender_key"]
    return rows.drop("sender_key"), rejected.unionByName(refused.select(F.lit(signal).alias("signal"), "sender_key", F.lit("tenant").alias("cause"), F.to_json(F.struct(*columns)).alias("value")))


def rejected_lines(spark: SparkSession, root: str) -> DataFrame:
    """All that streams have refused: signal, sender_key, cause, value, stream, batch."""
    return spark.read.schema(f"{REJECTED}, stream string, batch long").parquet(f"{root}/rejected")


def ingest(
    spark: SparkSession, source: str, root: str, signal: str, checkpoint: str, every: str | None = "30 seconds",
    sender: Column | None = None, keys: Callable[[SparkSession], DataFrame] | None = None,
) -> StreamingQuery:
    """Append a signal's rows to its table. Late rows are always taken (no watermark); the
    checkpoint replays a failed batch, and the table's ledger knows a batch that it has, so
    that each row is written once. Files are plain ones: batch appends, compaction and
    retention work on the same table. With ``every`` None all that is there is taken at
    once and the query ends.

    ``keys`` gives the table of sender keys, read anew for each batch, so that keys may
    change while the stream runs; rows are then stamped with their sender's tenant. What is
    refused goes to ``root``/rejected, a folder for each stream and batch that a replay
    overwrites."""
    utc(spark)
    stream = uuid.uuid5(uuid.NAMESPACE_URL, f"{checkpoint}/{signal}").hex

    def take(lines: DataFrame, batch: int) -> None:
        rows, rejected = accept(lines, signal, keys(lines.sparkSession) if keys else None)
        rejected.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/rejected/stream={stream}/batch={batch}")
        append_batch(rows, root, signal, f"{stream}-{batch}")

    writer = requests(spark, source, sender=sender).writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{signal}").outputMode("append")
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def live_rollup(points: DataFrame, step: str, group_by: list[str], late: str = "1 hour") -> DataFrame:
    """Count, sum, min and max of streaming number points by tumbling step and group.
    For gauges and deltas; cumulative series go through ``streaming.increments`` first."""
    timed = points.withColumn("ts", F.timestamp_micros("timestamp")).withWatermark("ts", late)
    keys = [group_key(k) for k in group_by]
    rolled = timed.groupBy(F.window("ts", step), "metric_name", *keys).agg(
        F.count("value_double").alias("count"), F.sum("value_double").alias("sum"), F.min("value_double").alias("min"), F.max("value_double").alias("max")
    )
    return rolled.withColumn("time", F.unix_micros("window.start")).drop("window")
