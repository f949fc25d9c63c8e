"""Event-time windows that work on a batch table and, unchanged, on a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.storage import scratch, shared_dir

LATE = "1 day"


def _watermarked(events: DataFrame, late: str = LATE) -> DataFrame:
    """Event times as instants (UTC); on a stream, state older than ``late`` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def _flat(grouped: DataFrame) -> DataFrame:
    plain = [c for c in grouped.columns if c != "w"]
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *plain)


def tumbling(events: DataFrame, width: str, key: str = "event_type") -> DataFrame:
    """(start, end, key, n, s): count and sum of value per window and key."""
    return _flat(_watermarked(events).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("s")))


def sliding(events: DataFrame, width: str, step: str, key: str = "event_type") -> DataFrame:
    return _flat(_watermarked(events).groupBy(F.window("ts", width, step).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("s")))


def session(events: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    """(start, end, key, n): runs of events of a key with less than ``gap`` between neighbours."""
    return _flat(_watermarked(events).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")))


def deduplicate(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Each event once: within the watermark on a stream, overall on a table."""
    return _watermarked(events, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_stream(spark: SparkSession, folder: str, files: str, build: Callable[[DataFrame], DataFrame], name: str, keys: tuple[str, ...] = ("start", "end", "event_type")) -> DataFrame:
    """Run a streaming query over the ``files`` (a glob) of a folder until all are read; its result as a table.

    Batches hand on only the rows that changed, so state behind the watermark is dropped; the last row of each of
    ``keys`` is the result.  The state and progress live in shared storage, so a restarted query goes on where it stopped.
    """
    schema = spark.read.parquet(f"{folder}/{files}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    box: list[DataFrame] = []

    def keep(batch: DataFrame, number: int) -> None:
        box.append(scratch(batch.withColumn("_batch", F.lit(number)), name))

    query = build(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = box[0]
    for more in box[1:]:
        changes = changes.unionByName(more)
    values = [c for c in changes.columns if c not in (*keys, "_batch")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_last"))
    return last.select(*keys, "_last.*")
