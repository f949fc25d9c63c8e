"""Session factory with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins, splits skewed partitions and merges small ones at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A local session; on a cluster, pass ``SETTINGS`` to spark-submit and size partitions to the data."""
    build = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **more}.items():
        build = build.config(key, value)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dialect_session(spark: SparkSession) -> SparkSession:
    """A sibling session (own temporary views and settings) with the engine's scalar semantics.

    Division by zero, overflow of a cast and text that does not parse give NULL, so ANSI mode is off.
    """
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.ansi.enabled", "false")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own
