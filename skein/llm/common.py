"""Shared plumbing: table access, scratch tables on shared storage, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.storage import drop_scratch, scratch, shared_dir

__all__ = ["arrow_rows", "bounded_sample", "drop_scratch", "join_unique", "partitions", "rows_of", "scratch", "shared_dir", "small", "table", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, chosen by the hash of their id: a count, then a filter, so no task or driver holds more."""
    n = df.count()
    share = 1.0 if n <= most else 0.98 * most / n
    return df.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int(share * (1 << 40))).limit(most)


#: A key is hot if it holds more than this part of the rows, so there are fewer than this many.
HOT = 1000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table that has one row per key, where few keys of ``left`` may hold most of its rows.

    Rows of hot keys stay where they are and meet their fewer than ``HOT`` partners by broadcast; all others are
    shuffled by key, none of which is large.  Both sides are read twice, so pass written tables.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > max(HOT, left.count() / HOT)).select(*keys)
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    return left.join(few, keys).unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys))


#: Rows of keys and digests (some tens of bytes each) up to which a table is broadcast.
SMALL = 500_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A written table of short rows with a broadcast hint if it is counted to be small; else unchanged, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def text_key(text: Column) -> Column:
    """A 16-byte digest of a text (null: empty), as its identity."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run meanwhile hand Python at most ``most`` rows at once, for rows that may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rows_of(batch: pa.RecordBatch, most_bytes: int = 4 << 20):
    """Slices of a batch of at most about ``most_bytes`` (one row at least), so memory stays bounded."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
