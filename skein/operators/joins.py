"""Joins beyond a plain ``DataFrame.join``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Join on pairs of columns; ``residual`` is part of the condition, so outer rows that fail it stay."""
    condition = reduce(lambda a, b: a & b, [left[x] == right[y] for x, y in on])
    return left.join(right, condition & residual if residual is not None else condition, how)


def semi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    return equi_join(left, right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` without a partner (NOT EXISTS)."""
    return equi_join(left, right, on, "left_anti")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN with three-valued logic, as an anti join: no row passes if ``right`` holds a NULL.

    The test for a NULL is one aggregated row, so both large sides join by their key.
    """
    facts = right.agg(F.count("*").alias("_rows"), F.count(other).alias("_known"))
    open_ = left.join(F.broadcast(facts), F.lit(True)).where((F.col("_rows") == F.col("_known")) & ((F.col("_rows") == 0) | F.col(column).isNotNull()))
    keys = right.where(F.col(other).isNotNull()).select(F.col(other).alias("_key"))
    return open_.join(keys, F.col(column) == F.col("_key"), "left_anti").drop("_rows", "_known")


def intersect_keys(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """The keys that all tables share (one column, distinct): a chain of semi joins that keeps one partitioning."""
    first, name = tables[0]
    keys = first.select(F.col(name).alias("key")).where("key is not null").distinct()
    for df, other in tables[1:]:
        keys = keys.join(df.select(F.col(other).alias("key")).distinct(), "key", "left_semi")
    return keys


def range_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Pairs with low <= point < high, by an equi-join on buckets of ``width`` instead of a nested loop.

    Each range is copied to the buckets it meets, so choose ``width`` near a typical range's length.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    dealt = ranges.withColumn("_bucket", F.explode(F.sequence(bucket(low), F.floor((F.col(high) - 1) / width)))).where(F.col(high) > F.col(low))
    return points.withColumn("_bucket", bucket(point)).join(dealt, "_bucket").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the latest row of ``right`` not after it: one shuffle, no pair explosion."""
    row = F.struct(*[F.col(c) for c in left.columns])
    mine = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).alias("_v"))
    theirs = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(*values).alias("_v"))
    line = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = mine.unionByName(theirs).withColumn("_last", F.last("_v", ignorenulls=True).over(line)).where("_side = 1")
    return both.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def salted_join(large: DataFrame, small: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """Inner join where a few keys of ``large`` are hot and ``small`` is too large to broadcast."""
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [on, "_salt"]).drop("_salt")
