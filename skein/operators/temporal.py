"""System-versioned tables: each row version carries valid_from and valid_to in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FROM, TO = "valid_from", "valid_to"
OPEN = (1 << 63) - 1


def start(rows: DataFrame, at: int) -> DataFrame:
    """First versions of ``rows``, valid from ``at``."""
    return rows.withColumn(FROM, F.lit(at).cast("long")).withColumn(TO, F.lit(OPEN).cast("long"))


def current(versions: DataFrame) -> DataFrame:
    return versions.where(F.col(TO) == OPEN).drop(FROM, TO)


def apply(versions: DataFrame, after: DataFrame, at: int) -> DataFrame:
    """Versions once the current rows became ``after``: rows that went are closed at ``at``, rows that came are opened.

    Rows are compared as multisets, by their count per value.
    """
    columns = after.columns
    was = versions.where(F.col(TO) == OPEN)
    gone = was.select(*columns).exceptAll(after).groupBy(*columns).agg(F.count("*").alias("_gone"))
    came = after.exceptAll(was.select(*columns))
    from pyspark.sql import Window

    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"g.{c}")) for c in columns]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    line = Window.partitionBy(*[F.col(c) for c in columns]).orderBy(F.col(FROM).desc())
    ranked = was.withColumn("_n", F.row_number().over(line)).alias("w").join(gone.alias("g"), condition, "left")
    closed = ranked.select(*[F.col(f"w.{c}").alias(c) for c in columns], FROM, F.when(F.col("_n") <= F.col("_gone"), F.lit(at).cast("long")).otherwise(F.col(TO)).alias(TO))
    return versions.where(F.col(TO) != OPEN).unionByName(closed).unionByName(start(came, at))


def as_of(versions: DataFrame, at: int) -> DataFrame:
    at = min(at, OPEN - 1)
    return versions.where((F.col(FROM) <= at) & (F.col(TO) > at)).drop(FROM, TO)


def between(versions: DataFrame, low: int, high: int) -> DataFrame:
    """All versions valid at some moment in [low, high], with their validity."""
    return versions.where((F.col(FROM) <= high) & (F.col(TO) > low))


def version_counts(versions: DataFrame, keys: list[str]) -> DataFrame:
    return versions.groupBy(*keys).agg(F.count("*").alias("n_versions"))
