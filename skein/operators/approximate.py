"""Approximate aggregates: sketches and a sampled mean with an error bound."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_PRECISION = 14
#: The relative standard error of 2^14 registers.
HLL_ERROR = 1.04 / math.sqrt(1 << HLL_PRECISION)


def approx_distinct(column: str, error: float = HLL_ERROR):
    return F.approx_count_distinct(column, error)


def distinct_sketch(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A mergeable sketch per group; merge with ``hll_union_agg``, read with ``hll_sketch_estimate``."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(HLL_PRECISION)).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def count_min(df: DataFrame, column: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 42):
    """A count-min sketch of a column as bytes."""
    return df.agg(F.count_min_sketch(F.col(column), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def count_min_estimates(sketch: DataFrame, values: list, name: str) -> DataFrame:
    """(name, estimate): the counts of ``values`` that a sketch of :func:`count_min` gives; never below the true ones."""
    spark = sketch.sparkSession
    held = spark.sparkContext._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytearray(sketch.first().sketch))
    return spark.createDataFrame([(v, held.estimateCount(v)) for v in values], f"{name} {dict(sketch.sparkSession.createDataFrame([(values[0],)], [name]).dtypes)[name] if values else 'long'}, estimate long")


def approx_mean(df: DataFrame, column: str, epsilon: float, confidence: float, first: float = 0.01, seed: int = 7) -> DataFrame:
    """Mean of ``column`` within ``epsilon`` with the given confidence, from growing samples.

    Empirical Bernstein bound: with n sampled values of range R and variance v, the error is at most
    sqrt(2 v ln(3/d) / n) + 3 R ln(3/d) / n with probability 1 - d.  The risk is shared by the rounds
    (d halves each time).  Each round is one aggregate over a sample four times as large; the last is
    the whole table, whose bound is 0.  The range comes from one pass over the column.
    """
    facts = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    spread = (facts.hi or 0.0) - (facts.lo or 0.0)
    share, risk = first, (1 - confidence) / 2
    while True:
        part = df if share >= 1 else df.sample(fraction=share, seed=seed)
        row = part.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.var_pop(column).alias("var")).first()
        term = math.log(3 / risk)
        bound = 0.0 if share >= 1 else math.inf if not row.n else math.sqrt(2 * row["var"] * term / row.n) + 3 * spread * term / row.n
        if bound <= epsilon:
            return df.sparkSession.createDataFrame([(row.mean, bound, row.n, min(share, 1.0))], "estimate double, bound double, n_sampled long, share double")
        share, risk = share * 4, risk / 2
