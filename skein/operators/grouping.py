"""Grouping sets, pivot and unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, sets: list[list[str]], keys: list[str], *aggregates: Column) -> DataFrame:
    """One pass over ``df`` (each row expanded per set); absent keys are NULL, ``grouping_id`` tells them from real NULLs."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggregates, F.grouping_id().alias("grouping_id"))


def cube(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.cube(*keys).agg(*aggregates, F.grouping_id().alias("grouping_id"))


def rollup(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.rollup(*keys).agg(*aggregates, F.grouping_id().alias("grouping_id"))


def pivot(df: DataFrame, keys: list[str], by: str, values: list, aggregate: Column, missing=None) -> DataFrame:
    """Wide table with a column per value.  ``values`` are given, so no extra job looks for them.

    A missing cell is NULL unless ``missing`` says otherwise.
    """
    wide = df.groupBy(*keys).pivot(by, values).agg(aggregate)
    return wide if missing is None else wide.fillna(missing, [c for c in wide.columns if c not in keys])


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)
