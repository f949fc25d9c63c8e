"""Hamming distance over bit patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def within_hamming(df: DataFrame, column: str, target: int, distance: int) -> DataFrame:
    """Rows whose 64-bit pattern differs from ``target`` in at most ``distance`` bits; stays in generated code."""
    signed = target - (1 << 64) if target >= 1 << 63 else target
    return df.where(hamming(F.col(column), F.lit(signed).cast("long")) <= distance)


def sign_bits(vector: Column, size: int = 64) -> Column:
    """The signs of a vector's first ``size`` elements as one integer; bit i is set where element i is above zero."""
    from_last = F.reverse(F.slice(vector, 1, size))
    bits_of = F.aggregate(from_last, F.lit(0).cast("long"), lambda bits, x: F.shiftleft(bits, 1).bitwiseOR(F.coalesce((x > 0).cast("long"), F.lit(0).cast("long"))))
    return F.coalesce(bits_of, F.lit(0).cast("long"))
