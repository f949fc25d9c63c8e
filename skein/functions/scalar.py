"""Scalar functions with the engine's semantics, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a boolean cast.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def substr(text: Column, start: int, length: int) -> Column:
    """Characters from a 1-based start; a start below 1 counts as 1."""
    return F.substring(text, max(start, 1), length)


def extract(field: str, when: Column) -> Column:
    """YEAR, MONTH, DAY, QUARTER, DOY, DOW (Sunday 0), ISODOW (Monday 1) or EPOCH seconds of a date."""
    day = F.to_date(when)
    parts = {
        "YEAR": F.year(day), "MONTH": F.month(day), "DAY": F.dayofmonth(day), "QUARTER": F.quarter(day), "DOY": F.dayofyear(day),
        "DOW": F.dayofweek(day) - 1, "ISODOW": F.weekday(day) + 1, "EPOCH": F.unix_date(day).cast("long") * 86_400,
    }
    if field.upper() not in parts:
        raise ValueError(f"unknown field {field}")
    return parts[field.upper()]


def divide(a: Column, b: Column) -> Column:
    """Quotient as a double; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def try_boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def iif(condition: Column, yes, no) -> Column:
    return F.when(condition, yes).otherwise(no)


def add_interval(day: Column, text: str) -> Column:
    """A date or time plus "n unit" (year to microsecond); month ends clamp."""
    m = re.fullmatch(r"\s*([+-]?\d+)\s*(year|quarter|month|week|day|hour|minute|second|millisecond|microsecond)s?\s*", text, re.I)
    if not m:
        raise ValueError(f"not an interval: {text}")
    n, unit = int(m[1]), m[2].upper()
    if unit == "QUARTER":
        n, unit = 3 * n, "MONTH"
    return F.timestamp_add(unit, F.lit(n), day)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)
