"""Recursive queries by semi-naive rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from skein.sources.storage import scratch

DEFAULT_LIMIT, NO_LIMIT = 100, 100_000


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``anchor`` united (UNION ALL) with ``step`` of each round's rows, at most ``limit`` rounds, then what was found.

    Each round sees only the last round's rows.  It ends when a round brings no row with new content, so cycles
    end.  Rounds are kept as tables in shared storage, so the plan does not grow with the depth.
    """
    names = anchor.columns
    found = frontier = scratch(anchor, "recursion")
    for _ in range(limit or NO_LIMIT):
        new = scratch(step(frontier).toDF(*names), "recursion")
        if new.subtract(found).isEmpty():
            break
        found, frontier = found.unionByName(new), new
    return found
