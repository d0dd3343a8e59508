"""Lower bounds on keys as predicates, so that they reach the scan as pushed filters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(column: Column, value: Any) -> Column:
    return column >= F.lit(value)


def above(column: Column, value: Any) -> Column:
    return column > F.lit(value)


def between_bounds(column: Column, low: Any = None, high: Any = None, low_open: bool = False, high_closed: bool = False) -> Column:
    """``low <= column < high``; ``low_open`` and ``high_closed`` change the ends, None leaves one free."""
    test = F.lit(True)
    if low is not None:
        test = above(column, low) if low_open else at_least(column, low)
    if high is not None:
        test = test & (column <= F.lit(high) if high_closed else column < F.lit(high))
    return test
