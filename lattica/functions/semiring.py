"""Semirings as pairs of a built-in aggregate (sum) and a Column expression (product)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """``plus`` aggregates a column, ``times`` combines two; ``zero`` is the absence of a row.

    ``combine`` and ``product`` are the same operations on Python values, for tests and constants.
    """

    name: str
    one: Any
    plus: Callable[[Column], Column]
    times: Callable[[Column, Column], Column]
    combine: Callable[[Any, Any], Any]
    product: Callable[[Any, Any], Any]
    #: a ⊕ a = a: repeated derivations change nothing, so fixpoints end on finite domains.
    idempotent: bool = False


BOOL = Semiring("bool", True, F.bool_or, lambda a, b: a & b, lambda a, b: a or b, lambda a, b: a and b, True)
COUNT = Semiring("count", 1, F.sum, lambda a, b: a * b, lambda a, b: a + b, lambda a, b: a * b)
MINPLUS = Semiring("minplus", 0, F.min, lambda a, b: a + b, min, lambda a, b: a + b, True)
#: Minimum with the right factor as product: the label of what is reached, not a path length.
MIN = Semiring("min", None, F.min, lambda a, b: b, min, lambda a, b: b, True)
