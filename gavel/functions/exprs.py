"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(col: Column | str, digits: int = 0) -> Column:
    """Round a double to ``digits`` with ties to even, on the scaled binary value."""
    c = F.col(col) if isinstance(col, str) else col
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def half_up(col: Column | str, digits: int = 0) -> Column:
    """Round a double to ``digits`` with ties away from zero, on the scaled binary value (as SQL's ``round`` does)."""
    c = F.col(col) if isinstance(col, str) else col
    if digits == 0:
        return F.round(c)
    scale = float(10**digits)
    return F.round(c * scale) / scale


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``fn``."""
    return F.transform(F.array(value), fn)[0]
