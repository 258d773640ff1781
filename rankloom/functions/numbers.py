"""Number expressions shared by the metric tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    """Division whose empty case is a number, as metrics with no support count 0."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(empty))


def places(value: Column, digits: int = 6) -> Column:
    return F.round(value.cast("double"), digits) + F.lit(0.0)
