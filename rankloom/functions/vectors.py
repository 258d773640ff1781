"""Vector expressions over ``ARRAY<FLOAT>`` columns.

Sums run in double precision and in index order, so a score does not depend on
partitioning or batch size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = l2_norm(v)
    return F.transform(
        v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def fuse(query: Column, context: Column) -> Column:
    """Unit mean of query and context; the query alone when there is no context."""
    mean = F.zip_with(
        query, context, lambda x, y: (x.cast("double") + y.cast("double")) / F.lit(2.0))
    return F.when(context.isNull(), query.cast("array<double>")).otherwise(l2_normalize(mean))


def rounded(v: Column, places: int = 6) -> Column:
    """Comparable form of a vector for reports: doubles, no negative zero."""
    return F.transform(v, lambda x: F.round(x.cast("double"), places) + F.lit(0.0))
