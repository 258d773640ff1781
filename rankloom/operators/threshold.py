"""Decision thresholds: prediction, sweep over a grid, choice of the best."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.metrics import judged_rows, with_rates

# The sweep's start, stop and step, and the thresholds of the report.
SWEEP = (-0.15, 0.80, 0.01)
REPORT_GRID = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]


def grid(start: float, stop: float, step: float) -> list[float]:
    """Evenly spaced values from ``start`` up to, not including, ``stop``."""
    return [float(v) for v in np.arange(start, stop, step)]


def predict(score: Column, threshold: Column | float) -> Column:
    """1 from the threshold on, 0 below it."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= limit).cast("int")


def values_reached(score: Column, values: list[float]) -> Column:
    """How many of the rising ``values`` a score reaches: a binary search as one
    compiled expression of nested comparisons."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(score >= values[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(values))


def threshold_sweep(scored: DataFrame, by: tuple[str, ...] = (), values: list[float] | None = None,
                    score: str = "score", label: str = "true_label") -> DataFrame:
    """Counts and rates at every grid value, from one pass over the rows.

    Each row is reduced to how many grid values it reaches; after partial
    aggregation at most ``len(values) + 1`` rows per ``by`` are left. Rows without a
    score or a label take no part (``judged_rows``), as in ``confusion``.
    """
    values = sorted(grid(*SWEEP) if values is None else values)
    reached = judged_rows(scored, score, label).withColumn("_reached", values_reached(F.col(score), values))
    histogram = reached.groupBy(*by, "_reached").agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    per_value = histogram.select(
        *by, "_pos", "_neg", "_reached",
        F.posexplode(F.array(*[F.lit(v) for v in values])).alias("t_idx", "threshold"))
    hit = F.col("_reached") > F.col("t_idx")
    counts = per_value.groupBy(*by, "t_idx", "threshold").agg(
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("_pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("_neg"))).alias("tn"))
    return with_rates(counts.withColumn("t_idx", F.col("t_idx").cast("long")))


def best_threshold(sweep: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The lowest grid value of highest F1, raw and rounded to 3 places."""
    best = F.max(F.struct("f1", (-F.col("t_idx")).alias("turn"), "threshold")).alias("_best")
    return sweep.groupBy(*by).agg(best).where("_best is not null").select(
        *by, (-F.col("_best.turn")).alias("t_idx"), F.col("_best.threshold").alias("raw_threshold"),
        (F.round("_best.threshold", 3) + F.lit(0.0)).alias("threshold"),
        F.col("_best.f1").alias("best_f1"))


def tune(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return best_threshold(threshold_sweep(scored, by), by)
