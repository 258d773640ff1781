"""Areas below curves from counts per score cell: small, mergeable, with bounds.

A sketch is the caller's choice for scores that are too many to order; ``curves.auc``
is the exact way. Cells are fixed intervals of 2^-bits, so sketches of any parts of
a table, made anywhere, add up to the sketch of the whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numbers import ratio
from rankloom.operators.curves import cumulated
from rankloom.operators.metrics import judged_rows
from rankloom.session import materialize

BITS = 16


def score_sketch(scored: DataFrame, by: tuple[str, ...] = (), bits: int = BITS, score: str = "score",
                 label: str = "true_label") -> DataFrame:
    """(…, cell, p, n): positives and negatives of each cell, counted in one pass.

    Rows without a score or a label take no part, NaN is refused. Scores in [-1, 1]
    fill at most 2^(bits + 1) cells, whatever the number of rows.
    """
    cell = F.floor(F.col(score).cast("double") * F.lit(float(1 << bits)))
    return judged_rows(scored, score, label).groupBy(*by, cell.alias("cell")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))


def merge_sketches(sketches: list[DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The sketch of all rows together. Columns that ``by`` leaves out are merged over."""
    columns = [*by, "cell", "p", "n"]
    return reduce(DataFrame.unionByName, [s.select(*columns) for s in sketches]).groupBy(*by, "cell").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"))


def sketch_areas(sketch: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(…, positives, negatives, rank_error, roc_low, roc_high, pr_low, pr_high).

    The exact areas lie within the bounds. In a cell the positives may all stand above
    the negatives or below them, which gives the limits of the ROC area and of every
    precision on the way. ``rank_error`` is the share of rows in the fullest cell: no
    row's rank is off by more.
    """
    cells = cumulated(materialize(sketch, "cells"), by, "cell")
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    d_recall, d_fpr = ratio(F.col("p"), F.col("positives")), F.try_divide(F.col("n").cast("double"), F.col("negatives"))

    def roc(above: Column) -> Column:
        return F.sum(F.when(F.col("positives") > 0, d_fpr * ratio(above, F.col("positives"))))

    return cells.groupBy(*by).agg(
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        F.max(ratio(F.col("p") + F.col("n"), F.col("positives") + F.col("negatives"))).alias("rank_error"),
        roc(tp0).alias("roc_low"), roc(F.col("tp")).alias("roc_high"),
        F.sum(d_recall * ratio(tp0, tp0 + F.col("fp"), empty=1.0)).alias("pr_low"),
        F.sum(d_recall * ratio(F.col("tp"), F.col("tp") + fp0, empty=1.0)).alias("pr_high"))
