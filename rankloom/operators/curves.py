"""Precision-recall and ROC curves over distinct scores, and the areas below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numbers import ratio
from rankloom.operators.metrics import judged_rows
from rankloom.operators.ordering import join_null_safe, next_values, running_totals
from rankloom.session import materialize


def score_ties(scored: DataFrame, by: tuple[str, ...] = (), score: str = "score",
               label: str = "true_label") -> DataFrame:
    """Stored table of distinct scores with their positives and negatives.

    Equal scores fold together per task, before anything is ordered. Rows without
    a score or a label take no part (``judged_rows``).
    """
    return materialize(judged_rows(scored, score, label).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")), "ties")


def running_counts(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct score: its positives and negatives, and those at or above it."""
    return _running(score_ties(scored, by), by)


def _running(ties: DataFrame, by: tuple[str, ...], order: str = "score") -> DataFrame:
    totals = running_totals(ties, order, ["p", "n"], by)
    return totals.withColumnsRenamed({"run_p": "tp", "run_n": "fp"})


def curve_points(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(…, score, tp, fp, precision, recall, fpr) for every distinct score.

    Recall without positives is 1; the false positive rate without negatives is null.
    """
    return _points(score_ties(scored, by), by)


def cumulated(ties: DataFrame, by: tuple[str, ...], order: str = "score") -> DataFrame:
    """A stored table of counts ``p`` and ``n`` per ``order`` with ``tp`` and ``fp`` at or above
    each, ``positives`` and ``negatives`` of the whole group."""
    sums = [F.sum("p").alias("positives"), F.sum("n").alias("negatives")]
    points = _running(ties, by, order)
    if by:
        # A row per model or split: stored, so the join knows how small it is.
        points = join_null_safe(points, materialize(ties.groupBy(*by).agg(*sums), "totals"), list(by))
    else:
        row = ties.agg(*sums).first()
        points = points.withColumns({"positives": F.lit(row["positives"]).cast("long"),
                                     "negatives": F.lit(row["negatives"]).cast("long")})
    return points


def _points(ties: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return (cumulated(ties, by)
            .withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
            .withColumn("recall", ratio(F.col("tp"), F.col("positives"), empty=1.0))
            .withColumn("fpr", F.try_divide(F.col("fp").cast("double"), F.col("negatives"))))


def curve_areas(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(…, pr_auc, roc_auc) by trapezoids.

    Every point knows the one before it: its own counts taken off. The PR curve
    starts at recall 0 with precision 1, the ROC curve at the origin.
    """
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    precision0 = ratio(tp0, tp0 + fp0, empty=1.0)
    d_recall = ratio(F.col("p"), F.col("positives"))
    d_fpr = F.try_divide(F.col("n").cast("double"), F.col("negatives"))
    tpr, tpr0 = F.col("recall"), ratio(tp0, F.col("positives"))
    has_positives = F.col("positives") > 0
    return points.groupBy(*by).agg(
        F.sum(d_recall * (F.col("precision") + precision0) / 2.0).alias("pr_auc"),
        F.sum(F.when(has_positives, d_fpr * (tpr + tpr0) / 2.0)).alias("roc_auc"))


def pr_curve(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return curve_points(scored, by).select(*by, "score", "tp", "fp", "precision", "recall")


def roc_curve(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return curve_points(scored, by).select(*by, "score", F.col("recall").alias("tpr"), "fpr")


def roc_curve_thinned(scored: DataFrame, by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """(…, score, tpr, fpr): the ROC curve without the points that lie evenly between their neighbours.

    A point stays when it is the first or the last, or when the step after it
    differs from the step before it in positives or negatives; so the area is that
    of the whole curve. A step is the point's own counts, so only the following
    point is asked for (``next_values``).
    """
    ties = materialize(next_values(score_ties(scored, by), "score", ["p", "n"], by, buckets=buckets), "steps")
    first = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n"))
    turns = (F.col("next_p") != F.col("p")) | (F.col("next_n") != F.col("n"))
    kept = _points(ties, by).where(first | F.col("next_p").isNull() | turns)
    return kept.select(*by, "score", F.col("recall").alias("tpr"), "fpr")


def auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return curve_areas(curve_points(scored, by), by)
