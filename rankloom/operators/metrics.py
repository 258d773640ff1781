"""Counts and classification metrics. All group by ``by`` and fold per task first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numbers import ratio


def judged_rows(scored: DataFrame, score: str = "score", label: str = "true_label") -> DataFrame:
    """The rows every metric counts: those with a score and a label. A NaN score
    is an error of the scorer and is refused."""
    value = F.col(score).cast("double")
    checked = F.when(F.isnan(value), F.raise_error(F.lit(f"{score} is NaN")).cast("double")).otherwise(value)
    return scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn(score, checked)


def confusion_counts(predicted: Column, label: Column) -> list[Column]:
    return [
        F.count_if((label == 1) & (predicted == 1)).alias("tp"),
        F.count_if((label != 1) & (predicted == 1)).alias("fp"),
        F.count_if((label == 1) & (predicted == 0)).alias("fn"),
        F.count_if((label != 1) & (predicted == 0)).alias("tn"),
    ]


def confusion(scored: DataFrame, threshold: Column | float, by: tuple[str, ...] = (),
              compat: bool = False, score: str = "score", label: str = "true_label") -> DataFrame:
    """True and false positives and negatives at a threshold (inclusive).

    Rows without a score or a label take no part (``judged_rows``).
    ``compat`` reports four zeros when labels and predictions hold one class only.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    predicted = (F.col(score) >= limit).cast("int")
    counts = judged_rows(scored, score, label).groupBy(*by).agg(*confusion_counts(predicted, F.col(label)))
    if not compat:
        return counts
    alone = ((F.col("tp") + F.col("fp") + F.col("fn") == 0)
             | (F.col("fp") + F.col("fn") + F.col("tn") == 0))
    return counts.select(*by, *[F.when(alone, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
                                for c in ("tp", "fp", "fn", "tn")])


def with_rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and F1; no support gives zero."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (counts
            .withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
            .withColumn("precision", ratio(tp, tp + fp))
            .withColumn("recall", ratio(tp, tp + fn))
            .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)))


def classification_metrics(scored: DataFrame, threshold: Column | float,
                           by: tuple[str, ...] = ()) -> DataFrame:
    return with_rates(confusion(scored, threshold, by))


def per_query_metrics(scored: DataFrame, threshold: Column | float, query: str = "query") -> DataFrame:
    """Precision, recall and F1 of every query at one threshold."""
    return classification_metrics(scored, threshold, (query,))


def set_summary(pairs: DataFrame, label: str = "true_label", query: str = "query") -> DataFrame:
    """Rows, relevant and irrelevant rows."""
    return pairs.agg(
        F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("relevant"),
        F.count_if(F.col(label) == 0).alias("irrelevant"))


def distinct_queries(pairs: DataFrame, query: str = "query", approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(query) if approximate else F.count_distinct(query)
    return pairs.agg(count.alias("queries"))


def score_stats(scored: DataFrame, by: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """Range, mean and population deviation of the scores."""
    return scored.groupBy(*by).agg(
        F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))


def class_mean_score(scored: DataFrame, score: str = "score", label: str = "true_label") -> DataFrame:
    return scored.groupBy(label).agg(F.avg(score).alias("mean_score"))


def class_support(df: DataFrame, label: str = "true_label") -> DataFrame:
    """Number of classes, smallest class, and whether a stratified split is possible.
    A null label counts as a class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("classes"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest")).withColumn(
        "stratified", (F.col("classes") >= 2) & (F.col("smallest") >= 2))


def embedding_dim(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Smallest and largest vector size; equal in a sound store."""
    return vectors.agg(F.min(F.size(vector)).cast("long").alias("min_dim"),
                       F.max(F.size(vector)).cast("long").alias("max_dim"))
