"""Report tables over popular comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.threshold import predict

TOP = 20


def top_popular(scored: DataFrame, threshold: float, k: int = TOP, key: str = "pair_id") -> DataFrame:
    """The ``k`` most popular comments with their score and predicted relevance."""
    return (scored.select(key, "upvotes", "score")
            .orderBy(F.desc("upvotes"), F.asc(key)).limit(k)
            .withColumn("relevant", predict(F.col("score"), threshold)))


def viral_irrelevant(scored: DataFrame, threshold: float, k: int = TOP, key: str = "pair_id") -> DataFrame:
    """Those of the most popular comments that score below the threshold."""
    return top_popular(scored, threshold, k, key).where("relevant = 0")
