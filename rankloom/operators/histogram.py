"""Equal-width score histograms, each group between its own extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialize


def histogram(scored: DataFrame, bins: int, by: tuple[str, ...], score: str = "score") -> DataFrame:
    """(…, bin, low, high, rows) with every bin of every group, the empty ones too.

    The last bin includes its upper edge; a group of one single value spans half a
    unit to either side. ``by`` names the few groups of a chart (stage, class): their
    extremes are written first, so the rows meet a table of known, tiny size.
    """
    value = F.col(score).cast("double")
    spans = scored.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    spans = materialize(spans.select(
        *by, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi")), "spans")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))

    def edge(number):
        return F.col("_lo") + number * width

    rough = F.least(F.lit(bins - 1), F.floor((value - F.col("_lo")) / width)).cast("int")
    # The division may land on the wrong side of an edge by one rounding.
    exact = (F.when(value < edge(rough), rough - 1)
             .when((value >= edge(rough + 1)) & (rough < bins - 1), rough + 1).otherwise(rough))
    counts = (scored.where(value.isNotNull()).join(spans, list(by))
              .groupBy(*by, exact.cast("long").alias("bin")).agg(F.count("*").alias("rows")))
    frame = spans.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return frame.join(counts, [*by, "bin"], "left").select(
        *by, "bin", edge(F.col("bin")).alias("low"),
        F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise(edge(F.col("bin") + 1)).alias("high"),
        F.coalesce(F.col("rows"), F.lit(0)).alias("rows"))


def score_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    """Scores of relevant and irrelevant rows."""
    return histogram(scored.where("true_label in (0, 1)"), bins, ("true_label",))


def stage_histograms(staged: DataFrame, bins: int = 25) -> DataFrame:
    """Scores before and after reranking; all labels but 1 count as irrelevant."""
    labelled = staged.withColumn("true_label", (F.col("true_label") == 1).cast("int"))
    return histogram(labelled, bins, ("stage", "true_label"))
