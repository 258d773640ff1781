"""NDCG with ties averaged, over all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numbers import ratio
from rankloom.operators.metrics import judged_rows
from rankloom.operators.ordering import join_null_safe, running_totals
from rankloom.session import materialize

CUTS: list[int | None] = [5, 10, 20, None]
SEGMENT = 65_536
FEW_ROWS = 1_000_000


def cut_name(k: int | None) -> str:
    return f"ndcg_{k}" if k else "ndcg_all"


def discount_sum(low: Column, high: Column) -> Column:
    """Sum of ``1 / log2(rank + 1)`` for ranks above ``low`` up to ``high``."""
    first = low.cast("long") + 1
    ranks = F.sequence(first, F.greatest(first, high.cast("long")))
    total = F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + F.lit(1.0) / F.log2(r + 1.0))
    return F.when(high > low, total).otherwise(F.lit(0.0))


def tie_groups(scored: DataFrame, by: tuple[str, ...], score: str = "score",
               label: str = "true_label") -> DataFrame:
    """Stored table with one row per group and distinct score: size and positives.
    Rows without a score or a label take no part (``judged_rows``)."""
    return materialize(judged_rows(scored, score, label).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(label)).cast("long").alias("gain")), "ties")


def _segments(df: DataFrame, by: tuple[str, ...], rows: int) -> DataFrame:
    """Cut long rank spans into pieces, spread over tasks, unless the rows behind
    them are few enough for no span to be long."""
    if rows <= FEW_ROWS:
        return df
    last = F.floor((F.col("high") - F.col("low") - 1) / F.lit(SEGMENT)).cast("long")
    cut = (df.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)))))
           .withColumn("low", F.col("low") + F.col("_piece") * SEGMENT)
           .withColumn("high", F.least(F.col("high"), F.col("low") + SEGMENT)))
    return cut.repartition(*by, "low").drop("_piece")


def query_ndcg(scored: DataFrame, by: tuple[str, ...] = ("query",),
               cuts: list[int | None] = CUTS) -> DataFrame:
    """NDCG at every cut for every group, with its size and positives.

    A tie group earns its mean gain times the discounts of the ranks it spans.
    Groups without a positive get zero.
    """
    ties = tie_groups(scored, by)
    rows = ties.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = ties.groupBy(*by).agg(F.sum("n").alias("items"), F.sum("gain").alias("positives"))
    ranked = running_totals(ties, "score", ["n"], by).where("gain > 0")

    def upto(k: int | None) -> Column:
        return F.least(F.col("high"), F.lit(k).cast("long")) if k else F.col("high")

    earned = ranked.select(
        *by, F.lit(0).alias("ideal"), (F.col("run_n") - F.col("n")).alias("low"),
        F.col("run_n").alias("high"), (F.col("gain") / F.col("n")).alias("weight"))
    best = sizes.where("positives > 0").select(
        *by, F.lit(1).alias("ideal"), F.lit(0).cast("long").alias("low"),
        F.col("positives").alias("high"), F.lit(1.0).alias("weight"))
    spans = _segments(earned.unionByName(best), by, rows)
    sums = []
    for k in cuts:
        part = F.col("weight") * discount_sum(F.col("low"), upto(k))
        sums += [F.sum(F.when(F.col("ideal") == 0, part)).alias(f"_dcg_{k}"),
                 F.sum(F.when(F.col("ideal") == 1, part)).alias(f"_ideal_{k}")]
    dcg = spans.groupBy(*by).agg(*sums)
    joined = join_null_safe(sizes, dcg, list(by), "left")
    return joined.select(
        *by, "items", "positives",
        *[ratio(F.col(f"_dcg_{k}"), F.col(f"_ideal_{k}")).alias(cut_name(k)) for k in cuts])


def mean_ndcg(scored: DataFrame, by: tuple[str, ...] = (), query: str = "query",
              cuts: list[int | None] = CUTS) -> DataFrame:
    """Mean over queries with at least two items and one positive, to 3 places; else zero."""
    values = query_ndcg(scored, (*by, query), cuts)
    counted = (F.col("items") >= 2) & (F.col("positives") > 0)
    return values.groupBy(*by).agg(*[
        F.coalesce(F.round(F.avg(F.when(counted, F.col(cut_name(k)))), 3), F.lit(0.0)).alias(cut_name(k))
        for k in cuts])


def global_ndcg(scored: DataFrame, by: tuple[str, ...] = (),
                cuts: list[int | None] = CUTS) -> DataFrame:
    """All rows as one ranked list per ``by``, to 3 places; one single row counts zero."""
    values = query_ndcg(scored.withColumn("_list", F.lit(1)), (*by, "_list"), cuts)
    return values.select(*by, *[
        F.when(F.col("items") >= 2, F.round(cut_name(k), 3)).otherwise(F.lit(0.0)).alias(cut_name(k))
        for k in cuts])
