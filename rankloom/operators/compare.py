"""Evaluation records and side-by-side model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.vectors import dot, fuse
from rankloom.operators.curves import auc, curve_points
from rankloom.operators.encode import EncoderFactory, encode_column, encode_columns
from rankloom.operators.metrics import classification_metrics
from rankloom.operators.ndcg import CUTS, cut_name, global_ndcg, mean_ndcg
from rankloom.operators.threshold import threshold_sweep, tune

RATES = ["accuracy", "precision", "recall", "f1"]
CHART_METRICS = [*RATES, "pr_auc"]


def score_question(comments: DataFrame, question: str, context: str, encoders: dict[str, EncoderFactory],
                   text: str = "comment", keep: list[str] | None = None) -> DataFrame:
    """Scores of all comments against one question with context, per encoder.

    The two texts become one vector on the driver and a constant of the plan; the
    comments are encoded and scored where they lie, by all encoders in one pass.
    ``keep`` names the columns to carry; without the text it travels to Python once
    and not back.
    """
    kept = keep or comments.columns
    columns = {f"_v{i}": entry for i, entry in enumerate(encoders.items())}
    vectors = encode_columns(comments.select(*kept, F.col(text).alias("_text")), "_text", columns)
    scores = []
    for column, (name, factory) in columns.items():
        asked = comments.sparkSession.createDataFrame(
            [(0, question, context or None)], "n int, question string, context string")
        both = encode_column(encode_column(asked, "question", name, factory, "q"), "context", name, factory, "c")
        used = F.when(F.lit(bool(context)), F.col("c"))
        vector = list(both.select(fuse(F.col("q"), used).alias("v")).first()["v"])
        scores.append(F.struct(F.lit(name).alias("model"), dot(F.lit(vector), F.col(column)).alias("score")))
    return vectors.select(*kept, F.inline(F.array(*scores)))


def _per_model(thresholds: DataFrame | dict[str, float], scored: DataFrame) -> DataFrame:
    """Rows with the threshold of their model. There is one row per model, and
    models are listed by the caller, so the thresholds are broadcast."""
    if isinstance(thresholds, dict):
        names = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
        return scored.withColumn("threshold", F.element_at(names, F.col("model")))
    return scored.join(F.broadcast(thresholds.select("model", "threshold")), "model")


def evaluation_record(scored: DataFrame, thresholds: DataFrame | dict[str, float], split: str,
                      by_query: bool = True) -> DataFrame:
    """One row per model: threshold, rates, areas, NDCG, counts, number of rows."""
    rows = _per_model(thresholds, scored)
    keys = ("model", "threshold")
    rates = classification_metrics(rows, F.col("threshold"), keys)
    areas = auc(scored, ("model",)).select("model", "pr_auc")
    ranking = mean_ndcg(scored, ("model",)) if by_query else global_ndcg(scored, ("model",))
    return (
        rates.join(areas, "model").join(ranking, "model")
        .select("model", F.lit(split).alias("split"), "threshold", *RATES, "pr_auc",
                *[cut_name(k) for k in CUTS], "tp", "tn", "fp", "fn",
                (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n_samples")))


def two_model_report(scored: DataFrame) -> DataFrame:
    """Each model tuned on its own validation scores and judged on the test split."""
    tuned = tune(scored.where("split = 'val'"), ("model",))
    return evaluation_record(scored.where("split = 'test'"), tuned, "test")


def compare_models(scored: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Each model on the same rows, tuned there unless a threshold is given, 3 places."""
    tuned = tune(scored, ("model",)).select("model", "threshold")
    if thresholds:
        names = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
        tuned = tuned.select(
            "model", F.coalesce(F.try_element_at(names, F.col("model")), F.col("threshold")).alias("threshold"))
    rates = classification_metrics(_per_model(tuned, scored), F.col("threshold"), ("model", "threshold"))
    ranking = global_ndcg(scored, ("model",), [10])
    return rates.join(ranking, "model").select(
        "model", "threshold", *[(F.round(r, 3) + F.lit(0.0)).alias(r) for r in RATES], "ndcg_10")


def metrics_long(records: DataFrame, metrics: list[str] = CHART_METRICS) -> DataFrame:
    """(model, metric, value) from wide records."""
    return records.select("model", *metrics).unpivot("model", metrics, "metric", "value")


def tagged_curves(scored: DataFrame) -> DataFrame:
    """F1, PR and ROC curves of all models as (model, curve, x, y)."""
    f1 = threshold_sweep(scored, ("model",)).select(
        "model", F.lit("f1").alias("curve"), F.col("threshold").alias("x"), F.col("f1").alias("y"))
    points = curve_points(scored, ("model",))

    def pair(name: str, x: str, y: str) -> Column:
        return F.struct(F.lit(name).alias("curve"), F.col(x).alias("x"), F.col(y).alias("y"))

    both = points.select("model", F.explode(F.array(
        pair("pr", "recall", "precision"), pair("roc", "fpr", "recall"))).alias("_p"))
    return f1.unionByName(both.select("model", "_p.*"))


def operating_point(scored: DataFrame, thresholds: DataFrame | dict[str, float]) -> DataFrame:
    """Precision and recall of each model at its threshold."""
    rows = _per_model(thresholds, scored)
    return classification_metrics(rows, F.col("threshold"), ("model", "threshold")).select(
        "model", "threshold", "precision", "recall")
