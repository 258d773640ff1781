"""Null groups, null and NaN scores: one rule, the same rows whichever plan is taken."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import curves, metrics, ndcg, ordering, threshold
from rankloom.operators.ordering import number_rows, running_totals
from rankloom.session import materialize

NAN = float("nan")


def table(spark):
    rng = random.Random(8)
    keys = [(m, s) for m in ("m", None) for s in [*[rng.random() for _ in range(60)], None, NAN, 0.0, -5.0]]
    return materialize(spark.createDataFrame([(m, s, i + 1) for i, (m, s) in enumerate(keys)],
                                             "model string, score double, v long"))


def shown(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("by", [(), ("model",)])
@pytest.mark.parametrize("buckets", [None, 1, 9])
def test_buckets_equal_the_window(spark, descending, by, buckets):
    df = table(spark)
    if not by:
        df = materialize(df.where("model is not null"))
    plain = running_totals(df, "score", ["v"], by, descending, small=10 ** 9)
    cut = running_totals(df, "score", ["v"], by, descending, buckets, small=0)
    assert plain.count() == df.count()
    assert shown(cut, "model", "score", "v", "run_v") == shown(plain, "model", "score", "v", "run_v")


def test_the_largest_group_decides(spark):
    df = table(spark)
    assert ordering._largest_group(df, ("model",)) == 64 and ordering._largest_group(df, ()) == 128
    assert ordering._largest_group(df.where("false"), ("model",)) == 0


def test_null_groups_are_numbered(spark):
    df = spark.createDataFrame([(None if i % 3 else "a", f"k{i}") for i in range(60)], "g string, k string")
    got = number_rows(df, "k", ("g",), buckets=5).groupBy("g").agg(
        F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high")).collect()
    assert sorted((r.g or "", r.n, r.low, r.high) for r in got) == [("", 40, 0, 39), ("a", 20, 0, 19)]


SCORED = [("q1", 1, 0.9), ("q1", 0, 0.8), ("q1", 1, 0.8), ("q1", 0, 0.1), (None, 0, 0.7), (None, 1, 0.2)]
EXTRA = [("q1", 1, None), ("q1", None, 0.95), (None, 0, None), ("q9", 1, None)]


@pytest.mark.parametrize("small", [0, 10 ** 9])
def test_rows_without_score_or_label_take_no_part(spark, monkeypatch, small):
    monkeypatch.setattr(running_totals, "__defaults__", (*running_totals.__defaults__[:-1], small))
    schema = "query string, true_label int, score double"
    clean, mixed = spark.createDataFrame(SCORED, schema), spark.createDataFrame(SCORED + EXTRA, schema)
    for measure in (lambda d: metrics.confusion(d, 0.5), threshold.threshold_sweep, threshold.tune, curves.auc,
                    lambda d: metrics.confusion(d, 0.5, ("query",)).where("query is null or query != 'q9'"),
                    ndcg.query_ndcg, ndcg.mean_ndcg, ndcg.global_ndcg,
                    lambda d: curves.curve_points(d, ("query",)), lambda d: curves.auc(d, ("query",))):
        assert shown(measure(mixed), "*") == shown(measure(clean), "*")
    swept = {round(r.threshold, 2): r for r in threshold.threshold_sweep(mixed).collect()}
    at = metrics.classification_metrics(mixed, swept[0.5].threshold).first()
    assert (swept[0.5].tp, swept[0.5].fp, swept[0.5].fn, swept[0.5].tn) == (at.tp, at.fp, at.fn, at.tn)
    assert len(ndcg.query_ndcg(mixed).collect()) == 2


def test_nan_scores_are_refused(spark):
    bad = spark.createDataFrame([*SCORED, ("q1", 1, NAN)], "query string, true_label int, score double")
    for measure in (lambda d: metrics.confusion(d, 0.5), threshold.threshold_sweep, curves.auc, ndcg.query_ndcg):
        with pytest.raises(Exception, match="NaN"):
            measure(bad).collect()


def test_values_reached_is_a_search(spark):
    values = threshold.grid(*threshold.SWEEP)
    scores = [v + d for v in values for d in (-1e-12, 0.0, 1e-12)] + [-9.0, 9.0, math.inf, -math.inf]
    df = spark.createDataFrame([(s,) for s in scores], "s double").select("s", threshold.values_reached(F.col("s"), values).alias("n"))
    assert all(r.n == sum(v <= r.s for v in values) for r in df.collect())
