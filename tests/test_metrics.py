import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import curves, metrics, ndcg, threshold


def frame(spark, rows):
    return spark.createDataFrame(rows, "query string, true_label int, score double")


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(7)
    # Two thirds of the rows belong to one query, and one score is common.
    return [("hot" if rng.random() < 0.66 else f"q{rng.randrange(5)}", int(rng.random() < 0.4),
             0.25 if rng.random() < 0.3 else round(rng.random(), 2)) for _ in range(600)]


def test_grid_is_numpys():
    values = threshold.grid(*threshold.SWEEP)
    assert len(values) == 95 and values == np.arange(-0.15, 0.80, 0.01).tolist()


def test_sweep_equals_one_pass_per_value(spark, random_rows):
    got = {r.t_idx: (r.tp, r.fp, r.fn, r.tn) for r in threshold.threshold_sweep(frame(spark, random_rows)).collect()}
    for i, t in enumerate(threshold.grid(*threshold.SWEEP)):
        pairs = [(y, s >= t) for _, y, s in random_rows]
        assert got[i] == tuple(pairs.count(p) for p in [(1, True), (0, True), (1, False), (0, False)])


def test_single_class_compatibility(spark):
    df = frame(spark, [("q", 1, 0.9), ("q", 1, 0.8)])
    assert metrics.confusion(df, 0.5).first().asDict() == {"tp": 2, "fp": 0, "fn": 0, "tn": 0}
    assert metrics.confusion(df, 0.5, compat=True).first().asDict() == {"tp": 0, "fp": 0, "fn": 0, "tn": 0}
    mixed = frame(spark, [("q", 1, 0.9), ("q", 0, 0.8)])
    assert metrics.confusion(mixed, 0.5, compat=True).first().asDict() == {"tp": 1, "fp": 1, "fn": 0, "tn": 0}


def test_no_support_counts_zero(spark):
    row = metrics.classification_metrics(frame(spark, [("q", 1, 0.1), ("q", 0, 0.2)]), 0.5).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_curves_of_one_class(spark):
    none = curves.curve_points(frame(spark, [("q", 0, 0.1), ("q", 0, 0.2)])).collect()
    assert all(r.recall == 1.0 and r.precision == 0.0 for r in none)
    every = curves.curve_points(frame(spark, [("q", 1, 0.1)])).collect()
    assert every[0].fpr is None and every[0].precision == 1.0


def brute_ndcg(rows, k):
    """Tie-averaged by the expected gain at every rank."""
    ordered = sorted(rows, key=lambda r: -r[2])
    discount = [1 / np.log2(i + 2) if k is None or i < k else 0 for i in range(len(rows))]
    gains = [np.mean([r[1] for r in rows if r[2] == o[2]]) for o in ordered]
    ideal = sorted((r[1] for r in rows), reverse=True)
    best = np.dot(ideal, discount)
    return np.dot(gains, discount) / best if best else 0.0


def test_ndcg_equals_brute_force(spark, random_rows):
    got = {r["query"]: r for r in ndcg.query_ndcg(frame(spark, random_rows)).collect()}
    for query in {r[0] for r in random_rows}:
        rows = [r for r in random_rows if r[0] == query]
        for k in (5, 10, 20, None):
            assert got[query][ndcg.cut_name(k)] == pytest.approx(brute_ndcg(rows, k))


def test_perfect_ranking_is_one_and_all_tied_is_below(spark):
    best = frame(spark, [("q", 1, 0.9), ("q", 1, 0.8), ("q", 0, 0.1)])
    assert ndcg.mean_ndcg(best).first()["ndcg_all"] == 1.0
    tied = frame(spark, [("q", 1, 0.5), ("q", 0, 0.5), ("q", 0, 0.5)])
    assert 0 < ndcg.mean_ndcg(tied).first()["ndcg_all"] < 1


def test_no_eligible_query_gives_zero(spark):
    df = frame(spark, [("a", 1, 0.5), ("b", 0, 0.5), ("b", 0, 0.4)])
    assert set(ndcg.mean_ndcg(df).first()) == {0.0}
    assert ndcg.global_ndcg(df.where("query = 'a'")).first()["ndcg_all"] == 0.0


def test_null_label_is_a_class(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "true_label int")
    row = metrics.class_support(df).first()
    assert (row.classes, row.smallest, row.stratified) == (2, 1, False)


def test_results_ignore_partitioning(spark, random_rows):
    df = frame(spark, random_rows)
    for parts in (1, 13):
        again = df.repartition(parts)
        assert curves.auc(again).first().pr_auc == pytest.approx(curves.auc(df).first().pr_auc)
        assert threshold.tune(again).first() == threshold.tune(df).first()
    assert metrics.distinct_queries(df).first()[0] == len({r[0] for r in random_rows})
    assert metrics.distinct_queries(df, approximate=True).first()[0] > 0
    assert df.where(F.col("score").isNull()).count() == 0
