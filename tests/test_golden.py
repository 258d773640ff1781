"""Hand-checked values on a nine-row table."""

import pytest

from rankloom.operators import compare, curves, histogram, metrics, ndcg, threshold


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_counts_and_rates_at_half(golden):
    row = one(metrics.classification_metrics(golden, 0.5))
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (2, 3, 2, 2)
    assert row["accuracy"] == pytest.approx(4 / 9)
    assert (row["precision"], row["recall"]) == (0.4, 0.5)
    assert row["f1"] == pytest.approx(4 / 9)


def test_curve_points(golden):
    got = {r.score: (r.tp, r.fp) for r in curves.running_counts(golden).collect()}
    assert got == {0.9: (1, 0), 0.8: (2, 1), 0.7: (2, 2), 0.5: (2, 3), 0.4: (2, 4),
                   0.3: (3, 4), 0.2: (4, 4), 0.1: (4, 5)}


@pytest.mark.parametrize("by", [(), ("model",)])
def test_areas(golden, by):
    row = one(curves.auc(golden, by))
    assert row["pr_auc"] == pytest.approx(0.6696428571428571)
    assert row["roc_auc"] == pytest.approx(0.575)


def test_query_ndcg(golden):
    got = {r["query"]: r for r in ndcg.query_ndcg(golden, ("query",), [1, 2, 5, None]).collect()}
    assert [got["q1"][f"ndcg_{k}"] for k in (1, 2, 5)] == pytest.approx(
        [1.0, 0.8065735963827293, 0.9598603945740939])
    assert [got["q2"][f"ndcg_{k}"] for k in (1, 2, 5)] == pytest.approx(
        [0.0, 0.6309297535714575, 0.6309297535714575])
    assert got["q3"]["ndcg_all"] == 0.0


def test_mean_and_global_ndcg(golden):
    grouped = one(ndcg.mean_ndcg(golden))
    assert grouped == dict.fromkeys(grouped, 0.795)
    whole = one(ndcg.global_ndcg(golden))
    assert [whole[f"ndcg_{k}"] for k in (5, 10, 20, "all")] == [0.611, 0.864, 0.864, 0.864]


def test_long_spans_are_cut_without_changing_the_sum(golden, monkeypatch):
    monkeypatch.setattr(ndcg, "FEW_ROWS", 0)
    monkeypatch.setattr(ndcg, "SEGMENT", 1)
    whole = one(ndcg.global_ndcg(golden))
    assert [whole[f"ndcg_{k}"] for k in (5, 10, 20, "all")] == [0.611, 0.864, 0.864, 0.864]


def test_best_threshold_and_rounding(golden):
    row = one(threshold.tune(golden))
    assert (row["t_idx"], row["raw_threshold"], row["threshold"]) == (25, 0.10000000000000023, 0.1)
    assert row["best_f1"] == pytest.approx(2 / 3)
    assert one(metrics.classification_metrics(golden, row["threshold"]))["f1"] == pytest.approx(8 / 13)


def test_score_stats(golden):
    row = one(metrics.score_stats(golden))
    assert (row["min_score"], row["max_score"]) == (0.1, 0.9)
    assert row["mean_score"] == pytest.approx(0.522222, abs=1e-6)
    assert row["std_score"] == pytest.approx(0.273974, abs=1e-6)
    means = {r.true_label: r.mean_score for r in metrics.class_mean_score(golden).collect()}
    assert means == pytest.approx({1: 0.55, 0: 0.5})


def test_histogram(golden):
    rows = histogram.score_histogram(golden).collect()
    assert len(rows) == 60
    filled = {y: {r.bin: r.rows for r in rows if r.true_label == y and r.rows} for y in (0, 1)}
    assert filled[1] == {0: 1, 4: 1, 25: 1, 29: 1}
    assert filled[0] == {0: 1, 12: 1, 17: 1, 25: 1, 29: 1}


def test_histogram_of_one_value(spark):
    flat = spark.createDataFrame([(1, 0.4)] * 3, "true_label int, score double")
    filled = [r for r in histogram.score_histogram(flat, 10).collect() if r.rows]
    assert [(r.bin, r.rows) for r in filled] == [(5, 3)]


def test_record_and_comparison(golden):
    row = one(compare.evaluation_record(golden, {"m": 0.5}, "test"))
    assert (row["tp"], row["tn"], row["fp"], row["fn"], row["n_samples"]) == (2, 2, 3, 2, 9)
    assert row["ndcg_10"] == 0.795 and row["pr_auc"] == pytest.approx(0.6696428571428571)
    tuned = one(compare.compare_models(golden))
    assert tuned["threshold"] == 0.1 and tuned["f1"] == 0.615 and tuned["ndcg_10"] == 0.864
    fixed = one(compare.compare_models(golden, {"m": 0.5, "other": 0.1}))
    assert fixed["threshold"] == 0.5 and fixed["f1"] == 0.444
