"""Quality classifier: identity of the pairwise sum, held-out accuracy, odd rows."""

import zlib

import numpy as np

from rankloom.llm import quality_fm
from tests.llm.helpers import awkward, nothing, rows_of


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    width = 40
    model = quality_fm.Model(0.3, rng.normal(size=width), rng.normal(size=(width, 3)))
    rows = [np.sort(rng.choice(width, n, replace=False)) for n in (1, 2, 7, 20)]
    values = [rng.normal(size=len(r)) for r in rows]
    sizes = np.array([len(r) for r in rows])
    got = model.scores(np.concatenate(rows), np.concatenate(values), np.cumsum(sizes) - sizes)
    for score, r, x in zip(got, rows, values, strict=True):
        margin = model.bias + model.linear[r] @ x + sum(
            model.factors[r[i]] @ model.factors[r[j]] * x[i] * x[j] for i in range(len(r)) for j in range(i))
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-9


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_fm.fit(docs, labels)
    got = {r.doc_id: r for r in quality_fm.quality_scores(docs, model).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    truth = [(got[d].score, got[d].predicted, q) for d, q in rows_of(sf_dir, "labels", "doc_id, quality") if
             got[d].held_out]
    good, bad = [s for s, _, q in truth if q == 1], [s for s, _, q in truth if q == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.95 and np.mean([p == q for _, p, q in truth]) > 0.93
    odd = quality_fm.quality_scores(awkward(spark), model).collect()
    assert len(odd) == awkward(spark).count() and all(0 <= r.score <= 1 for r in odd)
    assert quality_fm.quality_scores(nothing(spark), model).count() == 0


def test_missing_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality_fm.learn_and_score(awkward(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([*[(i, 1) for i in range(4, 17)], (None, 0), (3, None)], "doc_id bigint, quality int")
    assert all(r.score > 0.5 for r in quality_fm.learn_and_score(awkward(spark), one).collect())


def test_sample_is_bounded(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert quality_fm.training_rows(docs, labels, 20).count() == 20
