import numpy as np
import pyarrow as pa
import pytest

from rankloom.operators import ivf, search
from rankloom.operators.search import Hits, VectorScorer, knn_join

RNG = np.random.default_rng(5)


def table(name, ids, matrix):
    return pa.table({name: pa.array(ids), "embedding": pa.array([list(map(float, v)) for v in matrix], pa.list_(pa.float32()))})


def best(queries, docs, k, exclude_self):
    scores = np.zeros((len(queries), len(docs)))
    for j in range(queries.shape[1]):
        scores += queries[:, j, None].astype(np.float64) * docs[None, :, j].astype(np.float64)
    if exclude_self:
        np.fill_diagonal(scores, -np.inf)
    order = [np.lexsort((np.arange(len(docs)), -row))[:k] for row in scores]
    return [(q, int(d), scores[q, d]) for q, found in enumerate(order) for d in found]


@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("held", [search.HELD, 50])
def test_candidates_stay_few_and_hits_exact(monkeypatch, exclude_self, held):
    monkeypatch.setattr(search, "HELD", held)
    vectors = RNG.normal(size=(1_500, 16)).astype(np.float32)
    vectors[200:900] = vectors[100]  # copies: all tied
    vectors[900] = vectors[100] * np.float32(1 + 1e-6)  # and one that single precision may not tell apart
    scorer, hits = VectorScorer(table("query_id", range(1_500), vectors), exclude_self), Hits(5)
    ids, docs = np.arange(1_500), table("doc_id", range(1_500), vectors)
    monkeypatch.setattr(search, "DOC_TILE", 128)
    rows, _, _ = scorer.found(ids, docs, hits)
    assert len(rows) < 60 * len(vectors)
    for start in range(0, 1_500, 400):  # batches follow each other, as in a scan
        part = slice(start, start + 400)
        scorer.collect(ids[part], docs.slice(start, 400), hits)
    got = list(zip(hits.rows.tolist(), hits.docs.tolist(), hits.scores.tolist()))
    assert got == best(vectors, vectors, 5, exclude_self)


def test_floor_is_the_kth_score_and_least_bounds_hits():
    hits = Hits(2)
    hits.add(np.array([0, 0, 0, 2]), np.array([1, 2, 3, 1]), np.array([0.5, 0.9, 0.7, 0.3]))
    assert hits.floor(0, 3).tolist() == [0.7, -np.inf, -np.inf] and hits.floor(1, 2).tolist() == [-np.inf, -np.inf]
    vectors = np.eye(3, dtype=np.float32)
    asked = table("query_id", range(3), vectors).append_column("least", pa.array([0.5, 0.5, 2.0]))
    rows, docs, _ = VectorScorer(asked).found(np.arange(3), table("doc_id", range(3), vectors), Hits(3))
    assert list(zip(rows, docs)) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("scale", [1e-30, 1e25])
def test_sizes_beyond_single_precision(scale):
    vectors = (RNG.normal(size=(40, 4)) * scale).astype(np.float32)
    hits = Hits(3)
    VectorScorer(table("query_id", range(40), vectors)).collect(np.arange(40), table("doc_id", range(40), vectors), hits)
    assert list(zip(hits.rows.tolist(), hits.docs.tolist(), hits.scores.tolist())) == best(vectors, vectors, 3, False)


def test_full_probe_makes_no_row_per_list(spark, monkeypatch):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(RNG.normal(size=(60, 4)))]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    index = ivf.build_index(corpus, ivf.LISTS, 5)
    want = sorted(map(tuple, knn_join(queries, corpus, 3).collect()))

    def refused(*_):
        raise AssertionError("vectors once per list")

    monkeypatch.setattr(ivf, "probe_lists", refused)
    assert sorted(map(tuple, ivf.search_index(index, queries, 3, probes=5).collect())) == want


def test_many_probes_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PROBED_ROWS", 8)
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "doc_id long, embedding array<float>").coalesce(1)
    centres = spark.createDataFrame([(i, [1.0, float(-i)]) for i in range(6)], "list_id long, embedding array<double>")
    probed = ivf.probe_lists(corpus, "doc_id", centres, 4)

    assert probed.count() == 120
    assert probed.groupBy("doc_id").count().where("count <> 4").count() == 0
