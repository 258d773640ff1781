import numpy as np
import pytest
from pyspark.errors import PySparkException

from rankloom.operators import ivf
from rankloom.operators.lexical import lexical_join
from rankloom.operators.search import rows_per_block, vector_bytes, depth, knn_join, knn_join_in_lists, top_k
from rankloom.plans import bindings as b
from rankloom.sources.guards import MissingInput
from rankloom.sources.stores import Index, load_index, save_index

SCHEMAS = ("query_id long, embedding array<float>", "doc_id long, embedding array<float>")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(120, 8)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[40:60] = data[0]  # copies: all tied
    data[60] = 0
    return data


@pytest.fixture(scope="module")
def frames(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMAS[0]), spark.createDataFrame(rows, SCHEMAS[1])


def brute(vectors, k, exclude_self=False):
    got = {}
    for q, v in enumerate(vectors.astype(np.float64)):
        scored = []
        for d, w in enumerate(vectors.astype(np.float64)):
            total = 0.0
            for x, y in zip(v, w):
                total += x * y
            scored.append((-total, d))
        scored = [s for s in sorted(scored) if not (exclude_self and s[1] == q)]
        got[q] = [d for _, d in scored[:k]]
    return got


def ranked(hits):
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.doc_id)
    return got


@pytest.mark.parametrize("exclude_self", [True, False])
def test_scan_and_block_paths_equal_brute_force(frames, vectors, exclude_self):
    queries, corpus = frames
    want = brute(vectors, 7, exclude_self)
    assert ranked(knn_join(queries, corpus, 7, exclude_self)) == want
    assert ranked(knn_join(queries.repartition(5), corpus.repartition(7), 7, exclude_self)) == want
    blocks = knn_join(queries, corpus, 7, exclude_self, max_broadcast_rows=0, query_block=25, doc_block=13)
    assert ranked(blocks) == want


def test_depth_and_clamp(frames):
    assert depth(None) == depth(0) == 20 and depth(3) == 3
    queries, corpus = frames
    hits = ranked(knn_join(queries, corpus.limit(4), 50))
    assert all(len(h) == 4 for h in hits.values())


def test_string_ids(spark, frames, vectors):
    queries, corpus = (f.withColumn(c, f[c].cast("string")) for f, c in zip(frames, ("query_id", "doc_id")))
    assert len(ranked(knn_join(queries, corpus, 3))["5"]) == 3


def test_single_query(frames, vectors):
    _, corpus = frames
    got = [r.doc_id for r in top_k(corpus, [float(x) for x in vectors[3]], 5).collect()]
    assert got == brute(vectors, 5)[3]


def test_full_probe_is_exact_and_few_probes_are_a_subset(frames, vectors):
    queries, corpus = frames
    index = ivf.build_index(corpus, ivf.LISTS, 6)
    assert not index.flat and index.vectors.count() == len(vectors)
    assert ranked(ivf.search_index(index, queries, 5, probes=6)) == brute(vectors, 5)
    one = ivf.search_index(index, queries, 5, probes=1)
    assert 0 < one.count() <= 5 * len(vectors)


def test_bounded_search_is_exact_and_reads_less(spark, frames, vectors, monkeypatch):
    queries, corpus = frames
    index = ivf.build_index(corpus, ivf.LISTS, 6)
    for probes in (1, 3):
        hits, reading = ivf.search_bounded(index, queries, 5, probes)
        assert ranked(hits) == brute(vectors, 5)
        assert all(probes <= r.lists <= 6 and r.members <= len(vectors) for r in reading.collect())
    assert ranked(ivf.search_bounded(index, queries, len(vectors) + 3)[0]) == brute(vectors, len(vectors))
    rng = np.random.default_rng(7)
    far = np.concatenate([rng.normal(size=8) * 10 + rng.normal(size=(30, 8)) * 0.1 for _ in range(6)])
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(far)], "doc_id long, embedding array<double>")
    index = ivf.build_index(table, ivf.LISTS, 6, seed=3)
    asked = table.withColumnRenamed("doc_id", "query_id")
    hits, reading = ivf.search_bounded(index, asked, 3)
    exact = knn_join(asked, table, 3)
    assert ranked(hits) == ranked(exact) and ivf.recall_at(hits, exact).first().recall == 1.0
    assert reading.agg({"members": "sum"}).first()[0] < 0.8 * len(far) ** 2
    few = ivf.recall_at(ivf.search_index(index, asked, 3, 1), exact).first()
    assert few.expected == 3 * len(far) and 0 < few.found <= few.expected
    monkeypatch.setattr(ivf, "small_enough", lambda *rest: False)
    assert ranked(ivf.search_bounded(index, asked, 3)[0]) == ranked(exact)


def test_hot_list_is_cut_into_blocks(spark, frames, vectors):
    queries, corpus = frames
    hot_q = queries.selectExpr("query_id", "embedding", "0L AS list_id")
    hot_d = corpus.selectExpr("doc_id", "embedding", "0L AS list_id")
    got = knn_join_in_lists(hot_q, hot_d, "list_id", 5, max_broadcast_rows=0, query_block=11, doc_block=17)
    assert ranked(got) == brute(vectors, 5)


def test_scan_and_block_paths_agree_on_probed_lists(frames):
    queries, corpus = frames
    index = ivf.build_index(corpus, ivf.LISTS, 6)
    probed = ivf.probe_lists(queries, "query_id", index.centroids, 2)
    scan = knn_join_in_lists(probed, index.vectors, "list_id", 5, True)
    blocks = knn_join_in_lists(probed, index.vectors, "list_id", 5, True, 0, 9, 10)
    assert ranked(scan) == ranked(blocks)


def test_only_probed_folders_are_read(spark, frames, tmp_path):
    _, corpus = frames
    save_index(ivf.build_index(corpus, ivf.LISTS, 6), str(tmp_path / "index"))
    index = load_index(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, [1.0] + [0.0] * 7)], SCHEMAS[0])
    plan = ivf.search_index(index, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan or "PartitionFilters: [(list_id" in plan


def test_kind_is_the_callers_choice(frames, vectors):
    queries, corpus = frames
    index = ivf.build_index(corpus)
    assert index.flat and ranked(ivf.search_index(index, queries, 4)) == brute(vectors, 4)
    assert ivf.list_count(20_000) == 142 and ivf.list_count(500) == 23 and ivf.list_count(0) == 1
    lists = ivf.build_index(corpus, ivf.LISTS)
    assert not lists.flat and lists.centroids.count() == ivf.list_count(corpus.count())
    norms = [sum(x * x for x in r.embedding) for r in lists.centroids.collect()]
    assert all(abs(n - 1) < 1e-9 for n in norms)
    with pytest.raises(ValueError):
        ivf.build_index(corpus, "tree")


@pytest.mark.parametrize("probes", [1, 3])
def test_blocked_assignment_equals_broadcast(frames, probes):
    _, corpus = frames
    centroids = ivf.build_index(corpus, ivf.LISTS, 7).centroids
    sent = ivf.probe_lists(corpus, "doc_id", centroids, probes)
    blocks = ivf.probe_lists(corpus, "doc_id", centroids, probes, max_bytes=0)
    pairs = lambda df: sorted((r.doc_id, r.list_id) for r in df.collect())
    assert pairs(sent) == pairs(blocks) and blocks.columns == sent.columns


def test_list_with_fewer_than_k_vectors(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMAS[0])
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMAS[1])
    centroids = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "list_id long, embedding array<double>")
    index = Index(ivf.probe_lists(docs, "doc_id", centroids), centroids)
    hits = ivf.search_index(index, queries, 5).collect()
    assert [(h.doc_id, h["rank"]) for h in hits] == [(1, 1)]


def test_index_store(spark, frames, tmp_path):
    queries, corpus = frames
    path = str(tmp_path / "index")
    assert load_index(spark, path) is None
    with pytest.raises(MissingInput):
        save_index(None, path)
    with pytest.raises(MissingInput):
        ivf.search_index(None, queries)
    for index in (ivf.build_index(corpus, ivf.LISTS, 6), ivf.build_index(corpus)):
        want = ranked(ivf.search_index(index, queries, 4, probes=6))
        save_index(index, path)
        loaded = load_index(spark, path)
        assert loaded.flat == index.flat
        assert ranked(ivf.search_index(loaded, queries, 4, probes=6)) == want


def test_top_k_plans(frames, vectors, spark):
    queries, corpus = frames
    plan = knn_join(queries, corpus, 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Cartesian" not in plan and "NestedLoop" not in plan
    single = top_k(corpus, [float(x) for x in vectors[0]], 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in single


def test_lexical_blocks_equal_scan_and_brute_force(spark):
    docs = ["the cat sat", "the dog sat on the mat", "", "zebra", "Cat cat CAT, the cat!", "the the the"]
    asks = ["the cat", "zebra mat", "unknown words", "the"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asks)), "query_id long, text string")
    split = lambda t: [w.strip(",!").lower() for w in t.split()]
    mean = np.mean([len(split(d)) for d in docs])
    want = {}
    for q, ask in enumerate(asks):
        scored = []
        for d, doc in enumerate(docs):
            total = 0.0
            for t in set(split(ask)):
                df = sum(t in split(x) for x in docs)
                tf = split(doc).count(t)
                idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(split(doc)) / mean)) if tf else 0
            if total:
                scored.append((-round(total, 6), d))
        if scored:
            want[q] = [d for _, d in sorted(scored)[:2]]
    assert ranked(lexical_join(queries, corpus, 2)) == want
    assert ranked(lexical_join(queries, corpus, 2, max_broadcast_rows=0, query_block=2, doc_block=2)) == want


def test_contained_passages_are_found(spark, sf_dir):
    queries, corpus = b.text_queries(spark, sf_dir), b.text_corpus(spark, sf_dir)
    hits = {(r.query_id, r.doc_id) for r in lexical_join(queries, corpus, 10).collect()}
    asks, docs = queries.collect(), corpus.collect()
    truth = {(q.query_id, d.doc_id) for q in asks for d in docs if q.text in d.text}
    assert truth and truth <= hits


def test_vector_of_other_size_fails(spark, frames):
    queries, _ = frames
    odd = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMAS[1])
    with pytest.raises(PySparkException):
        knn_join(queries, odd, 1).collect()


def test_letters_that_python_splits_otherwise(spark):
    # U+0870 is a letter to Python and none to the JVM, which counts the frequencies.
    corpus = spark.createDataFrame([(1, "alpha\u0870beta common"), (2, "common words")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "beta")], "query_id long, text string")
    assert [(h.query_id, h.doc_id) for h in lexical_join(queries, corpus, 2).collect()] == [(1, 1)]


def test_blocks_follow_bytes(spark, frames):
    queries, corpus = frames
    rows = corpus.count()
    per_row = 8 * len(corpus.first().embedding)
    assert rows_per_block(corpus, vector_bytes(), 10 * per_row) == 10
    assert rows_per_block(corpus.where("false"), vector_bytes()) == 1
    plan = knn_join(queries, corpus, 3, max_broadcast_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
