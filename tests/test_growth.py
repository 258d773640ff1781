import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rankloom.operators.encode import Batching, HashingEncoder, encode_column
from rankloom.operators.growth import add_vectors, drop_vectors, load_growing, split_lists, start_index
from rankloom.operators.ivf import mean_vectors, probe_lists, search_index
from rankloom.operators.search import knn_join
from rankloom.operators.curves import auc
from rankloom.operators.sketch import merge_sketches, score_sketch, sketch_areas
from rankloom.plans import bindings as b
from rankloom.session import materialize, scratch_root, scratch_scope
from rankloom.sources import stores
from rankloom.sources.guards import MissingInput
from rankloom.sources.stores import Index, append_vectors, read_vectors
from rankloom.sources.versions import State, commit, read_state


def files(folder):
    return {os.path.join(at, name): os.stat(os.path.join(at, name)).st_mtime_ns
            for at, _, names in os.walk(folder) for name in names if name.endswith(".parquet")}


def hits(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


def test_changed_index_equals_a_fresh_search(spark, sf_dir, tmp_path):
    path, corpus = str(tmp_path / "index"), b.vector_corpus(spark, sf_dir)
    centroids = materialize(mean_vectors(b.load(spark, sf_dir, "embeddings"), "label"), "centroids")
    with pytest.raises(MissingInput):
        add_vectors(corpus, path)
    start_index(Index(probe_lists(corpus.where("doc_id % 4 = 0"), "doc_id", centroids), centroids), path)
    before = files(tmp_path / "index" / "vectors")
    for i in (1, 2, 3):
        add_vectors(corpus.where(f"doc_id % 4 = {i}"), path)
    add_vectors(corpus.where("false"), path)
    drop_vectors(corpus.where("doc_id % 5 = 0").select("doc_id"), path)
    assert read_state(spark, path).version == 5  # an empty addition is none
    live = corpus.where("doc_id % 5 <> 0")
    largest = live.count() // 12
    count = split_lists(spark, path, largest)
    assert count > 0
    index = load_growing(spark, path)
    assert index.centroids.count() == centroids.count() + count
    after = files(tmp_path / "index" / "vectors")
    assert before.items() <= after.items()  # nothing was rewritten
    split = read_state(spark, path).names("split")[0]
    lists = {name.split("list_id=")[1].split("/")[0] for name in after if split in name}
    assert len(lists) <= 2 * count and min(map(int, lists)) >= 10
    queries = b.vector_queries(spark, sf_dir).limit(40)
    want = hits(knn_join(queries, live, 5))
    assert hits(search_index(index, queries, 5, index.centroids.count())) == want
    start_index(index, path)
    assert [p.kind for p in read_state(spark, path).parts] == ["base"]
    assert hits(search_index(load_growing(spark, path), queries, 5, 1_000)) == want


def test_replaced_vectors_and_flat_index(spark, tmp_path):
    path = str(tmp_path / "flat")
    kind = "doc_id long, embedding array<float>"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], kind)
    start_index(Index(rows.withColumn("list_id", F.lit(0)), None), path)
    add_vectors(spark.createDataFrame([(1, [0.6, 0.8]), (3, [1.0, 0.0])], kind), path, replace=True)
    drop_vectors(spark.createDataFrame([(2,), (None,), (2,)], "doc_id long"), path)
    add_vectors(spark.createDataFrame([(2, [0.8, 0.6])], kind), path)
    got = {r.doc_id: [round(x, 3) for x in r.embedding] for r in load_growing(spark, path).vectors.collect()}
    assert got == {1: [0.6, 0.8], 2: [0.8, 0.6], 3: [1.0, 0.0]}
    assert split_lists(spark, path, 1) == 0
    assert load_growing(spark, str(tmp_path / "none")) is None
    empty = str(tmp_path / "empty")
    start_index(Index(rows.where("false").withColumn("list_id", F.lit(0)), None), empty)
    assert load_growing(spark, empty).vectors.count() == 0
    add_vectors(rows, empty)
    assert load_growing(spark, empty).vectors.count() == 2


def test_of_two_writers_one_fails(spark, tmp_path):
    path, state = str(tmp_path / "table"), State()
    commit(spark, path, state, [state.new_part("add")])
    with pytest.raises(PySparkException):
        commit(spark, path, state, [state.new_part("add")])
    assert read_state(spark, path).version == 1


def keyed(spark, low, high):
    return spark.range(low, high).select(
        F.md5(F.col("id").cast("string")).alias("text_key"),
        F.array(F.col("id").cast("float")).alias("embedding"), F.lit("m").alias("model"))


def test_store_stays_few_files_and_reads_only_wanted_folders(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    for i in range(9):
        append_vectors(keyed(spark, 0, i + 3), path, fan=3)  # one new vector each time after the first
    stored = read_vectors(spark, path)
    assert stored.count() == stored.select("text_key").distinct().count() == 11
    assert [p.level for p in read_state(spark, path).parts] == [2]
    wanted = materialize(keyed(spark, 0, 1), "wanted")
    prefix = wanted.first().text_key[0]
    read = read_vectors(spark, path, wanted)
    assert wanted.join(read, "text_key").count() == 1
    touched = {r[0] for r in read.select(F.col("_metadata.file_path")).distinct().collect()}
    assert touched and all(f"prefix={prefix}/" in name for name in touched)
    # A merge that ends before its commit leaves every vector where it was.
    for i in (20, 30):
        append_vectors(keyed(spark, i, i + 2), path, fan=10)
    monkeypatch.setattr(stores, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        stores.compact_vectors(spark, path, fan=2)
    assert read_vectors(spark, path).count() == 15


def test_scratch_scope_drops_its_tables(spark):
    before = set(os.listdir(scratch_root(spark)))
    with pytest.raises(ValueError), scratch_scope(spark) as folder:
        kept = materialize(spark.range(3), "inner").count()
        assert kept == 3 and os.listdir(folder)
        raise ValueError
    assert set(os.listdir(scratch_root(spark))) == before
    assert materialize(spark.range(3), "outer").count() == 3


def test_batches_by_length_give_the_same_vectors(spark):
    texts = ["word " * (i * i % 37) for i in range(200)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, i long")
    by_budget = Batching(16, 400)
    factory = lambda: HashingEncoder(8)
    plain = {r.i: r.embedding for r in encode_column(df, "text", "h", factory).collect()}
    sorted_ = {r.i: r.embedding for r in encode_column(df, "text", "h", factory, batching=by_budget).collect()}
    assert plain == sorted_
    lengths = np.array(list(map(len, texts)))
    groups = by_budget.groups(lengths)
    assert sorted(np.concatenate(groups).tolist()) == list(range(200))
    assert all(len(g) <= 16 and (len(g) == 1 or len(g) * lengths[g].max() <= 400) for g in groups)
    assert by_budget.padding(lengths) < 0.5 * Batching(16).padding(lengths)
    assert Batching(4, 10).groups(np.array([], np.int64)) == [] and Batching(4, 10).padding(np.array([0, 0])) == 0.0


def test_sketch_holds_the_exact_areas(spark, golden, sf_dir):
    scored = b.scored_pairs(spark, sf_dir)
    for rows, by in ((golden, ("model",)), (scored, ("model",)), (golden.where("true_label = 1"), ())):
        for bits in (1, 4, 16):
            parts = [score_sketch(rows.where(f"hash(pair_id) % 2 = {i}"), by, bits) for i in (-1, 0, 1)]
            got = sketch_areas(merge_sketches(parts, by), by).first()
            exact = auc(rows, by).first()
            assert got.pr_low - 1e-9 <= exact.pr_auc <= got.pr_high + 1e-9
            if exact.roc_auc is None:
                assert got.roc_low is None
                continue
            assert got.roc_low - 1e-9 <= exact.roc_auc <= got.roc_high + 1e-9
    assert sketch_areas(score_sketch(golden.where("false"), ("model",)), ("model",)).count() == 0
