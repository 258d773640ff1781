import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.vectors import fuse, l2_normalize
from rankloom.operators.encode import (
    HashingEncoder, align_pairs, encode_column, encode_missing, encode_texts, encode_with_store, score_pairs)
from rankloom.plans.bindings import ENCODERS, STRONG
from rankloom.session import materialize
from rankloom.sources.stores import append_vectors, read_vectors

FACTORY = ENCODERS[STRONG]


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def length_factory():
    """A factory that workers get by value: they cannot import the tests."""
    class LengthEncoder:
        name = "odd"

        def encode(self, given):
            return np.array([[float(len(t)), 1.0] for t in given])

    return lambda: LengthEncoder()


def test_unit_length_and_zero_vector(spark):
    df = texts(spark, "One two two", "!!!", "")
    rows = encode_column(df.withColumn("k", F.col("text")), "text", STRONG, FACTORY).collect()
    norms = {r.k: float(np.linalg.norm(r.embedding)) for r in rows}
    assert norms["One two two"] == pytest.approx(1, abs=1e-6)
    assert norms["!!!"] == norms[""] == 0.0
    assert all(len(r.embedding) == 64 for r in rows)


def test_no_texts_give_no_rows(spark):
    assert encode_texts(texts(spark, "a").limit(0), STRONG, FACTORY).count() == 0
    assert HashingEncoder(8).encode([]).shape == (0, 8)


def test_each_text_once_and_nulls_left_out(spark):
    rows = encode_texts(texts(spark, "a", "a", "b", None, "a;b"), STRONG, FACTORY)
    assert rows.count() == 3


def test_batch_size_does_not_matter(spark):
    df = texts(spark, *[f"word{i} word{i % 7}" for i in range(50)]).withColumn("k", F.col("text"))
    small = {r.k: r.embedding for r in encode_column(df, "text", STRONG, FACTORY, batch_size=3).collect()}
    large = {r.k: r.embedding for r in encode_column(df, "text", STRONG, FACTORY).collect()}
    assert small == large


def test_store_is_incremental(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_vectors(spark, path).count() == 0
    append_vectors(encode_missing(texts(spark, "a", "b"), read_vectors(spark, path), STRONG, FACTORY), path)
    stored = read_vectors(spark, path)
    assert stored.count() == 2
    assert encode_missing(texts(spark, "a", "b", "c"), stored, STRONG, FACTORY).count() == 1
    assert encode_with_store(texts(spark, "b", "c", "c"), stored, STRONG, FACTORY).count() == 2
    # Another model shares nothing.
    assert encode_missing(texts(spark, "a"), stored, "odd", length_factory()).count() == 1


def test_plugged_in_encoder(spark):
    got = encode_texts(texts(spark, "abc"), "odd", length_factory()).first()
    assert got.model == "odd" and list(got.embedding) == [3.0, 1.0]


def test_pair_score_is_cosine(spark):
    pairs = spark.createDataFrame(
        [("1", "red fox", "red fox"), ("2", "red fox", "blue"), ("3", "red fox", "red fox"), ("4", "", "red")],
        "pair_id string, query string, comment string")
    got = {r.pair_id: r.score for r in score_pairs(pairs, STRONG, FACTORY).collect()}
    assert got["1"] == got["3"] == pytest.approx(1, abs=1e-6)
    assert got["2"] < 1 and got["4"] == 0.0


def test_normalize_and_fuse(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([3.0, 4.0], None), ([0.0, 0.0], [0.0, 0.0])],
                               "q array<float>, c array<float>")
    rows = df.select(l2_normalize(F.col("q")).alias("n"), fuse(F.col("q"), F.col("c")).alias("f")).collect()
    assert rows[0].n == [0.6, 0.8]
    assert rows[0].f == pytest.approx([0.5 ** 0.5] * 2)
    assert rows[1].f == [3.0, 4.0]
    assert rows[2].n == rows[2].f == [0.0, 0.0]


def test_a_hot_text_is_split_over_tasks(spark):
    """One comment in most pairs: adaptive execution cuts its join partition."""
    lowered = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
               "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
               "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
               "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in lowered}
    for k, v in lowered.items():
        spark.conf.set(k, v)
    try:
        pairs = spark.range(4000).repartition(8).selectExpr(
            "id pair_id", "concat('question ', id % 400) query",
            "if(id % 10 < 8, 'the hot comment', concat('comment ', id)) comment")
        texts = pairs.selectExpr("explode(array(query, comment)) text").distinct()
        vectors = materialize(encode_texts(texts, "m", lambda: HashingEncoder(8)), "vectors")
        joined = align_pairs(materialize(pairs, "pairs").repartition(8), vectors, "m")
        assert joined.count() == 4000 and len(joined.select("pair_id").distinct().collect()) == 4000
        joined.write.format("noop").mode("overwrite").save()
        found = joined.select("pair_id", "left_embedding", "right_embedding")
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
