import os

from pyspark.sql import functions as F

from rankloom.operators.encode import encode_column
from rankloom.operators.lexical import token_statistics
from rankloom.plans import bindings as b
from rankloom.plans.search_flow import distinct_documents, search_texts
from rankloom.session import materialize, scratch_root
from rankloom.sources.stores import read_vectors
from rankloom.streaming.encode_stream import encode_stream
from rankloom.streaming.search_stream import answer_stream

NAME, FACTORY = b.STRONG, b.ENCODERS[b.STRONG]


def test_stream_answers_equal_batch_answers(spark, sf_dir, tmp_path):
    corpus = b.text_corpus(spark, sf_dir)
    vectors = materialize(encode_column(distinct_documents(corpus), "text", NAME, FACTORY), "vectors")
    stats = token_statistics(corpus)
    asks = b.text_queries(spark, sf_dir).limit(12).repartition(3)
    asks.write.parquet(str(tmp_path / "asks"))
    stream = (spark.readStream.schema(asks.schema).option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "asks")))
    sink = str(tmp_path / "sink")
    for _ in range(2):  # the second start finds nothing new
        answer_stream(stream, corpus, vectors, stats, NAME, FACTORY, sink,
                      str(tmp_path / "progress")).awaitTermination()
    got = spark.read.parquet(sink)
    assert got.select("batch_id").distinct().count() == 3
    want = search_texts(spark.read.parquet(str(tmp_path / "asks")), corpus, NAME, FACTORY)
    columns = ["query_id", "doc_id", "retrieval_rank", "rerank_rank", "rerank_score", "verdict"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_each_text_is_stored_once(spark, tmp_path):
    source, store = str(tmp_path / "texts"), str(tmp_path / "store")
    for i, words in enumerate([["a", "b", "b"], ["b", "c"]]):
        spark.createDataFrame([(w,) for w in words], "text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("text string").parquet(source)
        encode_stream(stream, NAME, FACTORY, store, str(tmp_path / "progress")).awaitTermination()
    stored = read_vectors(spark, store)
    assert stored.count() == stored.select("text_key").distinct().count() == 3
    assert stored.where(F.col("model") == NAME).count() == 3


def test_micro_batches_leave_no_tables_behind(spark, sf_dir, tmp_path):
    corpus = b.text_corpus(spark, sf_dir)
    vectors = materialize(encode_column(distinct_documents(corpus), "text", NAME, FACTORY), "vectors")
    stats = token_statistics(corpus)
    asks = b.text_queries(spark, sf_dir).limit(4).repartition(2)
    asks.write.parquet(str(tmp_path / "asks"))
    stream = spark.readStream.schema(asks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "asks"))
    before = set(os.listdir(scratch_root(spark)))
    answer_stream(stream, corpus, vectors, stats, NAME, FACTORY, str(tmp_path / "sink"),
                  str(tmp_path / "progress")).awaitTermination()
    encode_stream(stream, NAME, FACTORY, str(tmp_path / "store"), str(tmp_path / "encoded")).awaitTermination()
    assert set(os.listdir(scratch_root(spark))) == before
    assert read_vectors(spark, str(tmp_path / "store")).count() == 4
