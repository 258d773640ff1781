import pytest

from rankloom.operators.lexical import lexical_join, query_terms, token_statistics
from rankloom.operators.postings import load_lexical_index, search_lexical_index, write_lexical_index
from rankloom.plans import bindings as b
from rankloom.sources.guards import MissingInput

COLUMNS = ["query_id", "doc_id", "score", "rank"]


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def test_saved_index_equals_the_scan(spark, sf_dir, tmp_path):
    corpus, queries = b.text_corpus(spark, sf_dir), b.text_queries(spark, sf_dir)
    want = rows(lexical_join(queries, corpus, 5))
    # Small slices: bounds must decide which of many slices are read.
    write_lexical_index(corpus, str(tmp_path / "index"), buckets=4, slice_rows=8)
    index = load_lexical_index(spark, str(tmp_path / "index"))
    for first in (1, 4, 1_000):
        hits, read = search_lexical_index(index, queries, 5, first)
        assert rows(hits) == want
        share = read.selectExpr("sum(postings) / sum(of_postings) AS share").first()["share"]
        assert share == 1 if first == 1_000 else share < 1
    by_default = write_lexical_index(corpus, str(tmp_path / "other"))
    assert rows(search_lexical_index(by_default, queries, 5)[0]) == want


def test_statistics_of_the_index_are_those_of_the_texts(spark, sf_dir, tmp_path):
    corpus = b.text_corpus(spark, sf_dir)
    index = write_lexical_index(corpus, str(tmp_path / "index"))
    got, want = index.statistics(), token_statistics(corpus)
    assert (got.documents, got.mean_length) == (want.documents, want.mean_length)
    assert sorted(map(tuple, got.frequency.collect())) == sorted(map(tuple, want.frequency.collect()))


def test_only_the_folders_of_asked_tokens_are_read(spark, sf_dir, tmp_path):
    corpus = b.text_corpus(spark, sf_dir)
    index = write_lexical_index(corpus, str(tmp_path / "index"), buckets=16)
    asked = spark.createDataFrame([(1, "zebra")], "query_id long, text string")
    folder = query_terms(asked).selectExpr("pmod(xxhash64(token), 16) AS bucket").first()["bucket"]
    plan = index.postings.where(f"bucket IN ({folder})")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan
    assert search_lexical_index(index, asked, 3)[0].count() == lexical_join(asked, corpus, 3).count()


def test_awkward_texts(spark, tmp_path):
    docs = [(1, "the cat"), (2, None), (3, ""), (-4, "the the cat " * 3_000), (None, "cat"), (5, "THE-CAT"), (1 << 60, "cat")]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    asks = spark.createDataFrame([(1, "cat the"), (2, ""), (3, None), (4, "unknown"), (5, "cat cat")], "query_id long, text string")
    whole = corpus.where("doc_id is not null")
    index = write_lexical_index(corpus, str(tmp_path / "index"), slice_tokens=4)
    for k in (1, 2, 10):
        assert rows(search_lexical_index(index, asks, k, first=1)[0]) == rows(lexical_join(asks, whole, k))
    assert rows(search_lexical_index(index, asks.where("false"), 3)[0]) == []
    words = asks.selectExpr("cast(query_id AS string) AS query_id", "text")
    assert rows(search_lexical_index(index, words, 3)[0]) == rows(lexical_join(words, whole, 3))


def test_empty_and_missing_index(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "cat")], "query_id long, text string")
    index = write_lexical_index(empty, str(tmp_path / "index"))
    assert search_lexical_index(index, asks)[0].count() == 0
    assert load_lexical_index(spark, str(tmp_path / "none")) is None
    with pytest.raises(MissingInput):
        search_lexical_index(None, asks)


def test_a_failed_save_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "index")
    one = spark.createDataFrame([(1, "cat")], "doc_id long, text string")
    write_lexical_index(one, path)
    with pytest.raises(Exception):
        write_lexical_index(one.selectExpr("doc_id", "raise_error('lost') AS text"), path)
    assert load_lexical_index(spark, path).documents == 1
