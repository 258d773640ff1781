import pytest
from pyspark.sql import functions as F

from rankloom.operators import postings
from rankloom.operators.lexical import lexical_join
from rankloom.operators.postings import load_lexical_index, search_lexical_index, write_lexical_index

DOCS = [(1, "the cat"), (2, None), (3, ""), (4, "the the cat, a dog"), (4, "the the cat, a dog"), (5, "THE-CAT"), (6, "élan Été")]
ASKS = [(1, "cat the"), (2, ""), (3, None), (4, "unknown word"), (5, "été cat cat")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def asks(spark):
    return spark.createDataFrame(ASKS, "query_id long, text string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_the_writer_cuts_each_text_once(spark, corpus, asks, tmp_path):
    whole = corpus.where("text is not null")
    reads = spark.sparkContext.accumulator(0)

    def read(text):
        reads.add(1)
        return text

    counted = whole.withColumn("text", F.udf(read, "string").asNondeterministic()("text"))
    write_lexical_index(counted, str(tmp_path / "index"), slice_rows=2)
    assert reads.value <= 2 * whole.count()  # counted, then cut
    unique = whole.dropDuplicates(["doc_id"])
    write_lexical_index(unique, str(tmp_path / "other"), slice_rows=2)
    hits = search_lexical_index(load_lexical_index(spark, str(tmp_path / "other")), asks, 3, first=1)[0]
    assert rows(hits) == rows(lexical_join(asks, unique, 3).select(hits.columns))


def test_a_search_reads_the_folders_of_its_tokens_once(spark, corpus, asks, tmp_path, monkeypatch):
    whole = corpus.where("text is not null").dropDuplicates(["doc_id"])
    index = write_lexical_index(whole, str(tmp_path / "index"))
    plans, store = [], postings.materialize

    def kept(df, name, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, name, *rest)

    monkeypatch.setattr(postings, "materialize", kept)
    assert search_lexical_index(index, asks, 3)[0].count()
    # A scan of the index carries its folder column; the stored postings do not.
    scans = [line for plan in plans for line in plan.splitlines() if "Relation [" in line and "gaps#" in line and "bucket#" in line]
    assert len(scans) == 1
