import pytest

from rankloom.operators import lexical
from rankloom.operators.lexical import query_terms, token_statistics

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


def test_tokens_meet_a_large_vocabulary_folded(spark, corpus, asks, monkeypatch):
    terms = query_terms(asks)
    few = token_statistics(corpus.where("text is not null"), terms)
    plans, store = {}, lexical.materialize

    def kept(df, name, *rest):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, name, *rest)

    monkeypatch.setattr(lexical, "materialize", kept)
    monkeypatch.setattr(lexical, "VOCABULARY_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = token_statistics(corpus.where("text is not null"), terms)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = plans["tokens"]
    assert plan.index("LeftSemi") < plan.index("Aggregate [token") < plan.index("Generate")
    assert (many.documents, many.mean_length) == (few.documents, few.mean_length) == (6, 16 / 6)
    assert rows(many.frequency) == rows(few.frequency)
    assert {(r.token, r.df) for r in many.frequency.collect()} == {("cat", 4), ("the", 4), ("été", 1)}
