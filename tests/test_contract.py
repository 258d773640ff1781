"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check import connect, difference
from rankloom.plans import catalog

QUICK = ["pair_scan", "popularity_scan", "l2_normalize", "content_key", "template_fill", "encode_hash", "topk_exact",
         "ivf_build", "ivf_search_saved", "knn_join", "retrieve_rerank", "retrieve_rerank_scorer", "metrics_missing_scores", "lexical_candidates", "rerank_topk",
         "split_fractions", "split_fallback", "sample_without_replacement", "sample_foreign_answers", "balanced_pairs",
         "classification_metrics", "fixed_threshold_table", "ndcg_global", "class_support", "viral_irrelevant",
         "distinct_texts", "two_model_report"]
NAMES = sorted(catalog.all_queries()) if os.environ.get("CHECK_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    got = contract.queries()[name](spark, sf_dir).toPandas()
    statement = contract.oracle_sql().get(name)
    if statement is not None:
        assert difference(got, connect(sf_dir).execute(statement).df()) is None
    assert len(got) > 0


def test_every_statement_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    own = set(catalog.all_queries())
    assert own <= set(contract.oracle_sql())


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns[:2] == ["query_id", "doc_id"] and found.count() > 0
