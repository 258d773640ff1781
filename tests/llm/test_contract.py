"""The registered queries of this subpackage against their SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as contract
from check import connect, difference
from rankloom.llm import catalog, oracle


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query_equals_sql(spark, sf_dir, name):
    got = contract.queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0 and difference(got, connect(sf_dir).execute(oracle.statements()[name]).df()) is None


def test_every_operator_is_registered_once():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in catalog.all_queries())
    assert numbers == list(range(1, 14))
    assert {*catalog.all_queries(), "pipeline"} <= set(contract.queries())
    assert set(oracle.statements()) <= set(catalog.all_queries())


COLUMNS = {
    "op1_quality_fm": ["doc_id", "held_out", "score", "predicted"],
    "op4_variable_bins": ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_start", "bin_size"],
    "op5_piece_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8_packed_ids": ["shard", "row", "n_tokens", "ids_sha256", "cu_seqlens", "resets", "doc_ids", "doc_starts"],
    "op12_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"],
    "op10_word_lexicon": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_shapes_without_sql(spark, sf_dir, name):
    found = contract.queries()[name](spark, sf_dir)
    assert found.columns == COLUMNS[name] and found.count() > 0


def test_native_main_path(spark, sf_dir):
    """The secret scan runs no Python."""
    plan = contract.queries()["op3_secret_ledger"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
