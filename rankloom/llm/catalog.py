"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.hyperminhash import near_duplicates
from rankloom.llm.importance_resampling import resample
from rankloom.llm.int8_pairs import near_vectors
from rankloom.llm.packed_ids import matrix_digests, packed_matrix
from rankloom.llm.periodic_runs import plant_tails, run_digests
from rankloom.llm.piece_counts import token_counts
from rankloom.llm.quality_fm import learn_and_score
from rankloom.llm.quality_rules import rule_report
from rankloom.llm.secret_ledger import secret_report
from rankloom.llm.unit_dedup import dedup_report
from rankloom.llm.variable_bins import pack_documents
from rankloom.llm.warc_archives import archived_pages
from rankloom.llm.word_lexicon import encoding_digests
from rankloom.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(load(spark, sf_dir, "documents"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(load(spark, sf_dir, "documents"))


def op4_variable_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def op5_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))


def op6_int8_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_digests(packed_matrix(load(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_report(load(spark, sf_dir, "documents"))


def op10_word_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(load(spark, sf_dir, "documents"))


def op11_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(load(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(plant_tails(load(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def all_queries() -> dict[str, Query]:
    found = [op1_quality_fm, op2_unit_dedup, op3_secret_ledger, op4_variable_bins, op5_piece_counts, op6_int8_pairs,
             op7_hyperminhash, op8_packed_ids, op9_quality_rules, op10_word_lexicon, op11_warc_dictionary,
             op12_periodic_runs, op13_importance_resampling]
    return {query.__name__: query for query in found}
