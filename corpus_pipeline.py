"""Corpus preparation in stages: rules, near-duplicates, repeats, secrets, packing.

Each stage takes the documents that its predecessor kept and gives documents of
the same columns; the last one gives the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.hyperminhash import first_of_groups
from rankloom.llm.quality_rules import keep_good
from rankloom.llm.secret_ledger import redact_secrets
from rankloom.llm.unit_dedup import drop_repeats
from rankloom.llm.variable_bins import pack_documents
from rankloom.session import materialize

#: Similarity, in percent, of five-word shingle sets at which the stage links; op7 has a contract of its own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the least id."""
    return first_of_groups(docs, NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds."""
    shortened, removed = drop_repeats(docs)
    return shortened.drop(removed)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_start, bin_size) of every document's pieces."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Best fit is a sequential choice that SQL does not express; the tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two of them is stored once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
