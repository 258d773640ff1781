"""Second stage: a costlier scorer over the few candidates of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators.encode import worker_key
from rankloom.operators.lexical import TokenStatistics, query_weights
from rankloom.operators.search import depth

COVERAGE_MIDPOINT = 0.5


class PairScorer(Protocol):
    """Scores (question, text) pairs; above zero means relevant."""

    name: str

    def score(self, questions: list[str], texts: list[str]) -> list[float]: ...


_workers_scorers: dict[str, PairScorer] = {}


def score_candidates(candidates: DataFrame, name: str, factory: Callable[[], PairScorer],
                     batch_size: int = 64) -> DataFrame:
    """Add ``rerank_score`` with a plugged-in scorer, built once per Python worker.

    ``candidates`` has ``query`` and ``text`` columns; the rest passes through.
    """
    fields = candidates.schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["rerank_score double"])
    key = worker_key(name, factory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers_scorers:
            _workers_scorers[key] = factory()
        scorer = _workers_scorers[key]
        for batch in batches:
            questions = batch.column("query").to_pylist()
            texts = batch.column("text").to_pylist()
            scores: list[float] = []
            for i in range(0, len(texts), batch_size):
                scores += [float(s) for s in scorer.score(
                    questions[i:i + batch_size], texts[i:i + batch_size])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "rerank_score"])

    return candidates.mapInArrow(run, schema)


def _weight_of(found: Column, terms: Column) -> Column:
    """Sum of ``idf`` of the tokens ``found`` among ``terms(token, idf)``, both in one order."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("held"))
    return F.aggregate(
        terms, start, lambda so_far, term: F.when(
            F.get(found, so_far["at"]) == term["token"],
            F.struct((so_far["at"] + 1).alias("at"), (so_far["held"] + term["idf"]).alias("held"))).otherwise(so_far),
        lambda so_far: so_far["held"])


def coverage_scores(candidates: DataFrame, queries: DataFrame,
                    stats: TokenStatistics) -> DataFrame:
    """Add ``rerank_score``: share of the query's idf weight the text covers, less one half.

    The default scorer, inside the JVM: candidates are few, so each checks its
    own tokens; only document frequencies come from the whole corpus.
    """
    weights = query_weights(queries, stats)
    terms = weights.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("token", "idf"))).alias("_terms"),
        F.sum("idf").alias("_whole"))
    # The intersection splits the text once and keeps the order of the terms, so one walk
    # along them finds the weights; as a lambda's variable it is not worked out per term.
    shared = F.array_intersect(F.col("_terms.token"), tokens(F.col("text")))
    held = F.get(F.transform(F.array(shared), lambda found: _weight_of(found, F.col("_terms"))), F.lit(0))
    share = F.coalesce(F.try_divide(held, F.col("_whole")), F.lit(0.0))
    return (
        candidates.join(terms, "query_id", "left")
        .withColumn("rerank_score", F.round(share - F.lit(COVERAGE_MIDPOINT), 6) + F.lit(0.0))
        .drop("_terms", "_whole")
    )


def rerank(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Best ``k`` by ``rerank_score``; equal scores keep their retrieval order."""
    by = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("retrieval_rank"))
    return (scored.withColumn("rerank_rank", F.row_number().over(by).cast("long"))
            .where(F.col("rerank_rank") <= depth(k)))


def verdict(score: Column) -> Column:
    """Relevant only above zero."""
    return F.when(score > 0, F.lit("RELEVANT")).otherwise(F.lit("IRRELEVANT"))
