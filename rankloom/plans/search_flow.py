"""Two-stage search: cheap retrieval over the corpus, costly scoring of the few hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import content_key
from rankloom.operators.encode import Batching, EncoderFactory, encode_column, encode_missing
from rankloom.operators.ivf import search_index
from rankloom.operators.lexical import query_terms, token_statistics
from rankloom.operators.rerank import PairScorer, coverage_scores, rerank, score_candidates, verdict
from rankloom.operators.search import knn_join, lookup_hits
from rankloom.session import materialize
from rankloom.sources.stores import Index, append_vectors, read_vectors

RETRIEVE = 10
KEEP = 5


def distinct_documents(corpus: DataFrame) -> DataFrame:
    """Each text once, under its smallest document id. Copies fold together per
    task before the shuffle, so a text that fills a third of the corpus is cheap."""
    return (corpus.where("text is not null").groupBy("text")
            .agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text"))


@dataclass(frozen=True)
class Scorer:
    """A pair scorer to plug in: a name and what builds it in each Python worker."""

    name: str
    factory: Callable[[], PairScorer]


def rerank_hits(hits: DataFrame, queries: DataFrame, corpus: DataFrame, keep: int | None = KEEP,
                stats=None, scorer: Scorer | None = None) -> DataFrame:
    """Look up the hit texts, rescore, keep the best, and give each a verdict.

    The hits are written first: a few rows per query of known size, so the
    optimizer can send them to the corpus scan instead of shuffling it. Without
    a ``scorer`` the share of the query's weighted terms decides.
    """
    hits = materialize(hits, "hits").select(
        "query_id", "doc_id", F.col("score").alias("retrieval_score"),
        F.col("rank").alias("retrieval_rank"))
    found = lookup_hits(hits, corpus)
    if scorer is not None:
        asked = found.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        scored = score_candidates(asked, scorer.name, scorer.factory)
    else:
        if stats is None:
            stats = token_statistics(corpus, query_terms(queries))
        scored = coverage_scores(found, queries, stats)
    return rerank(scored, keep).select(
        "query_id", "doc_id", "retrieval_score", "retrieval_rank", "rerank_score", "rerank_rank",
        verdict(F.col("rerank_score")).alias("verdict"), "text")


def stored_vectors(corpus: DataFrame, store: str, name: str, factory: EncoderFactory,
                   batching: Batching | None = None) -> DataFrame:
    """(doc_id, embedding) of ``corpus(doc_id, text)``; texts that the embedding
    store lacks are encoded and added to it first, so no text is encoded twice."""
    spark = corpus.sparkSession
    missing = encode_missing(corpus, read_vectors(spark, store), name, factory, batching=batching)
    append_vectors(missing, store, compared=True)
    vectors = read_vectors(spark, store).where(F.col("model") == name).select("text_key", "embedding")
    keyed = corpus.where("text is not null").select("doc_id", content_key(name, F.col("text")).alias("text_key"))
    return keyed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).join(vectors, "text_key").select(
        "doc_id", "embedding")


def search_texts(queries: DataFrame, corpus: DataFrame, name: str, factory: EncoderFactory,
                 retrieve: int | None = RETRIEVE, keep: int | None = KEEP,
                 corpus_vectors: DataFrame | None = None, stats=None, index: Index | None = None,
                 probes: int = 1, store: str | None = None, scorer: Scorer | None = None,
                 batching: Batching | None = None) -> DataFrame:
    """Answer ``queries(query_id, text)`` from ``corpus(doc_id, text)``.

    Vectors come from an ``index`` searched with ``probes`` lists per query, from
    ``corpus_vectors``, from an embedding ``store``, or are made here, ``batching`` telling how.
    """
    query_vectors = materialize(encode_column(queries, "text", name, factory, batching=batching), "queries")
    if index is not None:
        hits = search_index(index, query_vectors, retrieve, probes)
    else:
        if corpus_vectors is None and store is not None:
            corpus_vectors = stored_vectors(corpus, store, name, factory, batching)
        if corpus_vectors is None:
            corpus_vectors = encode_column(distinct_documents(corpus), "text", name, factory, batching=batching)
        hits = knn_join(query_vectors, corpus_vectors, retrieve)
    return rerank_hits(hits, queries, corpus, keep, stats, scorer)
