"""Sparse text retrieval: BM25 top-k without moving the postings.

A document's own row holds all its tokens, so its scores against every query
are local to that row. Only the statistics (document frequency, size, mean
length) are aggregated. No token is dropped, however common.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators.search import (
    BLOCK_BYTES, Hits, _keyed_blocks, _scan_with_block, best_per_query, column_ids, depth,
    rows_per_block, small_enough, spread_small)
from rankloom.session import materialize

K1 = 1.2
B = 0.75
#: A vocabulary of so many tokens travels to the texts; frequencies of a larger one are folded before they meet it.
VOCABULARY_ROWS = 200_000


@dataclass
class TokenStatistics:
    """Corpus size, mean length in tokens, and (token, df) for a vocabulary."""

    documents: int
    mean_length: float
    frequency: DataFrame


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token), each token of a query once."""
    return queries.select(
        "query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))


def token_statistics(corpus: DataFrame, vocabulary: DataFrame | None = None) -> TokenStatistics:
    """One pass over the corpus, folded per task before the shuffle.

    Every document adds an empty token that carries its length; that row's count
    is the corpus size. A vocabulary limits the frequencies kept, not the texts read;
    it is stored once. However large it is, tokens are shuffled folded, never one by one.
    """
    rows = (
        spread_small(corpus.select("text")).select(tokens(F.col("text")).alias("_tokens"))
        .select(F.size("_tokens").alias("_length"),
                F.explode(F.array_append(F.array_distinct("_tokens"), F.lit(""))).alias("token"))
    )

    def folded(some: DataFrame) -> DataFrame:
        return some.groupBy("token").agg(
            F.count("*").alias("df"), F.sum(F.when(F.col("token") == "", F.col("_length"))).alias("length"))

    if vocabulary is None:
        counted = folded(rows)
    else:
        wanted = materialize(vocabulary.select("token").unionByName(
            corpus.sparkSession.range(1).select(F.lit("").alias("token"))).distinct(), "vocabulary")
        if wanted.count() <= VOCABULARY_ROWS:
            counted = folded(rows.join(F.broadcast(wanted), "token", "left_semi"))
        else:
            counted = folded(rows).join(wanted, "token", "left_semi")
    counted = materialize(counted, "tokens")
    row = counted.where("token = ''").first()
    documents, length = (row["df"], row["length"]) if row else (0, 0)
    return TokenStatistics(documents, length / documents if documents else 0.0,
                           counted.where("token <> ''").select("token", "df"))


def query_weights(queries: DataFrame, stats: TokenStatistics) -> DataFrame:
    """(query_id, token, idf) for the distinct tokens of each query.

    A token no document has gets the idf of frequency zero.
    """
    df = F.coalesce(F.col("df"), F.lit(0))
    idf = F.log(F.lit(1.0) + (F.lit(float(stats.documents)) - df + 0.5) / (df + 0.5))
    return (query_terms(queries).join(stats.frequency, "token", "left")
            .select("query_id", "token", idf.alias("idf")))


class Bm25Scorer:
    """Scores batches of documents against a block of queries."""

    def __init__(self, queries: pa.Table, mean_length: float):
        self.ids = column_ids(queries.column("query_id"))
        self.mean_length = mean_length
        lists: dict[str, tuple[list[int], list[float]]] = {}
        for row, terms in enumerate(queries.column("terms").to_pylist()):
            for term in terms or []:
                users, weights = lists.setdefault(term["token"], ([], []))
                users.append(row)
                weights.append(term["idf"])
        self.number = {token: i for i, token in enumerate(lists)}
        self.counts = np.array([len(u) for u, _ in lists.values()], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.users = np.array([u for us, _ in lists.values() for u in us], np.int64)
        self.weights = np.array([w for _, ws in lists.values() for w in ws])

    def collect(self, ids: np.ndarray, batch, hits: Hits) -> None:
        lists = batch.column("tokens")
        step = max(1, min(256, 2_000_000 // max(1, len(self.ids))))
        for start in range(0, len(lists), step):
            self._collect_some(ids[start:start + step], lists.slice(start, step).to_pylist(), hits)

    def _collect_some(self, ids: np.ndarray, lists: list[list[str]], hits: Hits) -> None:
        rows, terms, parts = [], [], []
        for row, found in enumerate(lists):
            base = K1 * (1 - B + B * len(found) / self.mean_length) if found else 0.0
            for token, tf in Counter(found).items():
                term = self.number.get(token)
                if term is not None:
                    rows.append(row)
                    terms.append(term)
                    parts.append(tf * (K1 + 1) / (tf + base))
        if not rows:
            return
        terms = np.array(terms, np.int64)
        fan = self.counts[terms]
        ends = np.cumsum(fan)
        slot = np.arange(ends[-1]) - np.repeat(ends - fan, fan) + np.repeat(self.starts[terms], fan)
        cell = np.repeat(np.array(rows, np.int64), fan) * len(self.ids) + self.users[slot]
        value = np.repeat(np.array(parts), fan) * self.weights[slot]
        scores = np.bincount(cell, weights=value, minlength=len(lists) * len(self.ids))
        scores = np.round(scores.reshape(len(lists), len(self.ids)), 6)
        n, k = len(lists), hits.k
        floor = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.zeros(len(self.ids))
        docs, queries = np.nonzero((scores >= floor[None, :]) & (scores > 0))
        hits.add(queries, ids[docs], scores[docs, queries])


def lexical_join(queries: DataFrame, corpus: DataFrame, k: int | None = None,
                 max_broadcast_rows: int = 20_000, query_block: int | None = None,
                 doc_block: int | None = None) -> DataFrame:
    """Top-``k`` documents of every query by BM25, scores to 6 places.

    Frequencies, query terms and term counts share one tokenizer, the JVM's: texts
    reach the scorer as token arrays.

    ``queries(query_id, text)``, ``corpus(doc_id, text)`` →
    ``(query_id, doc_id, score, rank)``.
    """
    k = depth(k)
    corpus = corpus.select("doc_id", "text").where("text is not null")
    stats = token_statistics(corpus, query_terms(queries))
    corpus = spread_small(corpus, stats.documents).select("doc_id", tokens(F.col("text")).alias("tokens"))
    terms = query_weights(queries, stats)
    weighted = terms.groupBy("query_id").agg(
        F.collect_list(F.struct("token", "idf")).alias("terms"))

    mean_length = stats.mean_length

    def make(block: pa.Table) -> Bm25Scorer:
        return Bm25Scorer(block, mean_length)

    if small_enough(queries, None, max_broadcast_rows):
        hits = _scan_with_block(weighted, corpus, make, k)
    else:
        # A token takes about 16 bytes on its way; the statistics know the mean length.
        doc_block = doc_block or max(1, int(BLOCK_BYTES / (16 * (stats.mean_length + 1))))
        weighted = materialize(weighted, "weighted")
        hits = _keyed_blocks(weighted, corpus, make, k, [], query_block or rows_per_block(
            weighted, F.size("terms") * 32), doc_block)
    return best_per_query(hits, k)
