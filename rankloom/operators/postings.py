"""A stored index for BM25: blocks of postings with bounds, searched without the texts.

Documents of like length are dealt into slices of limited size. A block holds the
postings of one token in one slice and the greatest part of a score that any of them
gives. A search reads the bounds first, then the blocks of the most promising slices,
and then of every other slice whose bound still reaches the k-th score, so the result
is that of ``lexical_join``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.functions.text import tokens
from rankloom.operators.lexical import B, K1, TokenStatistics, query_terms, query_weights
from rankloom.operators.search import (
    CELLS, HIT_NAMES, Hits, _id_types, best_per_query, column_ids, depth, id_array, spread_small)
from rankloom.session import broadcast_if_small, materialize
from rankloom.sources.guards import MissingInput, try_read

#: A slice holds about so many documents and tokens at most; a longer document has one of its own.
SLICE_ROWS = 4_096
SLICE_TOKENS = 1 << 20
#: Tokens that one folder of postings stands for; there are ``MOST_BUCKETS`` folders at most.
BUCKET_TOKENS = 1 << 24
MOST_BUCKETS = 1_024
#: Slices of the first round of a search.
FIRST_SLICES = 4
#: Scores are rounded to 6 places, so a bound may lie half a unit below the score it allows.
SLACK = 1e-6


@dataclass
class LexicalIndex:
    """Corpus size, mean length, ``frequency(bucket, token, df)`` and
    ``postings(bucket, token, slice, n, best, gaps, counts, lengths)``."""

    documents: int
    mean_length: float
    buckets: int
    frequency: DataFrame
    postings: DataFrame

    def statistics(self) -> TokenStatistics:
        """Token statistics for weights and reranking, without reading a text."""
        return TokenStatistics(self.documents, self.mean_length, self.frequency.select("token", "df"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")


def _part(counts: np.ndarray, lengths: np.ndarray, mean_length: float) -> np.ndarray:
    """What a token gives per unit of its idf."""
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / mean_length))


def _block_maker(mean_length: float):
    def run(docs: pa.Table) -> pa.Table:
        docs = docs.sort_by("doc_id")
        ids, lengths = docs.column("doc_id").to_numpy(), docs.column("length").to_numpy()
        lists = docs.column("tokens").combine_chunks()
        # Tokens become numbers in their order, so that one sort of whole numbers groups tokens and rows.
        found = lists.flatten().dictionary_encode()
        order = pc.sort_indices(found.dictionary)
        number = np.empty(len(order), np.int64)
        number[order.to_numpy()] = np.arange(len(order))
        cells, counts = np.unique(
            number[found.indices.to_numpy()] * len(ids) + pc.list_parent_indices(lists).to_numpy(), return_counts=True)
        codes, rows = np.divmod(cells, len(ids))
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = pa.array(np.append(starts, len(codes)).astype(np.int32))
        gaps = np.diff(ids[rows], prepend=0)
        gaps[starts] = ids[rows[starts]]
        best = np.maximum.reduceat(_part(counts, lengths[rows], mean_length), starts)
        return pa.table({
            "token": found.dictionary.take(order), "slice": pa.array(np.full(len(starts), docs.column("slice")[0].as_py())),
            "n": pa.array(np.diff(ends.to_numpy()).astype(np.int64)), "best": pa.array(best),
            "gaps": pa.ListArray.from_arrays(ends, pa.array(gaps)),
            "counts": pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
            "lengths": pa.ListArray.from_arrays(ends, pa.array(lengths[rows].astype(np.int32)))})

    return run


BLOCKS = ("token string, slice bigint, n bigint, best double, gaps array<bigint>, counts array<int>, "
          "lengths array<int>")


def write_lexical_index(corpus: DataFrame, path: str, buckets: int | None = None,
                        slice_rows: int = SLICE_ROWS, slice_tokens: int = SLICE_TOKENS) -> LexicalIndex:
    """Index ``corpus(doc_id, text)`` under a new version of ``path`` and load it.

    The texts are cut into tokens once, and their arrays are stored: the lengths say how many
    slices there are, and only then do the arrays move, once, to their slices. Ids are whole
    numbers, one per text; rows without an id or a text take no part. The marker is written
    last, so a failed run leaves the previous version in place.
    """
    spark = corpus.sparkSession
    docs = spread_small(corpus.select("doc_id", "text").where("doc_id is not null and text is not null")).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), tokens(F.col("text")).alias("tokens"))
    docs = docs.withColumn("length", F.size("tokens").cast("bigint")).withColumn(
        "kind", F.floor(F.log2(F.col("length") + 1)).cast("int"))
    docs = materialize(docs, "token-lists")
    # One row per power of two that a length reaches: 32 at most.
    kinds = [(r["kind"], r["n"], r["length"]) for r in docs.groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("length").alias("length")).collect()]
    documents, length = sum(n for _, n, _ in kinds), sum(size for _, _, size in kinds)
    mean_length = length / documents if documents else 0.0
    buckets = buckets or min(MOST_BUCKETS, 1 + length // BUCKET_TOKENS)
    plan, first = [], 0
    for kind, n, _ in sorted(kinds):
        slices = -(-n // max(1, min(slice_rows, slice_tokens >> kind)))
        plan.append((kind, first, slices))
        first += slices
    dealt = docs.where("length > 0").join(
        F.broadcast(spark.createDataFrame(plan, "kind int, first bigint, slices bigint")), "kind").select(
        "doc_id", "length", "tokens", (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("slices"))).alias("slice"))
    blocks = dealt.groupBy("slice").applyInArrow(_block_maker(mean_length), BLOCKS)
    version = uuid.uuid4().hex
    root = f"{path}/{version}"
    # A folder is sorted by token, so that a reader skips the row groups of other tokens.
    (blocks.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
     .sortWithinPartitions("bucket", "token", "slice").write.partitionBy("bucket").parquet(f"{root}/postings"))
    (_table(spark, f"{root}/postings", f"{BLOCKS}, bucket int").groupBy("bucket", "token").agg(F.sum("n").alias("df"))
     .hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
     .write.partitionBy("bucket").parquet(f"{root}/frequency"))
    marker = spark.createDataFrame([(version, documents, mean_length, buckets)],
                                   "version string, documents bigint, mean_length double, buckets int")
    marker.coalesce(1).write.mode("overwrite").parquet(f"{path}/current")
    return load_lexical_index(spark, path)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def load_lexical_index(spark: SparkSession, path: str) -> LexicalIndex | None:
    """The finished index at ``path``, or none."""
    marker = try_read(spark, f"{path}/current")
    row = None if marker is None else marker.first()
    if row is None:
        return None
    root = f"{path}/{row['version']}"
    return LexicalIndex(row["documents"], row["mean_length"], row["buckets"],
                        _table(spark, f"{root}/frequency", "token string, df bigint, bucket int"),
                        _table(spark, f"{root}/postings", f"{BLOCKS}, bucket int"))


def _slice_scorer(k: int, mean_length: float, types: list[pa.DataType]):
    def run(blocks: pa.Table) -> pa.Table:
        gaps = blocks.column("gaps").combine_chunks()
        ends = gaps.offsets.to_numpy()
        flat, base = gaps.flatten().to_numpy(), ends[0]
        ids = np.concatenate([np.cumsum(flat[a:z]) for a, z in zip(ends[:-1] - base, ends[1:] - base)])
        docs, at = np.unique(ids, return_inverse=True)
        parts = _part(*(blocks.column(c).combine_chunks().flatten().to_numpy().astype(np.float64)
                        for c in ("counts", "lengths")), mean_length)
        asked = blocks.column("asked").combine_chunks()
        of_block, asked = pc.list_parent_indices(asked).to_numpy(), asked.flatten()
        names = asked.field("query_id").dictionary_encode()
        asks, idf = names.indices.to_numpy(), asked.field("idf").to_numpy()
        queries, hits = column_ids(names.dictionary), Hits(k)
        step = max(1, CELLS // len(docs))
        for low in range(0, len(queries), step):
            rows = np.flatnonzero((asks >= low) & (asks < low + step))
            width = min(step, len(queries) - low)
            scores = np.zeros((width, len(docs)))
            for row in rows:
                a, z = ends[of_block[row]] - base, ends[of_block[row] + 1] - base
                scores[asks[row] - low, at[a:z]] += idf[row] * parts[a:z]
            scores = np.round(scores, 6)
            n = len(docs)
            floor = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.zeros(width)
            q, d = np.nonzero((scores >= floor[:, None]) & (scores > 0))
            hits.add(q + low, docs[d], scores[q, d])
        found = hits.docs if hits.docs is not None else np.empty(0, np.int64)
        return pa.table([id_array(queries[hits.rows], types[0]), pa.array(found, pa.int64()), pa.array(hits.scores)],
                        names=HIT_NAMES)

    return run


def _score_slices(work: DataFrame, weighted: DataFrame, postings: DataFrame, mean_length: float, k: int,
                  query_blocks: int) -> DataFrame:
    """Best ``k`` of every query within the slices of ``work(query_id, slice)``.

    A block of postings travels once per group of queries that asks for it.
    """
    asked = work.select("query_id", "slice").join(weighted, "query_id").groupBy(
        "slice", "token", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("part")).agg(
        F.collect_list(F.struct("query_id", "idf")).alias("asked"))
    schema, types = _id_types(weighted, postings.select(F.lit(0).cast("bigint").alias("doc_id")))
    return (postings.select("token", "slice", "gaps", "counts", "lengths").join(asked, ["token", "slice"])
            .groupBy("slice", "part").applyInArrow(_slice_scorer(k, mean_length, types), schema))


def search_lexical_index(index: LexicalIndex | None, queries: DataFrame, k: int | None = None,
                         first: int = FIRST_SLICES) -> tuple[DataFrame, DataFrame]:
    """(top-``k`` by BM25 of ``queries(query_id, text)``, stored (query_id, slices, postings, of_postings)).

    The first table has the rows of ``lexical_join``; the second tells how many
    postings of a query's tokens were read and how many there are. No score in a slice
    exceeds the sum of its blocks' bounds: the ``first`` best slices give a k-th score,
    and only slices that reach it are read after them. Folders of other tokens are not read.
    """
    if index is None:
        raise MissingInput("no index: write or load one first")
    k = depth(k)
    queries = queries.select("query_id", "text")
    wanted = materialize(query_terms(queries).select("token").distinct().withColumn("bucket", _bucket(index.buckets)),
                         "wanted")
    folders = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most ``MOST_BUCKETS``
    wanted = broadcast_if_small(wanted)

    def of_tokens(table: DataFrame) -> DataFrame:
        return table.where(F.col("bucket").isin(folders)).join(wanted, ["bucket", "token"], "left_semi")

    frequency = materialize(of_tokens(index.frequency).select("token", "df"), "frequency")
    weighted = materialize(query_weights(
        queries, TokenStatistics(index.documents, index.mean_length, frequency)), "weighted")
    # Three steps read them; the folders hold many other tokens.
    postings = materialize(of_tokens(index.postings).drop("bucket"), "postings")
    bounds = materialize(
        postings.select("token", "slice", "n", "best").join(weighted, "token").groupBy("query_id", "slice").agg(
            F.sum(F.col("idf") * F.col("best")).alias("bound"), F.sum("n").alias("postings")), "bounds")
    query_blocks = max(1, -(-queries.count() * SLICE_ROWS // CELLS))

    def score(work: DataFrame, name: str) -> DataFrame:
        return materialize(_score_slices(work, weighted, postings, index.mean_length, k, query_blocks), name)

    order = W.partitionBy("query_id").orderBy(F.desc("bound"), "slice")
    leading = materialize(bounds.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= first)
                          .drop("_at"), "leading")
    early = best_per_query(score(leading, "early"), k)
    reached = early.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("worst"))
    least = F.when(F.col("found") == k, F.col("worst")).otherwise(F.lit(0.0))
    more = (bounds.join(reached, "query_id", "left").where(F.col("bound") + SLACK >= least)
            .join(leading.select("query_id", "slice"), ["query_id", "slice"], "left_anti"))
    more = materialize(more.select(bounds.columns), "more")
    hits = best_per_query(early.select(HIT_NAMES).unionByName(score(more, "later")), k)
    read = leading.unionByName(more).groupBy("query_id").agg(
        F.count("*").alias("slices"), F.sum("postings").alias("postings")).join(
        bounds.groupBy("query_id").agg(F.sum("postings").alias("of_postings")), "query_id")
    return hits, materialize(read, "reading")
