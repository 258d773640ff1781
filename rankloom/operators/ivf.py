"""Inverted-list search: vectors grouped by nearest centroid, queries probe few lists."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.vectors import l2_normalize
from rankloom.operators.search import (
    BROADCAST_BYTES, Hits, VectorScorer, best_per_query, column_ids, depth, knn_join, knn_join_in_lists, small_enough)
from rankloom.session import materialize
from rankloom.sources.guards import MissingInput
from rankloom.sources.stores import Index

FLAT, LISTS = "flat", "lists"
#: Room for the rounding of scores and bounds.
SLACK = 1e-6
#: Rows that leave a task at once where one vector makes many.
PROBED_ROWS = 20_000


def list_count(rows: int) -> int:
    """About the root of the rows: lists and their members then grow alike."""
    return max(1, math.isqrt(max(rows, 1) - 1) + 1)


def train_centroids(vectors: DataFrame, lists: int, share: float = 1.0, seed: int = 42) -> DataFrame:
    """(list_id, embedding): unit k-means centres of all vectors, or of the share
    the caller asks for. Unit length keeps a tight cluster from winning vectors
    by the mere size of its mean."""
    fitted = vectors if share >= 1.0 else vectors.sample(fraction=share, seed=seed)
    training = fitted.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10, featuresCol="features").fit(training)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return unit_centroids(vectors.sparkSession.createDataFrame(centers, "list_id bigint, embedding array<double>"))


def mean_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """(list_id, embedding): the mean vector of every ``by`` value, in one pass."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return vectors.groupBy(F.col(by).cast("bigint").alias("list_id")).agg(
        vector_to_array(mean).alias("embedding"))


def probe_lists(vectors: DataFrame, key: str, centroids: DataFrame, probes: int = 1,
                max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each vector once per list among its ``probes`` best by inner product.

    A map over partitions while the counted bytes of the centroids may be sent to
    every worker; beyond that, vectors and centroids meet in blocks.
    """
    centroids = materialize(centroids, "centroids")
    if not small_enough(centroids, "embedding", sys.maxsize, max_bytes):
        best = knn_join(vectors.select(F.col(key).alias("query_id"), "embedding"),
                        centroids.select(F.col("list_id").alias("doc_id"), "embedding"), probes)
        lists = best.select(F.col("query_id").alias(key), F.col("doc_id").cast("bigint").alias("list_id"))
        return vectors.drop("list_id").join(lists, key)
    table = centroids.select(F.col("list_id").cast("bigint").alias("query_id"), "embedding")
    block = vectors.sparkSession.sparkContext.broadcast(table.toArrow())
    kept = [f for f in vectors.schema.fields if f.name != "list_id"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["list_id bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = column_ids(block.value.column("query_id"))
        # A vector leaves once per probe, so many probes mean few vectors at once.
        step = max(1, PROBED_ROWS // min(max(probes, 1), max(len(lists), 1)))
        for batch in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            rows = pa.table({"query_id": pa.array(range(batch.num_rows)),
                             "embedding": batch.column("embedding")})
            hits = Hits(probes)
            VectorScorer(rows).collect(lists, block.value, hits)
            taken = batch.take(pa.array(hits.rows))
            yield pa.RecordBatch.from_arrays(
                [taken.column(f.name) for f in kept] + [pa.array(hits.docs, pa.int64())],
                names=[f.name for f in kept] + ["list_id"])

    return vectors.select(*[f.name for f in kept]).mapInArrow(run, schema)


def build_index(vectors: DataFrame, kind: str = FLAT, lists: int | None = None, share: float = 1.0,
                seed: int = 42) -> Index:
    """An index of ``vectors(doc_id, embedding)``: ``"flat"`` searches exactly,
    ``"lists"`` within inverted lists, ``lists`` of them or about the root of the rows.

    The caller names the kind, so an answer never changes with the size of a
    table. The index is a plan until it is saved; save one that is searched more
    than once.
    """
    if kind == FLAT:
        return Index(vectors.withColumn("list_id", F.lit(0).cast("bigint")), None)
    if kind != LISTS:
        raise ValueError(f"unknown kind of index: {kind}")
    centroids = train_centroids(vectors, lists or list_count(vectors.count()), share, seed)
    return Index(probe_lists(vectors, "doc_id", centroids), centroids)


def search_index(index: Index | None, queries: DataFrame, k: int | None = None, probes: int = 1,
                 exclude_self: bool = False) -> DataFrame:
    """Top-``k`` of every query: exact when flat, within the probed lists otherwise."""
    if index is None:
        raise MissingInput("no index: build or load one first")
    if index.flat:
        return knn_join(queries, index.vectors, depth(k), exclude_self)
    centroids = materialize(index.centroids, "centroids")
    if probes >= centroids.count():
        # All lists are read for every query: each of its vectors once per list would be the
        # product of both, and a block of documents may as well hold more than one list.
        return knn_join(queries, index.vectors.where("list_id is not null"), depth(k), exclude_self)
    probed = materialize(probe_lists(
        queries.select("query_id", "embedding"), "query_id", centroids, probes), "probed")
    return knn_join_in_lists(probed, index.vectors, "list_id", depth(k), exclude_self)


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def list_radii(index: Index) -> DataFrame:
    """Stored (list_id, embedding, radius, members): how far the farthest vector of
    every list lies from its centre. A task sends one row per list and batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            apart = np.linalg.norm(_rows(batch.column("embedding")) - _rows(batch.column("centre")), axis=1)
            lists, at = np.unique(batch.column("list_id").to_numpy(), return_inverse=True)
            farthest = np.zeros(len(lists))
            np.maximum.at(farthest, at, apart)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists), pa.array(farthest), pa.array(np.bincount(at).astype(np.int64))],
                names=["list_id", "radius", "members"])

    centres = index.centroids.select(F.col("list_id").cast("bigint").alias("list_id"), F.col("embedding").alias("centre"))
    parts = index.vectors.select("list_id", "embedding").join(centres, "list_id").mapInArrow(
        run, "list_id bigint, radius double, members bigint")
    radii = parts.groupBy("list_id").agg(F.max("radius").alias("radius"), F.sum("members").alias("members"))
    return materialize(radii.join(centres, "list_id").withColumnRenamed("centre", "embedding"), "radii")


def _within_reach(queries: DataFrame, radii: DataFrame) -> DataFrame:
    """``queries(query_id, embedding, least)`` once per list that may hold a score of ``least`` or more."""
    block = queries.sparkSession.sparkContext.broadcast(radii.select("list_id", "embedding", "radius").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = block.value.column("list_id").to_numpy()
        centres, radius = _rows(block.value.column("embedding")), block.value.column("radius").to_numpy()
        step = max(1, PROBED_ROWS // max(len(lists), 1))
        for batch in (batch.slice(k, step) for batch in batches for k in range(0, batch.num_rows, step)):
            asked = _rows(batch.column("embedding"))
            bounds = asked @ centres.T + np.linalg.norm(asked, axis=1)[:, None] * radius
            least = batch.column("least").to_numpy(zero_copy_only=False)
            rows, cols = np.nonzero(bounds >= least[:, None] - SLACK * (1 + np.abs(bounds)))
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [taken.column("query_id"), taken.column("embedding"), taken.column("least"),
                 pa.array(lists[cols], pa.int64())], names=["query_id", "embedding", "least", "list_id"])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    return queries.select("query_id", "embedding", "least").mapInArrow(
        run, f"query_id {kinds['query_id']}, embedding {kinds['embedding']}, least double, list_id bigint")


def search_bounded(index: Index, queries: DataFrame, k: int | None = None, probes: int = 1,
                   exclude_self: bool = False, radii: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(exact top-``k`` of every query, stored (query_id, lists, members) of what was read for it).

    A list with centre c and radius r holds no score above q·c + |q|·r. The
    ``probes`` best lists give a first k-th score; then all other lists whose bound
    reaches it are read, and no list besides. ``radii`` are those of ``list_radii``,
    worked out here without them. Centres too large to be sent to every worker
    are no help: the search is then the flat one.
    """
    k = depth(k)
    queries = materialize(queries.select("query_id", "embedding"), "queries")
    if index.flat or not small_enough(index.centroids, "embedding", sys.maxsize):
        read = queries.select("query_id", F.lit(1).cast("long").alias("lists"),
                              F.lit(index.vectors.count()).cast("long").alias("members"))
        return knn_join(queries, index.vectors, k, exclude_self), read
    radii = radii if radii is not None else list_radii(index)
    probed = materialize(probe_lists(queries, "query_id", index.centroids, probes), "probed")
    first = materialize(knn_join_in_lists(probed, index.vectors, "list_id", k, exclude_self), "first_hits")
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    least = F.when(F.col("n") == k, F.col("worst")).otherwise(F.lit(float("-inf")))
    asked = queries.join(reached, "query_id", "left").select("query_id", "embedding", least.alias("least"))
    more = _within_reach(asked, radii).join(probed.select("query_id", "list_id"), ["query_id", "list_id"], "left_anti")
    more = materialize(more, "more_lists")
    later = knn_join_in_lists(more, index.vectors, "list_id", k, exclude_self)
    columns = ["query_id", "doc_id", "score"]
    read = probed.select("query_id", "list_id").unionByName(more.select("query_id", "list_id")).join(
        radii.select("list_id", "members"), "list_id").groupBy("query_id").agg(
        F.count("*").alias("lists"), F.sum("members").alias("members"))
    return best_per_query(first.select(columns).unionByName(later.select(columns)), k), materialize(read, "reading")


def recall_at(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, expected, found, recall) of one search against the exact one."""
    keys = ["query_id", "doc_id"]
    hit = exact.select(keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("expected"),
                   F.count("hit").alias("found")).withColumn(
        "recall", F.try_divide(F.col("found").cast("double"), F.col("expected")))


def unit_centroids(centroids: DataFrame) -> DataFrame:
    return centroids.withColumn("embedding", l2_normalize(F.col("embedding")))
