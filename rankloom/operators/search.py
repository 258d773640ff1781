"""Top-k search of many queries over a corpus.

The product of queries and documents is never a Spark relation. Blocks of both
sides meet inside a task, are scored as matrices, and leave as at most ``k``
hits per query; a grouped top-k then merges the blocks. Few queries travel to
the documents, whose scan stays where it is; many queries, or queries bound to
inverted lists, meet the documents in keyed blocks of limited size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.vectors import dot
from rankloom.session import broadcast_if_small, materialize

DEFAULT_K = 20
HIT_NAMES = ["query_id", "doc_id", "score"]
CELLS = 2_000_000
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 << 20
#: A block of either side holds about so many bytes, whatever its rows.
BLOCK_BYTES = 32 << 20
#: Fewer rows of either side are not worth a block of their own.
BLOCK_ROWS = 2_000
#: A product of tiles stays in a core's cache; so many candidates are held before limits rise.
QUERY_TILE, DOC_TILE, HELD, EXACT_ROWS = 256, 2_048, 2_000_000, 1 << 14
#: From so many queries on, equal documents are first told apart.
COPIES_FROM = 1_000
MOST_PARTITIONS = 4_096


def depth(k: int | None) -> int:
    """Search depth: none and zero both mean the default."""
    return k or DEFAULT_K


def column_matrix(column) -> np.ndarray:
    """List column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def column_ids(column) -> np.ndarray:
    """Ids as an array, numbers without a Python object each."""
    if pa.types.is_integer(column.type) and column.null_count == 0:
        return column.to_numpy()
    return np.asarray(column.to_pylist())


def id_array(ids: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(ids if ids.dtype.kind in "iu" else ids.tolist(), kind)


@dataclass
class Hits:
    """Best ``k`` documents per query seen so far; queries are row numbers."""

    k: int
    rows: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    docs: np.ndarray | None = None
    scores: np.ndarray = field(default_factory=lambda: np.empty(0))

    def add(self, rows: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        if len(rows) == 0:
            return
        rows = np.concatenate([self.rows, rows])
        scores = np.concatenate([self.scores, scores])
        docs = docs if self.docs is None else np.concatenate([self.docs, docs])
        order = np.lexsort((docs, -scores, rows))
        rows, docs, scores = rows[order], docs[order], scores[order]
        first = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - first < self.k
        self.rows, self.docs, self.scores = rows[keep], docs[keep], scores[keep]

    def floor(self, first_row: int, rows: int) -> np.ndarray:
        """The ``k``-th score of each of ``rows`` queries from ``first_row`` on, minus infinity before there is one."""
        low, high = np.searchsorted(self.rows, [first_row, first_row + rows])
        counts = np.bincount(self.rows[low:high] - first_row, minlength=rows)
        floor, full = np.full(rows, -np.inf), counts == self.k
        floor[full] = self.scores[low + np.cumsum(counts)[full] - 1]
        return floor


def _first_copies(ids: np.ndarray, docs: np.ndarray, most: int) -> np.ndarray:
    """Row numbers without those of equal vectors that ``most`` smaller ids come before."""
    rows = np.ascontiguousarray(docs)
    _, group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    first = np.searchsorted(group[order], group[order], side="left")
    return np.sort(order[np.arange(len(order)) - first < most])


class VectorScorer:
    """Inner products of a block of query vectors with batches of documents.

    Products of tiles, in single precision where the sizes of the vectors allow it,
    only pick candidates: those that reach the k-th best so far less a bound of their
    own rounding. The sums that decide the order run in double precision and in index
    order. A column ``least`` of the queries gives scores below which no hit is asked for.
    """

    def __init__(self, queries: pa.Table, exclude_self: bool = False, first_row: int = 0):
        self.first_row = first_row
        self.ids = column_ids(queries.column("query_id"))
        self.matrix = column_matrix(queries.column("embedding"))
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.matrix, self.matrix))
        self.least = (column_ids(queries.column("least")).astype(np.float64) if "least" in queries.column_names
                      else np.full(len(self.ids), -np.inf))
        self.exclude_self = exclude_self
        self._single: np.ndarray | None = None

    def _exact(self, docs: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for start in range(0, len(rows), EXACT_ROWS):
            at = slice(start, start + EXACT_ROWS)
            products = self.matrix[rows[at]] * docs[cols[at]]
            for j in range(products.shape[1]):
                total[at] += products[:, j]
        return total

    def _rough(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both sides as they are multiplied, and what a product may be wrong by, per query."""
        longest = np.sqrt(np.einsum("ij,ij->i", docs, docs).max())
        largest = longest * self.norms.max()
        if 1e-20 < largest < 1e30 and max(longest, self.norms.max()) < 1e30:
            if self._single is None:
                self._single = self.matrix.astype(np.float32)
            unit, queries, docs = 2.0 ** -24, self._single, docs.astype(np.float32)
        else:
            unit, queries = 2.0 ** -53, self.matrix
        width = docs.shape[1] + 2
        wrong = 4 * width * (unit * self.norms * longest + (1e-37 if unit > 1e-10 else 0))
        return queries, docs, np.where(np.isfinite(wrong), wrong, np.inf)

    def _candidates(self, rough: tuple[np.ndarray, np.ndarray, np.ndarray], start: int, end: int, floor: np.ndarray,
                    k: int, ids: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, document) of all that may be among the best ``k`` of rows ``start`` to ``end``."""
        queries, others, wrong = rough[0][start:end], rough[1], rough[2][start:end]
        limit = np.where(np.isneginf(floor), -np.inf, floor - wrong)
        rows, cols, values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, queries.dtype)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, tiles = 0, range(0, len(others), DOC_TILE)
        for number, at in enumerate(tiles, 1):
            product = queries @ others[at:at + DOC_TILE].T
            width = product.shape[1]
            if number == 1 and width > k and not np.isfinite(limit).all():
                known = np.where(np.isnan(product), -np.inf, product)
                limit = np.fmax(limit, np.partition(known, width - k, axis=1)[:, width - k] - wrong)
            hit = np.flatnonzero(product >= limit.astype(product.dtype)[:, None])
            found = product.ravel()[hit]
            hit, found = hit[found > -np.inf], found[found > -np.inf]
            parts.append((hit // width, hit % width + at, found))
            held += len(hit)
            # The limits rise whenever the documents seen have doubled, or many are held.
            if number & (number - 1) and held <= HELD and number < len(tiles):
                continue
            rows, cols, values = (np.concatenate([old, *new]) for old, new in zip((rows, cols, values), zip(*parts)))
            parts = []
            order = np.lexsort((-values, rows))
            rows, cols, values = rows[order], cols[order], values[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            last = place == k - 1
            limit[rows[last]] = np.fmax(limit[rows[last]], values[last] - wrong[rows[last]])
            keep = values >= limit[rows]
            rows, cols, values = rows[keep], cols[keep], values[keep]
            if len(rows) > HELD:  # almost ties: their exact order is asked for
                order = np.lexsort((ids[cols], -self._exact(docs, rows + start, cols), rows))
                place = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order], side="left")
                order = order[place < k]
                rows, cols, values = rows[order], cols[order], values[order]
            held = len(rows)
        return rows + start, cols

    def found(self, ids: np.ndarray, batch, hits: Hits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, document id, score) of all that may enter ``hits``."""
        docs = column_matrix(batch.column("embedding"))
        rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(ids) and len(self.ids):
            # The query itself may take places among the best, once per copy of its id.
            k = hits.k + (int(np.unique(ids, return_counts=True)[1].max()) if self.exclude_self else 0)
            if len(self.ids) >= COPIES_FROM and docs.shape[1]:
                kept = _first_copies(ids, docs, k)
                ids, docs = ids[kept], docs[kept]
            rough = self._rough(docs)
            floor = np.maximum(self.least, hits.floor(self.first_row, len(self.ids)))
            step = max(QUERY_TILE, QUERY_TILE * DOC_TILE // len(ids))
            for start in range(0, len(self.ids), step):
                end = min(start + step, len(self.ids))
                some = self._candidates(rough, start, end, floor[start:end], k, ids, docs)
                rows.append(some[0])
                cols.append(some[1])
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        if self.exclude_self and len(rows):
            other = self.ids[rows] != ids[cols]
            rows, cols = rows[other], cols[other]
        return rows + self.first_row, ids[cols], self._exact(docs, rows, cols)

    def collect(self, ids: np.ndarray, batch, hits: Hits) -> None:
        hits.add(*self.found(ids, batch, hits))


class ListedScorer:
    """A scorer per inverted list; documents meet the queries that probe their list."""

    def __init__(self, queries: pa.Table, list_col: str, exclude_self: bool = False):
        lists = column_ids(queries.column(list_col))
        queries = queries.take(pa.array(np.argsort(lists, kind="stable")))
        values, starts, sizes = np.unique(np.sort(lists), return_index=True, return_counts=True)
        self.list_col = list_col
        self.ids = column_ids(queries.column("query_id"))
        self.scorers = {
            value: VectorScorer(queries.slice(start, size).combine_chunks(), exclude_self, start)
            for value, start, size in zip(values.tolist(), starts.tolist(), sizes.tolist())}

    def collect(self, ids: np.ndarray, batch, hits: Hits) -> None:
        lists, found = column_ids(batch.column(self.list_col)), []
        for value in np.unique(lists).tolist():
            if value in self.scorers:
                at = np.flatnonzero(lists == value)
                found.append(self.scorers[value].found(ids[at], batch.take(pa.array(at)), hits))
        if found:
            hits.add(*(np.concatenate(column) for column in zip(*found)))


ScorerFactory = Callable[[pa.Table], object]


def _emit(scorer, hits: Hits, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    docs = hits.docs if hits.docs is not None else np.empty(0)
    arrays = [id_array(scorer.ids[hits.rows], types[0]), id_array(docs, types[1]),
              pa.array(hits.scores, pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def best_per_query(hits: DataFrame, k: int, order: Column | None = None) -> DataFrame:
    """Add ``rank`` and keep ranks up to ``k``; ties go to the smaller document id.

    Spark trims every map task to ``k`` rows per query before the shuffle, so a
    query with many candidate blocks is no hot spot.
    """
    by = W.partitionBy("query_id").orderBy(
        order if order is not None else F.desc("score"), F.asc("doc_id"))
    return (hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))


def _id_types(queries: DataFrame, corpus: DataFrame) -> tuple[str, list[pa.DataType]]:
    left = queries.schema["query_id"].dataType.simpleString()
    right = corpus.schema["doc_id"].dataType.simpleString()
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return (f"query_id {left}, doc_id {right}, score double", [kinds[left], kinds[right]])


def _scan_with_block(queries: DataFrame, corpus: DataFrame, make: ScorerFactory,
                     k: int) -> DataFrame:
    """Documents stay put; the size-checked query block goes to every worker."""
    schema, types = _id_types(queries, corpus)
    block = queries.sparkSession.sparkContext.broadcast(queries.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, hits = make(block.value), Hits(k)
        for batch in batches:
            scorer.collect(column_ids(batch.column("doc_id")), batch, hits)
        if len(hits.rows):
            yield _emit(scorer, hits, HIT_NAMES, types)

    return corpus.mapInArrow(run, schema)


def _keyed_blocks(queries: DataFrame, corpus: DataFrame, make: ScorerFactory, k: int,
                  by: list[str], query_block: int, doc_block: int) -> DataFrame:
    """Both sides meet in blocks keyed by ``by`` and two block numbers.

    Block numbers come from counts per ``by`` value, so a list that holds most
    rows is cut into as many blocks as it needs and no task gets more than one
    block of each side.
    """
    schema, types = _id_types(queries, corpus)

    def counted(df: DataFrame, rows: int, out: str) -> DataFrame:
        return df.groupBy(*by).agg(
            F.ceil(F.count("*") / F.lit(rows)).cast("int").alias(out))

    if by:
        plan = materialize(counted(queries, query_block, "_q_blocks").join(
            counted(corpus, doc_block, "_d_blocks"), by), "blocks")
        slots = plan.agg(F.coalesce(F.sum(F.col("_q_blocks").cast("long") * F.col("_d_blocks")), F.lit(0))).first()[0]
        plan = broadcast_if_small(plan, 10_000)
    else:
        q_blocks = max(1, -(-queries.count() // query_block))
        d_blocks = max(1, -(-corpus.count() // doc_block))
        slots = q_blocks * d_blocks

    def attach(df: DataFrame) -> DataFrame:
        if by:
            return df.join(plan, by)
        return (df.withColumn("_q_blocks", F.lit(q_blocks))
                .withColumn("_d_blocks", F.lit(d_blocks)))

    def numbers(blocks: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)

    left = (attach(queries)
            .withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_q_blocks")))
            .withColumn("_db", F.explode(numbers(F.col("_d_blocks"))))
            .drop("_q_blocks", "_d_blocks"))
    right = (attach(corpus)
             .withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.col("_d_blocks")))
             .withColumn("_qb", F.explode(numbers(F.col("_q_blocks"))))
             .drop("_q_blocks", "_d_blocks"))
    slot = [*by, "_qb", "_db"]
    # Work goes with the product of a slot's rows, so few bytes are no reason to join partitions.
    parts = max(1, min(2 * slots, MOST_PARTITIONS))
    left, right = left.repartition(parts, *slot), right.repartition(parts, *slot)

    def run(query_rows: pa.Table, doc_rows: pa.Table) -> pa.Table:
        if query_rows.num_rows == 0 or doc_rows.num_rows == 0:
            empty = [pa.array([], types[0]), pa.array([], types[1]), pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, names=HIT_NAMES)
        scorer, hits = make(query_rows), Hits(k)
        scorer.collect(column_ids(doc_rows.column("doc_id")), doc_rows, hits)
        return pa.Table.from_batches([_emit(scorer, hits, HIT_NAMES, types)])

    return left.groupBy(*slot).cogroup(right.groupBy(*slot)).applyInArrow(run, schema)


def small_enough(df: DataFrame, vector: str | None, max_rows: int = BROADCAST_ROWS,
                 max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a side may be sent to every worker: counted, not guessed."""
    size = F.sum(F.size(vector) * 8) if vector else F.sum(F.octet_length("text") * 4)
    rows, total = df.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def rows_per_block(df: DataFrame, size: Column, target: int = BLOCK_BYTES) -> int:
    """Rows that hold about ``target`` bytes, from the counted rows and bytes."""
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return max(1, target * rows // max(total, 1))


def vector_bytes() -> Column:
    return F.size("embedding") * 8


def block_rows(queries: DataFrame, corpus: DataFrame) -> tuple[int, int]:
    """Rows of a block of either stored side: ``BLOCK_BYTES`` at most, and small enough
    that all cores have several blocks."""
    cells = queries.count() * corpus.count()
    side = max(BLOCK_ROWS, math.isqrt(cells // (8 * queries.sparkSession.sparkContext.defaultParallelism)))
    return min(side, rows_per_block(queries, vector_bytes())), min(side, rows_per_block(corpus, vector_bytes()))


def knn_join(queries: DataFrame, corpus: DataFrame, k: int | None = None,
             exclude_self: bool = False, max_broadcast_rows: int = BROADCAST_ROWS,
             query_block: int | None = None, doc_block: int | None = None) -> DataFrame:
    """Exact top-``k`` documents of every query.

    Few queries travel to the documents. Many meet them in blocks sized by bytes, so
    the documents are copied once per ``BLOCK_BYTES`` of queries; both sides are
    stored first, as they are counted and then read again.

    ``queries(query_id, embedding)``, ``corpus(doc_id, embedding)`` →
    ``(query_id, doc_id, score, rank)``.
    """
    k = depth(k)
    queries = queries.select("query_id", "embedding").where("embedding is not null")
    corpus = corpus.select("doc_id", "embedding").where("embedding is not null")

    def make(block: pa.Table) -> VectorScorer:
        return VectorScorer(block, exclude_self)

    if small_enough(queries, "embedding", max_broadcast_rows):
        hits = _scan_with_block(queries, corpus, make, k)
    else:
        queries, corpus = materialize(queries, "queries"), materialize(corpus, "corpus")
        sizes = block_rows(queries, corpus)
        hits = _keyed_blocks(queries, corpus, make, k, [], query_block or sizes[0], doc_block or sizes[1])
    return best_per_query(hits, k)


def knn_join_in_lists(queries: DataFrame, corpus: DataFrame, list_col: str, k: int | None = None,
                      exclude_self: bool = False, max_broadcast_rows: int = BROADCAST_ROWS,
                      query_block: int | None = None, doc_block: int | None = None) -> DataFrame:
    """Top-``k`` among documents of the lists each query probes.

    Exact within those lists. A query appears once per list it probes. Few queries
    read only the folders of their lists and shuffle no vector; many meet the
    lists in blocks. A column ``least`` of the queries bounds the scores asked for.
    """
    k = depth(k)
    asked = ["query_id", list_col, "embedding", *(["least"] if "least" in queries.columns else [])]
    if small_enough(queries, "embedding", max_broadcast_rows):
        # No more lists than queries, and no more than there are centroids.
        probed = [r[0] for r in queries.select(list_col).distinct().collect()]
        documents = corpus.select("doc_id", list_col, "embedding").where(F.col(list_col).isin(probed))
        listed = queries.select(*asked)
        hits = _scan_with_block(
            listed, documents, lambda block: ListedScorer(block, list_col, exclude_self), k)
        return best_per_query(hits, k)

    def make(block: pa.Table) -> VectorScorer:
        return VectorScorer(block, exclude_self)

    queries = materialize(queries.select(*asked), "queries")
    corpus = materialize(corpus.select("doc_id", list_col, "embedding"), "corpus")
    sizes = block_rows(queries, corpus)
    hits = _keyed_blocks(queries, corpus, make, k, [list_col], query_block or sizes[0], doc_block or sizes[1])
    return best_per_query(hits, k)


def score_against(corpus: DataFrame, query_vector: list[float]) -> DataFrame:
    """Score of one query vector with every document: a projection, no join."""
    return corpus.withColumn("score", dot(F.lit(query_vector), F.col("embedding")))


def top_k(corpus: DataFrame, query_vector: list[float], k: int | None = None) -> DataFrame:
    """Best ``k`` documents of one query, by a bounded heap in every task."""
    return (score_against(corpus, query_vector)
            .orderBy(F.desc("score"), F.asc("doc_id")).limit(depth(k)))


def spread_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Spread a small table over all cores before work that is heavy per row; a
    large one is already split by its files and is left where it is. Counting a
    stored table reads file footers only."""
    if (df.count() if rows is None else rows) > 1_000_000:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def lookup_hits(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add the text of each hit; hits without a document fall away."""
    return hits.join(corpus.select("doc_id", "text"), "doc_id")
