"""Best-fit packing into bins of several permitted lengths.

Lengths, not texts, are shuffled: rows are dealt to shards by a hash, and each
shard is packed longest first. An item goes to the open bin, of any length, that
it leaves the least room in; if it fits none, the permitted length with the least
cost per token that holds it is opened. When a shard is done, every bin shrinks
to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.byte_tokens import encoding
from rankloom.llm.frames import id_text
from rankloom.session import materialize

SIZES = (512, 1024, 2048, 4096, 8192)
SHARD_ITEMS = 1 << 16


def bin_cost(size: int, overhead: int = 64, attention: int = 1 << 15) -> float:
    """Cost of running one sequence: its tokens, a fixed part, and a quadratic one."""
    return size + overhead + size * size / attention


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, start of each item in its bin, length of each bin).

    ``lengths`` descend and none exceeds the largest size.
    """
    sizes = sorted(sizes)
    cheapest, best = {}, None
    for size in reversed(sizes):  # least cost per token among this size and the larger ones
        if best is None or bin_cost(size) / size <= bin_cost(best) / best:
            best = size
        cheapest[size] = best
    room: list[tuple[int, int]] = []  # (free tokens, bin) of open bins, ascending
    bins, starts, used, capacity = [], [], [], []
    for length in lengths:
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            size = cheapest[sizes[bisect_left(sizes, length)]]
            free, b = size, len(used)
            used.append(0)
            capacity.append(size)
        bins.append(b)
        starts.append(used[b])
        used[b] += length
        if free > length:
            insort(room, (free - length, b))
    return bins, starts, [sizes[bisect_left(sizes, n)] for n in used]


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row; a null text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_tokens"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def pack_lengths(lengths: DataFrame, sizes: Sequence[int] = SIZES, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_start, bin_size) of every piece.

    ``lengths(doc_id, n_tokens)``. A document longer than the largest size is cut
    into pieces of that size and a rest; joined they are the document. Rows
    without tokens (null or empty texts, null lengths) are one piece of length 0
    in no bin. Null ids and repeated rows are packed as any other row. An empty
    table gives an empty one. The number of shards follows the counted rows, and a
    shard is packed in parts of at most ``shard_items``, so a hot id cannot fill
    a task's memory.
    """
    largest = max(sizes)
    whole = F.coalesce("n_tokens", F.lit(0)).cast("long")
    table = materialize(lengths.select("doc_id", whole.alias("n_tokens")), "lengths")
    shards = max(1, -(-table.count() // shard_items))
    last = F.greatest(F.ceil(F.col("n_tokens") / largest) - 1, F.lit(0)).cast("int")
    pieces = table.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "doc_id", "piece", (F.col("piece").cast("long") * largest).alias("start"),
        F.least(F.lit(largest), F.col("n_tokens") - F.col("piece").cast("long") * largest).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "n_tokens", "piece"), F.lit(shards)).cast("long").alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made = 0

        def finish() -> pa.RecordBatch:
            nonlocal made
            bins, starts, ends = pack([r[3] for r in held], sizes)
            first, shard = made, held[0][4]
            made += len(ends)
            doc, piece, start, n = (list(c) for c in list(zip(*held, strict=True))[:4])
            rows = [doc, piece, start, n, [(shard << 32) + first + b for b in bins], starts, [ends[b] for b in bins]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SCHEMA, strict=True)],
                                              schema=SCHEMA)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                if held and (held[0][4] != row[4] or len(held) == shard_items):
                    yield finish()
                    made = made if held[0][4] == row[4] else 0
                    held = []
                held.append(row)
        if held:
            yield finish()

    filled = pieces.where("n_tokens > 0").repartition("shard").sortWithinPartitions(
        "shard", F.desc("n_tokens"), "doc_id", "piece").select(*COLUMNS)
    packed = filled.mapInArrow(run, "doc_id bigint, piece int, start bigint, n_tokens bigint, bin_id bigint, "
                                    "bin_start bigint, bin_size bigint")
    none = F.lit(None).cast("long")
    return packed.unionByName(pieces.where("n_tokens = 0").select(
        "doc_id", "piece", "start", "n_tokens", none.alias("bin_id"), none.alias("bin_start"), none.alias("bin_size")))


COLUMNS = ["doc_id", "piece", "start", "n_tokens", "shard"]
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                    ("bin_id", pa.int64()), ("bin_start", pa.int64()), ("bin_size", pa.int64())])


def pack_documents(docs: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    """``pack_lengths`` of the documents' token counts."""
    return pack_lengths(token_lengths(docs), sizes)
