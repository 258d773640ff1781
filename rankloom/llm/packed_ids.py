"""Packed token-id matrices.

Documents are dealt by a hash to shards of about ``SHARD_BYTES`` of text, so a text
moves once; a task encodes a shard, cuts overlong documents into pieces without
loss, and packs the pieces longest first into rows of ``row_tokens`` ids. The row
with the least sufficient room is found in a segment tree over free capacities.
A packed row holds its ids, the cumulative lengths of its segments, and the
places where positions restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.byte_tokens import encoding
from rankloom.llm.frames import id_text

ROW_TOKENS = 2048
SHARD_BYTES = 16 << 20
PAD = 50256
SCHEMA = ("shard bigint, row bigint, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, "
          "doc_ids array<bigint>, doc_starts array<bigint>")
ARROW = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                   ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())),
                   ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])


class CapacityTree:
    """Segment tree over free capacities 0..limit: how many open rows have each."""

    def __init__(self, limit: int) -> None:
        self.leaves = 1 << limit.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        at = free + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and give (free, row) with the least capacity from ``need`` on."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to the first filled subtree on the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._change(free, -1)
        return free, self.rows[free].pop()


def pack_rows(lengths: list[int], row_tokens: int) -> list[list[int]]:
    """Items of each row, by best fit; ``lengths`` descend and fit a row."""
    tree, rows = CapacityTree(row_tokens), []
    for item, length in enumerate(lengths):
        found = tree.take(length)
        if found is None:
            found = row_tokens, len(rows)
            rows.append([])
        free, row = found
        rows[row].append(item)
        if free > length:
            tree.add(free - length, row)
    return rows


def _matrix(shard: int, first: int, held: list[tuple[int | None, np.ndarray]], row_tokens: int) -> pa.RecordBatch:
    pieces = [(doc, low, ids[low:low + row_tokens]) for doc, ids in held for low in range(0, len(ids), row_tokens)]
    order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k][2]))
    rows = pack_rows([len(pieces[k][2]) for k in order], row_tokens)
    out: list[list] = [[] for _ in ARROW]
    for number, items in enumerate(rows):
        segments = [pieces[order[k]] for k in items]
        ends = np.cumsum([0, *[len(s[2]) for s in segments]])
        line = np.full(row_tokens, PAD, "<i4")
        line[:ends[-1]] = np.concatenate([s[2] for s in segments])
        values = (shard, first + number, int(ends[-1]), line.tobytes(), ends.tolist(), ends[:-1].tolist(),
                  [s[0] for s in segments], [s[1] for s in segments])
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ARROW, strict=True)], schema=ARROW)


def packed_matrix(docs: DataFrame, row_tokens: int = ROW_TOKENS, shard_bytes: int = SHARD_BYTES,
                  path: str | None = None) -> DataFrame:
    """Packed rows: (shard, row, n_tokens, ids, cu_seqlens, resets, doc_ids, doc_starts).

    ``ids`` are ``row_tokens`` little-endian 32-bit numbers, padded behind
    ``n_tokens``. Segment k of a row spans ``cu_seqlens[k]`` to ``[k + 1]``, holds the
    tokens of ``doc_ids[k]`` from ``doc_starts[k]`` on, and its positions restart
    at zero at ``resets[k]``. Null and empty texts have no tokens and are in no
    row. Null ids are kept as null; repeated rows are packed each; an empty table
    gives an empty one; other columns are not carried. A shard is flushed
    whenever it holds ``shard_bytes`` twice, so repeated rows of one id cannot fill
    a task's memory.
    """
    texts = id_text(docs).where("text != ''")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("long"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        held: list[tuple[int | None, np.ndarray]] = []
        now, size, made = None, 0, 0
        for batch in batches:
            for shard, doc, text in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(),
                                        batch.column("text"), strict=True):
                if held and (shard != now or size > 2 * shard_bytes):
                    rows = _matrix(now, made, held, row_tokens)
                    yield rows
                    held, size, made = [], 0, made + rows.num_rows
                if shard != now:
                    now, made = shard, 0
                plain = text.as_py()
                held.append((doc, np.array(encoder.encode_ordinary(plain), np.int32)))
                size += len(plain)
        if held:
            yield _matrix(now, made, held, row_tokens)

    return dealt.mapInArrow(run, SCHEMA)


def write_matrix(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet, one matrix part per task."""
    packed_matrix(docs, **options).write.parquet(path)


def matrix_digests(packed: DataFrame) -> DataFrame:
    """The packed rows with ids as a digest and lists as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")
    return packed.select("shard", "row", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                         *[joined(c).alias(c) for c in ("cu_seqlens", "resets", "doc_ids", "doc_starts")])
