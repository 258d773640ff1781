"""Embedding jobs: pluggable encoders run over distinct texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import content_key, token_list
from rankloom.functions.vectors import dot
from rankloom.session import materialize


#: Words a worker's encoder knows the buckets of: about 100 bytes each.
BUCKETS_KEPT = 400_000
#: So many characters of a batch are Python strings at once.
CHARS_AT_ONCE = 1 << 20


class Encoder(Protocol):
    """Turns texts into unit row vectors. Built once per Python worker."""

    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class _Buckets(dict):
    """Bucket of a token, hashed on first sight; forgets all when it grows large."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= BUCKETS_KEPT:
            self.clear()
        number = int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:4], "big")
        bucket = self[token] = number % self.dim
        return bucket


class HashingEncoder:
    """Token counts hashed into ``dim`` buckets, scaled to unit length."""

    def __init__(self, dim: int = 64):
        self.name = f"hash{dim}"
        self.dim = dim
        self._buckets = _Buckets(dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        found = [token_list(text) for text in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        buckets = np.fromiter(map(self._buckets.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        cells = np.repeat(np.arange(len(texts)) * self.dim, sizes) + buckets
        counts = np.bincount(cells, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)


EncoderFactory = Callable[[], Encoder]

_workers_encoders: dict[str, Encoder] = {}


def worker_key(name: str, factory: Callable) -> str:
    """Name of a worker's cached object: another factory of the same name is another object."""
    return f"{name}/{hashlib.md5(cloudpickle.dumps(factory)).hexdigest()}"


def _encoder_for(key: str, factory: EncoderFactory) -> Encoder:
    """One encoder per worker process, built on first use and kept for later tasks."""
    if key not in _workers_encoders:
        _workers_encoders[key] = factory()
    return _workers_encoders[key]


@dataclass(frozen=True)
class Batching:
    """How texts reach an encoder.

    At most ``size`` texts at once. With ``chars``, texts of like length go together and
    a batch, padded to its longest text, holds no more than so many characters; a longer
    text goes alone. ``profile`` names the resources of the stage, such as a GPU a task.
    """

    size: int = 64
    chars: int | None = None
    profile: ResourceProfile | None = None

    def groups(self, lengths: np.ndarray) -> list[np.ndarray]:
        """Row numbers of each batch."""
        if self.chars is None:
            return [np.arange(i, min(i + self.size, len(lengths))) for i in range(0, len(lengths), self.size)]
        order, groups, start = np.argsort(lengths, kind="stable"), [], 0
        for end, row in enumerate(order):  # in this order the newest text is the longest
            if end > start and ((end - start + 1) * lengths[row] > self.chars or end - start == self.size):
                groups.append(order[start:end])
                start = end
        return [*groups, order[start:]] if len(order) else []

    def padding(self, lengths: np.ndarray) -> float:
        """Share of the padded batches that is padding."""
        padded = sum(len(g) * int(lengths[g].max()) for g in self.groups(lengths))
        return 1 - float(lengths.sum()) / padded if padded else 0.0


def encode_columns(df: DataFrame, text: str, encoders: dict[str, tuple[str, EncoderFactory]],
                   batch_size: int = 64, batching: Batching | None = None) -> DataFrame:
    """Replace column ``text`` by one vector column per entry ``{column: (name, factory)}``.

    A map over partitions: no shuffle, and each text travels to Python once.
    """
    batching = batching or Batching(batch_size)
    texts_at_once = Batching(batching.size, batching.chars)  # a profile stays on the driver
    kept = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + [f"`{out}` array<float>" for out in encoders])
    keyed = [(worker_key(name, factory), factory) for name, factory in encoders.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = _encode_batch([_encoder_for(key, factory) for key, factory in keyed], batch.column(text), texts_at_once)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + vectors,
                names=[f.name for f in kept] + list(encoders))

    return df.select(*[f.name for f in kept], text).mapInArrow(run, schema, profile=batching.profile)


def _encode_batch(encoders: list[Encoder], column: pa.Array, batching: Batching) -> list[pa.ListArray]:
    """A vector column per encoder. Texts become Python strings a few groups at a time,
    which all encoders then read; a whole batch of long texts would fill the worker."""
    column = column.fill_null("")
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    matrices: list[np.ndarray | None] = [None] * len(encoders)
    for run in _runs(batching.groups(lengths), lengths):
        texts = [column.take(pa.array(group)).to_pylist() for group in run]
        for i, encoder in enumerate(encoders):
            for group, some in zip(run, texts, strict=True):
                found = encoder.encode(some)
                if matrices[i] is None:
                    matrices[i] = np.empty((len(column), found.shape[1]), np.float32)
                matrices[i][group] = found
    return [pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
            for m in matrices]


def _runs(groups: list[np.ndarray], lengths: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Groups in turn, together as long as they hold ``CHARS_AT_ONCE`` characters or fewer."""
    run, chars = [], 0
    for group in groups:
        size = int(lengths[group].sum())
        if run and chars + size > CHARS_AT_ONCE:
            yield run
            run, chars = [], 0
        run.append(group)
        chars += size
    if run:
        yield run


def encode_column(df: DataFrame, text: str, name: str, factory: EncoderFactory,
                  out: str = "embedding", batch_size: int = 64, batching: Batching | None = None) -> DataFrame:
    """Replace column ``text`` by its vector under one encoder."""
    return encode_columns(df, text, {out: (name, factory)}, batch_size, batching)


def distinct_texts(df: DataFrame, text: str, model: str) -> DataFrame:
    """(text_key, text), each text once. Copies fold together before the shuffle."""
    return (
        df.where(F.col(text).isNotNull())
        .select(content_key(model, F.col(text)).alias("text_key"), F.col(text).alias("text"))
        .distinct()
    )


def encode_texts(texts: DataFrame, name: str, factory: EncoderFactory,
                 text: str = "text", batching: Batching | None = None) -> DataFrame:
    """(text_key, model, embedding) for the distinct texts of a column."""
    once = distinct_texts(texts, text, name)
    vectors = encode_column(once, "text", name, factory, batching=batching)
    return vectors.select("text_key", F.lit(name).alias("model"), "embedding")


def encode_missing(texts: DataFrame, stored: DataFrame, name: str, factory: EncoderFactory,
                   text: str = "text", batching: Batching | None = None) -> DataFrame:
    """Vectors for those texts the store does not hold yet."""
    return encode_fresh(distinct_texts(texts, text, name), stored, name, factory, batching)


def encode_fresh(once: DataFrame, stored: DataFrame, name: str, factory: EncoderFactory,
                 batching: Batching | None = None) -> DataFrame:
    """Vectors for those of ``distinct_texts`` that the store does not hold yet."""
    known = stored.where(F.col("model") == name).select("text_key")
    fresh = once.join(known, "text_key", "left_anti")
    vectors = encode_column(fresh, "text", name, factory, batching=batching)
    return vectors.select("text_key", F.lit(name).alias("model"), "embedding")


def encode_with_store(texts: DataFrame, stored: DataFrame, name: str, factory: EncoderFactory,
                      text: str = "text", batching: Batching | None = None) -> DataFrame:
    """Vectors for all the texts: the stored ones plus freshly encoded ones."""
    wanted = distinct_texts(texts, text, name).select("text_key")
    reused = (stored.where(F.col("model") == name).join(wanted, "text_key", "left_semi")
              .select("text_key", "model", "embedding"))
    return reused.unionByName(encode_missing(texts, stored, name, factory, text, batching))


def align_pairs(pairs: DataFrame, vectors: DataFrame, model: str, left: str = "query",
                right: str = "comment") -> DataFrame:
    """Bring each pair together with the stored vectors of its two texts, as
    ``left_embedding`` and ``right_embedding``."""
    one = vectors.where(F.col("model") == model).select("text_key", "embedding")
    keyed = pairs.withColumns({"_left": content_key(model, F.col(left)),
                               "_right": content_key(model, F.col(right))})
    return _join_both(keyed, one, ["embedding"])


def _join_both(keyed: DataFrame, vectors: DataFrame, columns: list[str]) -> DataFrame:
    """Join ``text_key`` vectors to both sides. Pairs bring keys to the first join;
    each text was encoded once however many pairs use it."""
    for side in ("right", "left"):
        named = vectors.select(F.col("text_key").alias(f"_{side}"),
                               *[F.col(c).alias(f"{side}_{c}") for c in columns])
        keyed = keyed.join(named, f"_{side}")
    return keyed.drop("_left", "_right")


PAIR_KEYS = ["_left", "_right"]


def with_pair_keys(pairs: DataFrame, left: str = "query", right: str = "comment") -> DataFrame:
    """Add the keys of both texts. A pair set that is stored with them is scored
    without hashing its texts again, and joined without reading them."""
    return pairs.withColumns({"_left": F.unhex(F.md5(left)), "_right": F.unhex(F.md5(right))})


def score_pairs_by_models(pairs: DataFrame, encoders: dict[str, EncoderFactory],
                          digits: int | None = None, left: str = "query", right: str = "comment",
                          keep: list[str] | None = None, batching: Batching | None = None) -> DataFrame:
    """Long table (…, model, score) of cosine scores.

    All encoders share one pass over the distinct texts and one pair of joins. The
    vectors are written before they are joined twice: each text is encoded once, and
    the joins see the size of the vectors instead of a guess from the texts.
    ``keep`` names the pair columns to carry; leaving the texts out spares the
    joins most of their weight.
    """
    kept = keep or [c for c in pairs.columns if c not in PAIR_KEYS]
    if not set(PAIR_KEYS) <= set(pairs.columns):
        pairs = with_pair_keys(pairs, left, right)
    both = pairs.select(F.col("_left").alias("text_key"), F.col(left).alias("text")).unionByName(
        pairs.select(F.col("_right").alias("text_key"), F.col(right).alias("text")))
    once = both.where("text is not null").distinct()
    columns = {f"v{i}": (name, make) for i, (name, make) in enumerate(encoders.items())}
    vectors = materialize(encode_columns(once, "text", columns, batching=batching), "vectors")
    aligned = _join_both(pairs.select(*kept, *PAIR_KEYS), vectors, list(columns))
    scored = _score_aligned(aligned, kept, list(columns))

    def score(column: str) -> Column:
        return F.col(column) if digits is None else F.round(column, digits) + F.lit(0.0)

    scores = F.array(*[F.struct(F.lit(name).alias("model"), score(column).alias("score"))
                       for column, (name, _) in columns.items()])
    return scored.select(*kept, F.inline(scores))


def _score_aligned(aligned: DataFrame, kept: list[str], columns: list[str]) -> DataFrame:
    """``kept`` and per column the product of its two vectors: sums of a batch at once, in
    double precision and in index order like ``dot``."""
    fields = [aligned.schema[c] for c in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{c}` double" for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_products(batch.column(f"left_{c}"), batch.column(f"right_{c}")) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *map(pa.array, scores)], names=[*kept, *columns])

    sides = [f"{side}_{c}" for c in columns for side in ("left", "right")]
    return aligned.select(*kept, *sides).mapInArrow(run, schema)


def _products(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    total = np.zeros(len(left))
    if len(left):
        one, other = (side.flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1) for side in (left, right))
        for j in range(one.shape[1]):
            total += one[:, j].astype(np.float64) * other[:, j].astype(np.float64)
    return total


def score_pairs(pairs: DataFrame, model: str, factory: EncoderFactory, left: str = "query",
                right: str = "comment", digits: int | None = None) -> DataFrame:
    """Pairs with their cosine ``score`` under one encoder."""
    return score_pairs_by_models(pairs, {model: factory}, digits, left, right)
