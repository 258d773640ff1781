"""Importance resampling towards a target distribution, by hashed word runs.

A text's features are its runs of 1 to ``WIDTH`` consecutive words; the CRC-32 of
a feature's bytes picks one of ``BUCKETS`` buckets. All rows of the corpus and of
the target are counted, the logarithm of the two smoothed shares is the gain of a
bucket, the mean gain of a text its weight, and weight plus seeded Gumbel noise
its score: drawing the highest scores is sampling without replacement in
proportion to the weights.

CRCs are never taken feature by feature. Within a chunk of texts the distinct
features of equal length are the rows of one byte matrix, all of whose CRCs
advance together, column by column; the buckets are then scattered back to the
places where the features occur.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.frames import by_bytes, id_text
from rankloom.operators.ordering import running_totals
from rankloom.session import materialize

WIDTH = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
CHUNK_BYTES = 4 << 20
#: Features beyond this many bytes are too few for matrices: zlib takes them one by one.
MATRIX_BYTES = 1024
#: Word bytes keep their place, A-Z become a-z, all else becomes a space.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


@functools.cache
def _crc_steps() -> np.ndarray:
    """What each low byte does to a CRC-32 register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


def crc_values(features: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of every feature, by matrices of equal lengths."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    out = np.empty(len(features), np.uint32)
    order = np.argsort(lengths, kind="stable")
    steps = _crc_steps()
    for rows in np.split(order, 1 + np.flatnonzero(np.diff(lengths[order]))) if features else []:
        length = int(lengths[rows[0]])
        if length > MATRIX_BYTES:
            out[rows] = [zlib.crc32(features[i]) for i in rows]
            continue
        matrix = np.frombuffer(b"".join([features[i] for i in rows]), np.uint8).reshape(len(rows), length)
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            crc = steps[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[rows] = ~crc
    return out


def feature_buckets(texts: list[bytes], width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of all texts in order, features per text, words per text."""
    known: dict[bytes, int] = {}
    places: list[int] = []
    n_features, n_words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        words = text.translate(_WORD_BYTES).split()
        n_words[row] = len(words)
        before = len(places)
        places += [known.setdefault(word, len(known)) for word in words]
        for k in range(2, min(width, len(words)) + 1):
            runs = (b" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
            places += [known.setdefault(run, len(known)) for run in runs]
        n_features[row] = len(places) - before
    return (crc_values(list(known)) % buckets).astype(np.int64)[np.array(places, np.int64)], n_features, n_words


def _chunks(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    texts = batch.column("text")
    for low, high in by_bytes(texts, CHUNK_BYTES):
        yield pc.cast(texts.slice(low, high - low), pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features per bucket over all rows of ``texts(text)``; a task
    sends one row per bucket that it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in _chunks(batch):
                counts += np.bincount(feature_buckets(chunk, width, buckets)[0], minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])

    some = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return some.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths. Brings ``buckets`` rows of each side, no
    more whatever the corpus, to the driver."""
    sides = []
    for counts in (source, target):
        full = np.zeros(buckets, np.int64)
        for row in counts.toLocalIterator():
            full[row["bucket"]] = row["n"]
        sides.append(full)
    in_source, in_target = sides
    all_source, all_target = float(in_source.sum()) + buckets, float(in_target.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target)))
                     for s, t in zip(in_source.tolist(), in_target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_features, n_words, weight): the floored mean gain of every row."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(np.empty(0, np.int64),) * 3]
            for chunk in _chunks(batch):
                found, n_features, n_words = feature_buckets(chunk, width, buckets)
                ends = np.concatenate(([0], np.cumsum(gains[found])))
                upto = np.cumsum(n_features)
                total = ends[upto] - ends[upto - n_features]
                parts.append((n_features, n_words, total // np.maximum(n_features, 1)))
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             names=["doc_id", "n_features", "n_words", "weight"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_features bigint, n_words bigint, weight bigint")


def noisy(weighed: DataFrame, seed: int | str = SEED) -> DataFrame:
    """Add ``score``: weight plus Gumbel noise in thousandths, drawn from the id alone."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10)
    share = (drawn.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             width: int = WIDTH, buckets: int = BUCKETS, seed: int | str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    ``rank`` numbers the drawn rows from 1 by falling score, then rising doc_id; it
    is null for the others. ``percent`` of the rows with ``least_words`` words or
    more are drawn, rounded down. A null text has no features and weight 0. A row
    without an id has no score, is not drawn and does not count among the rows to
    draw from. Rows that share an id share their noise; equal rows take
    consecutive ranks. Empty tables, of documents or of targets, are tables
    without features. Other columns are not carried.

    Scores are whole numbers: their counts give the score at which the draw ends,
    and only rows from there on are ordered, score by score.
    """
    gains = gains_of(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets), buckets)
    scored = materialize(noisy(weigh(docs, gains, width), seed), "scores")
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    levels = materialize(scored.where(able).groupBy("score").agg(F.count("*").alias("n")), "levels")
    quota = (levels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    columns = ["doc_id", "n_features", "n_words", "weight", "score"]
    if not quota:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    placed = materialize(running_totals(levels.withColumn("level", F.col("score").cast("double")), "level", ["n"]).select(
        "score", (F.col("run_n") - F.col("n")).alias("above")), "places")
    # The lowest score whose better scores leave a place free.
    last = placed.where(F.col("above") < quota).agg(F.min("score")).first()[0]
    drawn = able & (F.col("score") >= last)
    # Equal rows are one row here, so a repeated row is no hot score.
    folded = scored.where(drawn).groupBy(*columns).agg(F.count("*").alias("copies"))
    before = W.partitionBy("score").orderBy(*columns[:-1]).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("copies").over(before), F.lit(0)) + F.col("above")
    ranked = folded.join(placed.where(F.col("score") >= last), "score").withColumn("start", start).select(
        *columns, F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("copies"))).alias("place"))
    rest = scored.where(~F.coalesce(drawn, F.lit(False)))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= quota, F.col(
        "place")).alias("rank")).unionByName(
        rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
