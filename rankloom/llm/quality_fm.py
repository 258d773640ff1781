"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text becomes a sparse row: hashed words with damped, length-normalised
counts, shares that describe its structure, and its metadata length. The model
adds to a linear term all pairwise interactions ``<v_i, v_j> x_i x_j``; they are
scored in time linear in the row by half of ``(sum v x)^2 - sum (v x)^2`` per factor.
Training is the distributed learner of Spark ML on a bounded sample of the labelled
rows; scoring is one Arrow pass over the texts with the weights broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.frames import by_bytes
from rankloom.session import materialize

HASHED = 1 << 12
STATS = 14
WIDTH = HASHED + STATS
FACTORS = 6
#: At most so many labelled rows are learnt from, chosen by a hash of their ids.
SAMPLE_ROWS = 12_000
#: Structure is worth more than words at the learner's one step size.
WORD_SCALE, STAT_SCALE = 0.5, 5.0
ROUNDS = 60
CHUNK_BYTES = 2 << 20
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(b"!?", np.uint8)


@dataclass(frozen=True)
class Model:
    """Intercept, linear weights and factors of a factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of rows laid out one after the other; no row is empty."""
        part = value[:, None] * self.factors[index]
        sums = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat(part * part, starts, axis=0)
        margin = self.bias + np.add.reduceat(value * self.linear[index], starts)
        margin += 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def features(text: str, n_chars: int | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of one row: distinct hashed words, then the dense shares."""
    raw = text.encode()
    words = raw.lower().split()
    places = []
    for word in words:
        place = known.get(word)
        if place is None:
            if len(known) > 200_000:
                known.clear()
            place = known[word] = xxhash.xxh3_64_intdigest(word) % HASHED
        places.append(place)
    index, counts = np.unique(np.array(places, np.int64), return_counts=True)
    value = 1 + np.log(counts) if len(index) else np.empty(0)
    if len(value):
        value = value / np.sqrt((value * value).sum())
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = max(len(raw), 1), max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    stats = np.array([
        1.0, np.log1p(len(words)) / 10, min(size / n / 20, 2.0), min(letters[_SYMBOLS].sum() / n, 2.0),
        min(letters[_MARKS].sum() / n, 2.0), letters[65:91].sum() / size, letters[48:58].sum() / size,
        letters[128:].sum() / size, len(index) / n, counts.max() / n if len(index) else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, min(np.log1p(n / max(len(lines), 1)) / 5, 2.0),
        np.log1p(max(n_chars, 0)) / 12 if n_chars is not None else 0.0, float(n_chars is None)])
    return np.concatenate((index, np.arange(HASHED, WIDTH))), np.concatenate((value * WORD_SCALE, stats * STAT_SCALE))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's text leaves 1 by 3. A
    null id is not held out, but has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       n_chars.alias("n_chars"))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(label, indices, values) of at most ``bound`` labelled ids outside the held-out part.

    The chosen ids are bounded, so they are broadcast and no text moves.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    joined = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("label", "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = [features(t.as_py(), n.as_py(), known) for t, n in zip(
                batch.column("text"), batch.column("n_chars"), strict=True)]
            rows = [(i[x != 0], x[x != 0]) for i, x in rows]  # the learner takes no explicit zeros
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["label", "indices", "values"])

    return joined.mapInArrow(run, "label int, indices array<int>, values array<double>")


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """Learn ``quality``. Without labelled rows every score is 0.5; with one class
    only, every score is that class's smoothed share."""
    rows = materialize(training_rows(docs, labels, bound), "training")
    good, total = rows.agg(F.sum("label"), F.count("*")).first()
    good = good or 0
    if good in (0, total):
        share = (good + 0.5) / (total + 1)
        return Model(float(np.log(share / (1 - share))), np.zeros(WIDTH), np.zeros((WIDTH, 1)))
    vector = F.udf(lambda i, v: Vectors.sparse(WIDTH, i, v), VectorUDT())
    table = rows.select(F.col("label").cast("double").alias("label"), vector("indices", "values").alias("features"))
    learner = FMClassifier(factorSize=FACTORS, regParam=1e-5, stepSize=0.1, maxIter=rounds, initStd=0.05, seed=7)
    found = learner.fit(table)
    return Model(float(found.intercept), found.linear.toArray(), found.factors.toArray())


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text counts as empty and is scored by its structure. A null doc_id
    stays null. Repeated rows are scored each, an empty table gives an empty
    one. Only ``text`` and ``n_chars`` (missing or null: flagged as such) are
    read; other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            texts, scores = batch.column("text"), []
            for low, high in by_bytes(texts, CHUNK_BYTES):
                rows = [features(t.as_py(), n.as_py(), known) for t, n in zip(
                    texts.slice(low, high - low), batch.column("n_chars").slice(low, high - low), strict=True)]
                sizes = np.array([len(r[0]) for r in rows])
                scores.append(shared.value.scores(np.concatenate([r[0] for r in rows]), np.concatenate(
                    [r[1] for r in rows]), np.cumsum(sizes) - sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=["doc_id", "score"])

    scored = _inputs(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learn_and_score(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> DataFrame:
    return quality_scores(docs, fit(docs, labels, bound, rounds))
