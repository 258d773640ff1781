"""Periodic runs of words, by longest common extensions over a difference cover.

A run is a maximal stretch of words that agrees with itself ``period`` words on,
repeats at least ``TIMES`` times and has at least ``LEAST`` words. For every
period p, pairs of places (i, i + p) on a grid of step 2p are extended in both
directions; a run is so long that the grid meets it, so harmonic sums bound the
number of pairs.

An extension compares a few words until both places reach positions of the
difference cover. Only suffixes at those positions are sorted; between two of
them the common prefix is a minimum over the array of neighbouring prefixes,
read from a sparse table. Documents are worked on many at a time, joined by words
that occur nowhere else, so nothing extends from one into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.frames import by_bytes, fresh_name, let, words_of

LEAST = 6
TIMES = 4
CHUNK_BYTES = 1 << 20
PAIRS = 1 << 19
#: Any two residues have a place in the cover at the same distance from both.
COVER_STEP = 13
COVER = (0, 1, 3, 9)
_SCREEN = 8
_SURE = 3  # words that every period asks for


class CommonExtensions:
    """Longest common prefixes of suffixes of ``words`` (whole numbers, at least 0)."""

    def __init__(self, words: np.ndarray) -> None:
        v = COVER_STEP
        size = len(words) + v  # suffixes that start behind the words are among the sorted
        self.words = np.concatenate((words, -1 - np.arange(2 * v, dtype=words.dtype)))
        classes = [np.arange(r, size, v) for r in COVER]
        self.places = np.concatenate(classes)
        starts = np.cumsum([0, *map(len, classes)])
        self.class_start = np.full(v, -1)
        self.class_start[list(COVER)] = starts[:-1]
        ends = np.repeat(starts[1:], np.diff(starts))
        #: By the distance of two places: a residue of the cover from which the other lies in it too.
        self.meeting = np.array([next(r for r in COVER if (r + d) % v in COVER) for d in range(v)])
        levels = self._sort(ends)
        self._neighbours(levels)

    def _sort(self, ends: np.ndarray) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first 1, 2, 4, ... blocks of ``COVER_STEP`` words."""
        columns = [self.words[self.places + c] for c in range(COVER_STEP)]
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        for column in columns:
            new[1:] |= np.diff(column[order]) != 0
        ranks = np.empty(len(order), np.int64)
        ranks[order] = 1 + np.cumsum(new)
        levels, width = [ranks], 1
        at = np.arange(len(order))
        while levels[-1].max() < len(order):
            after = np.where(at + width < ends, levels[-1][np.minimum(at + width, len(at) - 1)], 0)
            levels.append(1 + np.unique(levels[-1] * (len(order) + 1) + after, return_inverse=True)[1])
            width *= 2
        return levels

    def _neighbours(self, levels: list[np.ndarray]) -> None:
        """Common prefixes of neighbours in order, and their minima over 1, 2, 4, ... of them."""
        self.rank = levels[-1] - 1
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        blocks = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            same = levels[level][a] == levels[level][b]
            step = same * (1 << level)
            a, b, blocks = a + step, b + step, blocks + step
        prefix = blocks * COVER_STEP + self._compare(
            self.places[a], self.places[b], np.full(len(a), COVER_STEP))
        self.minima = [prefix.astype(np.int32)]
        while 2 << len(self.minima) - 1 <= len(prefix):
            half = 1 << len(self.minima) - 1
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, ``most`` at the most."""
        equal = np.zeros(len(i), np.int64)
        alive = np.flatnonzero(most > 0)
        for c in range(COVER_STEP):
            alive = alive[self.words[i[alive] + c] == self.words[j[alive] + c]]
            equal[alive] += 1
            alive = alive[most[alive] > c + 1]
            if not len(alive):
                break
        return equal

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and at j, element by element; i and j differ."""
        gap = (self.meeting[(j - i) % COVER_STEP] - i) % COVER_STEP
        common = self._compare(i, j, gap)
        on = np.flatnonzero(common == gap)
        x, y = (self.rank[self.class_start[(k[on] + gap[on]) % COVER_STEP] + (k[on] + gap[on]) // COVER_STEP]
                for k in (i, j))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            minima = self.minima[k]
            common[on[at]] += np.minimum(minima[low[at]], minima[high[at] - (1 << k)])
        return common


def _grid(size: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the harmonic grid, about ``PAIRS`` pairs at a time."""
    periods = np.arange(1, longest // TIMES + 1)
    counts = np.maximum(-(-(size - periods) // (2 * periods)), 0)
    upto = np.cumsum(counts)
    low = 0
    while low < len(periods):
        done = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        each = np.repeat(periods[low:high], counts[low:high])
        turn = np.arange(len(each)) - np.repeat(upto[low:high] - counts[low:high] - done, counts[low:high])
        yield turn * 2 * each, each
        low = high


def _screened(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid pairs whose first words agree as far as any run asks for, ``_SCREEN`` words at most.

    A run of period p has at least max(LEAST, TIMES * p) words, and its first grid
    place is among its first 2p words.
    """
    padded = np.concatenate((words, -1 - np.arange(_SCREEN, dtype=words.dtype)))
    for place, period in _grid(len(words), longest):
        for c in range(_SCREEN):
            agree = padded[np.minimum(place + c, len(words))] == padded[np.minimum(
                place + period + c, len(words) + 1)]
            if c >= _SURE:
                agree |= np.maximum(LEAST, TIMES * period) - 3 * period + 1 <= c
            place, period = place[agree], period[agree]
        if len(place):
            yield place, period


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period.

    ``words`` are numbers of at least 0; ``longest`` bounds the length of a run.
    """
    found = [np.empty((0, 3), np.int64)]
    ahead = back = None
    for place, period in _screened(words, longest):
        if ahead is None:
            ahead, back = CommonExtensions(words), CommonExtensions(words[::-1])
        after = ahead.between(place, place + period)
        on = after >= np.maximum(LEAST, TIMES * period) - 3 * period + 1
        place, period, after = place[on], period[on], after[on]
        before = back.between(len(words) - place, len(words) - place - period)
        start, end = place - before, place + period + after
        long = end - start >= np.maximum(LEAST, TIMES * period)
        found.append(np.unique(np.stack((start, end, period), axis=1)[long], axis=0))
    runs = np.concatenate(found)
    # Multiples of a run's period have the same extent: the least is its period.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _chunk_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of every text, as rows (start, end, period) in words of the text."""
    known: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    numbers = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in texts]
    found = [np.empty((0, 3), np.int64)] * len(texts)

    def joined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One sequence, each text followed by a word of its own, and where each text starts."""
        parts = [part for row in rows for part in (numbers[row], [len(known) + row])]
        return np.concatenate(parts).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[rows] + 1)[:-1]))

    rows = np.flatnonzero(sizes >= LEAST)
    if not len(rows):
        return found
    words, starts = joined(rows)
    hopeful = np.zeros(len(rows), bool)
    for place, _ in _screened(words, int(sizes[rows].max())):
        hopeful[np.searchsorted(starts, place, "right") - 1] = True
    rows = rows[hopeful]
    if not len(rows):
        return found
    words, starts = joined(rows)
    runs = runs_of(words, int(sizes[rows].max()))
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, :2] -= starts[owner][:, None]
    edges = np.searchsorted(owner, np.arange(len(rows) + 1))
    for k, row in enumerate(rows):
        found[row] = runs[edges[k]:edges[k + 1]]
    return found


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every row.

    ``runs`` holds (start, length, period) in words, by start, then period;
    ``collapsed`` the words that no run contains after its first period, joined by
    one space. Words are what separators (space, tab to carriage return) part, in
    the case they have. A null, empty or blank text has no runs and collapses to
    the empty text. Null ids stay null, repeated rows are judged each, an empty
    table gives an empty one, other columns are not carried. Nothing is shuffled;
    memory follows ``CHUNK_BYTES`` or the longest single text.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, rows, left = batch.column("text"), [], [np.empty((0, 3), np.int64)], []
            for low, high in by_bytes(texts, CHUNK_BYTES):
                # bytes are split at the six separators alone
                words = [t.split() for t in pc.cast(texts.slice(low, high - low), pa.binary()).to_pylist()]
                runs = _chunk_runs(words)
                counts += map(len, runs)
                rows += runs
                left += map(_kept, words, runs)
            start, end, period = np.concatenate(rows).T
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                [pa.array(start), pa.array(end - start), pa.array(period)], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), listed, pa.array(left, pa.binary()).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id bigint, runs {RUNS}, collapsed string")


def plant_tails(docs: DataFrame) -> DataFrame:
    """``docs`` where about a tenth of the texts end in a repeated passage.

    With h the CRC-32 of the decimal id and g = h div 10: if h mod 10 is 0 and the
    text has n > 0 words, word i from a = g mod n on becomes word a + (i - a) mod p,
    p = 1 + (n - a) div (3 + g mod 8), all words joined by one space. Rows without
    an id or words stay as they are.
    """
    mark, words = F.crc32(F.col("doc_id").cast("string")), fresh_name(docs, "words")

    def tail(w: Column) -> Column:
        g, n = F.floor(mark / 10), F.size(w)
        return let(F.struct((g % n).cast("int").alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).cast(
            "int").alias("p")), lambda x: F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(
                F.get(w, x["a"] + (i - x["a"]) % x["p"]))))

    chosen = F.coalesce(mark % 10 == 0, F.lit(False))
    listed = docs.withColumn(words, F.when(chosen, words_of(F.coalesce("text", F.lit("")))))
    text = F.when(F.size(F.col(words)) > 0, F.array_join(let(F.col(words), tail), " ")).otherwise(F.col("text"))
    return listed.withColumn("text", text).drop(words)


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256):
    count, strongest run and digests of ``periodic_runs``.

    The strongest run has the greatest length by period, compared exactly; then
    the least start, then the least period. Without runs its columns are null.
    """
    def better(acc: Column, r: Column) -> Column:
        more = r["length"] * acc["period"] > acc["length"] * r["period"]
        return F.when(acc.isNull() | more, r).otherwise(acc)  # runs come by start, then period

    found = periodic_runs(docs)
    one = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate("runs", F.lit(None).cast(one), better)
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"),
        F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
