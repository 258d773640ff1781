"""Near-duplicate documents by HyperMinHash registers.

A document's five-word shingles are dealt over ``REGISTERS`` buckets (more for a
lower threshold, see ``bands_for``); a bucket
keeps its smallest hash as one byte: four bits count leading zeros, four hold
the mantissa after them. Eight registers make a band, and the band's bytes are
its key. Documents that share a band are candidates; the register agreement,
corrected for chance collisions, gives a Jaccard estimate that drops hopeless
candidates; full shingle sets confirm the rest.

Candidates become families first, sets are compared inside families. Families are
what plausible estimates connect, found from registers alone, slice of bands by
slice of bands: once documents belong to one family, the buckets they fill alone
are dropped before anything is joined to them. Then the sets of a family, each
once and not once per bucket, confirm the links that made it, and where that
leaves a family in parts, tiles compare the parts. No step lists all pairs of a
group: only links that join something leave a task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import components
from rankloom.llm.frames import fresh_name, id_text
from rankloom.session import materialize

WORDS = 5
PERCENT = 85
BANDS, ROWS = 56, 8
REGISTERS = BANDS * ROWS
#: Bands per slice; those left over are the last slice.
SLICES = (8, 16)
#: Buckets of few documents are folded where their documents are the same. Results do not depend on it.
SMALL_BUCKET = 8
#: Registers, or registers and sets, in one block of a tile.
TILE_BYTES = 1 << 20
SET_TILE_BYTES = 2 << 20
FEW_IDS = 1_000_000
_TRIES = 24
_U = np.uint64


def bands_for(percent: int) -> int:
    """Bands of ``ROWS`` registers that all miss a pair at the threshold with a chance of 2e-8 at most.

    The chance takes bands for independent. Those of a text with far fewer shingles
    than registers repeat each other's hashes and are not; a trial in the tests
    finds no such pair missed either.
    """
    return math.ceil(math.log(2e-8) / math.log(1 - (percent / 100) ** ROWS))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; ``known`` caches word hashes."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six separators
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        value = known.get(word)
        if value is None:
            if len(known) > 200_000:
                known.clear()
            value = known[word] = xxhash.xxh3_64_intdigest(word)
        hashes[i] = value
    width = min(WORDS, len(words))
    out = np.full(len(words) - width + 1, _U(width))
    for k in range(width):
        out = _mixed(out * _U(0x9E3779B97F4A7C15) + hashes[k:k + len(out)])
    return np.unique(out)


@functools.cache
def _detours(count: int) -> np.ndarray:
    """For each try and empty bucket, the bucket to borrow from."""
    at = np.arange(_TRIES * count, dtype=np.uint64).reshape(_TRIES, count)
    return (_mixed(at + _U(977)) % _U(count)).astype(np.int64)


def registers(hashes: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """One byte per bucket: leading zeros (at most 15) and four mantissa bits of
    the bucket's least hash; empty buckets borrow from others in a fixed order."""
    spread = _mixed(hashes + _U(0x632BE59BD9B4E019))
    bucket = (spread % _U(count)).astype(np.int64)
    value = _mixed(spread ^ _U(0xD6E8FEB86659FD93)) >> _U(32)
    least = np.full(count, _U(1) << _U(32))
    np.minimum.at(least, bucket, value)
    filled = least < (_U(1) << _U(32))
    empty = np.flatnonzero(~filled)
    source = least.copy()
    for row in _detours(count):
        if not len(empty):
            break
        borrowed = row[empty]
        found = filled[borrowed]
        least[empty[found]] = source[borrowed[found]]
        empty = empty[~found]
    if len(empty):
        have = np.flatnonzero(filled)
        least[empty] = source[have[np.searchsorted(have, empty) % len(have)]]
    bits = np.frexp(least.astype(np.float64))[1]  # values below 2^32, so exact
    zeros = np.minimum(32 - bits, 15)
    width = 32 - zeros  # bits below and with the leading one; the cap lets it be zero
    mantissa = ((least.astype(np.int64) << 4) >> np.maximum(width - 1, 0)) & 15
    return ((zeros << 4) | mantissa).astype(np.uint8)


@functools.cache
def _cell_edges() -> tuple[np.ndarray, np.ndarray]:
    """Value range, as a share of all hashes, that each register byte stands for."""
    zeros, mantissa = np.divmod(np.arange(256), 16)
    top = 2.0 ** -(zeros + 1.0)
    low = top * (1 + mantissa / 16)
    high = top * (1 + (mantissa + 1) / 16)
    capped = zeros == 15
    low[capped], high[capped] = top[capped] * 2 * mantissa[capped] / 16, top[capped] * 2 * (mantissa[capped] + 1) / 16
    return low, high


def cell_chances(n: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """For documents of ``n`` shingles, the chance of every register byte. The
    product of two such rows is the chance that unrelated buckets agree."""
    low, high = _cell_edges()
    load = np.maximum(n / count, 1.0)[:, None]
    return np.exp(-load * low) - np.exp(-load * high)


def estimates(same: np.ndarray, chance: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
              percent: int = PERCENT, count: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate from the share of equal registers, corrected for chance
    collisions, and whether the threshold is within six standard errors of it."""
    jaccard = (same - chance) / (1 - chance)
    need = percent / 100
    trials = np.clip(np.minimum(n_a, n_b) / 2, 1, count)
    error = np.sqrt(need * (1 - need) / trials) / (1 - chance)
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return jaccard, sizes & (jaccard >= need - 6 * error)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on sorted distinct shingle hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def signatures(docs: DataFrame, count: int = REGISTERS) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): size, digest of the full set, band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), known)
                sizes.append(len(hashes))
                if len(hashes):
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    bands.append(registers(hashes, count).view(np.int64))
                else:
                    digests.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles): packed sorted sets of the wanted documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_hashes(text.as_py(), known).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())],
                                             names=["id", "shingles"])

    wanted, ids = id_text(docs), ids.select(F.col("id").alias("doc_id")).distinct()
    wanted = wanted.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id bigint, shingles binary")


def _matrix(column: pa.Array, count: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint8).reshape(len(column), count)


def _needed(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` whose id is among ``ids``, where those are counted as few; else all."""
    ids = ids.select("id").distinct()
    return table.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= FEW_IDS else table


def _with_signs(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        some = _needed(signs, pairs.select(F.col(end).alias("id")))
        pairs = pairs.join(some.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"),
                                       F.col("bands").alias(f"bands_{end}")), end)
    return pairs


def plausible(pairs: DataFrame, signs: DataFrame, percent: int = PERCENT, count: int = REGISTERS) -> DataFrame:
    """(a, b, estimate) of the pairs that may reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            same = (_matrix(batch.column("bands_a"), count) == _matrix(batch.column("bands_b"), count)).mean(axis=1)
            chance = (cell_chances(n_a, count) * cell_chances(n_b, count)).sum(axis=1)
            jaccard, good = estimates(same, chance, n_a, n_b, percent, count)
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(keep), batch.column("b").take(keep), pa.array(jaccard[good])],
                names=["a", "b", "estimate"])

    return _with_signs(pairs, signs).mapInArrow(run, "a bigint, b bigint, estimate double")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = [i for i in range(batch.num_rows) if linked(
                np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64),
                percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    joined = (pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
              .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b"))
    return joined.mapInArrow(run, "a bigint, b bigint")


def tile_links(ids: np.ndarray, comps: np.ndarray, sides: np.ndarray, regs: np.ndarray, sizes: np.ndarray,
               within: bool, percent: int = PERCENT, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Joining links of one tile: for each row the other parts' rows, best estimates
    first; what a link has joined is passed over. ``sets`` confirm a link, where
    they are given."""
    links, label, count = [], np.unique(comps, return_inverse=True)[1], regs.shape[1]
    cells = cell_chances(sizes, count)
    rows = np.arange(len(ids)) if within else np.flatnonzero(sides == 0)
    others = rows if within else np.flatnonzero(sides == 1)
    for turn, i in enumerate(rows):
        mates = others[turn + 1:] if within else others
        mates = mates[(label[mates] != label[i]) & (100 * np.minimum(sizes[mates], sizes[i]) >= percent * np.maximum(
            sizes[mates], sizes[i]))]
        if not len(mates):
            continue
        same = (regs[mates] == regs[i]).mean(axis=1)
        jaccard, good = estimates(same, cells[mates] @ cells[i], sizes[i], sizes[mates], percent, count)
        order = np.argsort(-jaccard[good], kind="stable")
        for j in mates[good][order]:
            if label[i] != label[j] and (sets is None or linked(sets[i], sets[j], percent)):
                label[label == label[j]] = label[i]
                links.append((int(ids[i]), int(ids[j])))
    return links


def _tiles(rows: DataFrame, percent: int, count: int) -> DataFrame:
    """Joining links (a, b) of ``rows(bucket, size, id, comp, n, bands[, shingles])``.

    ``size`` is the number of blocks of a bucket; a tile is two blocks. One tile
    after the other as they lie in a sorted partition.
    """
    block = F.pmod(F.xxhash64("id"), F.col("size")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    rows = rows.withColumns({
        "i": F.least("block", "other"), "j": F.greatest("block", "other"),
        "side": (F.col("block") > F.col("other")).cast("int")}).drop("block", "other", "size")
    with_sets = "shingles" in rows.columns

    def finish(tile: list) -> list[tuple[int, int]]:
        ids, comps, sides, sizes = (np.array([r[k] for r in tile]) for k in (4, 5, 3, 6))
        regs = np.stack([np.frombuffer(r[7], np.uint8) for r in tile])
        sets = [np.frombuffer(r[8], np.uint64) for r in tile] if with_sets else None
        return tile_links(ids, comps, sides, regs, sizes, tile[0][1] == tile[0][2], percent, sets)

    def pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: list = []
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "side", "id", "comp", "n")]
            regs, links = _matrix(batch.column("bands"), count), []
            sets = batch.column("shingles") if with_sets else None
            for k, row in enumerate(zip(*plain, strict=True)):
                if tile and tile[0][:3] != row[:3]:
                    links += finish(tile)
                    tile = []
                tile.append((*row, regs[k].tobytes(), sets[k].as_py() if with_sets else None))
            yield pairs(links)
        if tile:
            yield pairs(finish(tile))

    # A number of its own: tiles are work rather than bytes, so small ones are not put together.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def band_slices(bands: int) -> list[tuple[int, int]]:
    edges = [0, *np.minimum(np.cumsum(SLICES), bands).tolist(), bands]
    return [(low, high) for low, high in zip(edges, edges[1:], strict=False) if low < high]


class LinkTables:
    """Stored tables of links (a, b) and the components that they make, worked out
    from those known and the tables that were added since."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self._fresh: list[DataFrame] = []
        self._joined: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        if not links.isEmpty():
            self.tables.append(links)
            self._fresh.append(links)

    def joined(self) -> DataFrame | None:
        """(id, component) of every id that a link has; None without links."""
        if self._fresh:
            known = [] if self._joined is None else [self._joined.toDF("a", "b")]
            self._joined = materialize(
                components(functools.reduce(DataFrame.unionByName, [*known, *self._fresh])), "joined")
            self._fresh = []
        return self._joined

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``comp``: the component of its id."""
        joined = self.joined()
        if joined is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(joined, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def open_buckets(signs: DataFrame, found: LinkTables, low: int, high: int) -> DataFrame:
    """(bucket, size, leader, id, comp) of the buckets of some bands that ``found`` does not join into one component.

    Sizes and least ids are stored, so that the join back is between two shuffles
    and a hot bucket can be split.
    """
    ids = found.place(signs.select("id", F.slice("bands", low + 1, high - low).alias("bands")))
    keyed = ids.select("id", "comp", F.posexplode("bands")).select(
        "id", "comp", F.xxhash64(F.col("pos") + low, "col").alias("bucket"))
    still = keyed.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("id").alias("leader"), F.min("comp").alias("least"),
        F.max("comp").alias("most")).where("least < most")
    still = materialize(still.select("bucket", "size", "leader"), "sizes")
    return materialize(keyed.join(still, "bucket").select("bucket", "size", "leader", "id", "comp"), "open_buckets")


def family_links(signs: DataFrame, percent: int = PERCENT, count: int = REGISTERS) -> LinkTables:
    """Plausible links that join all documents which plausible pairs connect.

    A slice of bands is taken with what the slices before have joined. In the
    first, every document meets the least one of each of its buckets; then buckets
    that still hold several families are tiled, small ones of the same documents
    once.
    """
    found = LinkTables()
    for turn, (low, high) in enumerate(band_slices(count // ROWS)):
        rows = open_buckets(signs, found, low, high)
        if turn == 0:
            led = rows.where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))
            best = plausible(materialize(led.distinct(), "led"), signs, percent, count).groupBy("a").agg(
                F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
            found.add(materialize(best, "led_links"))
            rows = open_buckets(signs, found, low, high)
        if rows.isEmpty():
            continue
        few = rows.where(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(
            F.array_sort(F.collect_set(F.struct("id", "comp"))).alias("of")).select("of").distinct()
        few = few.select(F.xxhash64("of").alias("bucket"), F.lit(1).alias("size"), F.explode("of").alias("one"))
        many = rows.where(F.col("size") > SMALL_BUCKET)
        blocks = F.ceil(F.col("size") * F.lit(count) / F.lit(TILE_BYTES)).cast("int")
        tiled = few.select("bucket", "size", "one.id", "one.comp").unionByName(
            many.select("bucket", blocks.alias("size"), "id", "comp"))
        tiled = tiled.join(_needed(signs, rows).select("id", "n", "bands"), "id")
        found.add(materialize(_tiles(tiled, percent, count), "tile_links"))
    return found


def exact_links(docs: DataFrame, signs: DataFrame, families: LinkTables, percent: int = PERCENT,
                count: int = REGISTERS) -> LinkTables:
    """Links between full sets that join all which such links connect within a family."""
    found, family = LinkTables(), families.joined()
    if family is None:
        return found
    sets = materialize(full_sets(docs, family.select("id")).dropDuplicates(["id", "shingles"]), "sets")
    pairs = functools.reduce(DataFrame.unionByName, families.tables).distinct()
    found.add(materialize(confirmed(pairs, sets, percent), "first_links"))
    placed = found.place(family.withColumnRenamed("component", "bucket").join(_needed(signs, family), "id"))
    parts = placed.groupBy("bucket").agg(
        F.min("comp").alias("least"), F.max("comp").alias("most"), F.ceil(
            F.sum(8 * F.col("n") + count) / F.lit(SET_TILE_BYTES)).cast("int").alias("size")).where("least < most")
    parts = materialize(parts.select("bucket", "size"), "parted")
    tiled = placed.join(parts, "bucket").join(sets, "id")
    found.add(materialize(_tiles(tiled.select(
        "bucket", "size", "id", "comp", "n", "bands", "shingles"), percent, count), "last_links"))
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Words are runs of non-separators after lower-casing A-Z; a document's set is
    its distinct five-word shingles, or the whole sequence when it is shorter.
    Texts that are null, empty or blank have the empty set, link with nothing
    and are kept. Rows of equal sets are one class, whatever their number;
    repeated rows share their id and so their component. A row with a null id
    cannot be named: its component is null and it is kept. An empty table gives
    an empty one. Other columns are not carried.

    Sets link at a Jaccard similarity of ``percent`` or more. They are compared by
    64-bit shingle hashes. A pair at the threshold is missed by all bands with a
    chance of about 2e-8 (``bands_for`` x ``ROWS``), and by the estimate at six
    standard errors.
    """
    count = bands_for(percent) * ROWS
    signed = materialize(signatures(docs, count), "signatures")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("id"))
    signs = materialize(
        signed.join(classes, (signed.digest == classes.digest) & (signed.doc_id == classes.id)).select(
            "id", F.col("n_shingles").alias("n"), "bands").dropDuplicates(["id", "n", "bands"]), "registers")
    found = exact_links(docs, signs, family_links(signs, percent, count), percent, count)
    named = found.place(classes).select("digest", F.col("comp").alias("of_class"))
    alone = F.col("digest").isNull()
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(alone, F.col("doc_id")).otherwise(
        F.col("of_class"))
    return signed.drop("bands").join(named, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs``, columns unchanged, whose document stands for its group.

    Repeated rows of one kept id stay once per distinct text. Rows with a null
    id all stay.
    """
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select(
        F.col("doc_id").alias(_key(docs))).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(_key(docs), F.col("doc_id").cast("long"))
    stay = named.join(kept, _key(docs), "left_semi").dropDuplicates([_key(docs), "text"]).drop(_key(docs))
    return stay.unionByName(docs.where(F.col("doc_id").isNull()))


def _key(docs: DataFrame) -> str:
    return fresh_name(docs, "near_key")
