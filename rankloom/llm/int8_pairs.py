"""Near-duplicate embeddings by quantised tile products.

Unit vectors are quantised to int8 with a scale of their own, and the length of
each quantisation error is stored. For a pair, the product of the quantised
vectors differs from the cosine by at most ``|qx| * ey + ex`` (both vectors being
of length one), so a tile product of small integers rules out most pairs with
certainty; only pairs whose bound reaches the threshold are computed again in
double precision from the original values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import components
from rankloom.session import materialize

THRESHOLD = 0.98
#: Rows of a block at 64 dimensions; more dimensions, fewer rows.
BLOCK = 2048
#: Room for rounding of the float products and of double-precision sums.
SLACK = 1e-5


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error) of unit rows: ``rows ~ codes * scale`` with error length."""
    scale = np.maximum(np.abs(rows).max(axis=1), 1e-300) / 127
    codes = np.rint(rows / scale[:, None])
    error = np.linalg.norm(rows - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, error


def _valid(vector: str) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a class, and one row per class of equal (label, vector).

    A vector that a third of all rows share is one class of that weight.
    """
    vec = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 + 0.0 is 0.0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), vec.alias("vec"))
    usable = _valid("vec") & F.col("label").isNotNull()
    marked = rows.select("vec_id", "label", F.when(usable, F.col("vec")).alias("vec"))
    key = F.when(F.col("vec").isNotNull(), F.sha2(F.concat_ws(
        ",", F.col("label").cast("string"), F.transform("vec", lambda x: x.cast("string"))), 256))
    keyed = materialize(marked.withColumn("class", key), "vectors")
    sized = keyed.where("class is not null").groupBy("class").agg(
        F.count("*").alias("weight"), F.count("vec_id").alias("named"), F.min("vec_id").alias("id"),
        F.first("label").alias("label"), F.first("vec").alias("vec"))
    return keyed, sized


def _links_of_tile(unit_a: np.ndarray, unit_b: np.ndarray, within: bool, threshold: float) -> np.ndarray:
    """Boolean matrix of pairs at or above the threshold; exact in double precision."""
    codes_a, scale_a, error_a = quantised(unit_a)
    codes_b, scale_b, error_b = quantised(unit_b)
    # Sums of products of 8-bit integers are exact in float32 up to 1,040 dimensions, in float64 always.
    kind = np.float32 if unit_a.shape[1] <= 1040 else np.float64
    product = codes_a.astype(kind) @ codes_b.astype(kind).T
    length_a = np.linalg.norm(codes_a.astype(float), axis=1) * scale_a
    near = product * scale_a.astype(kind)[:, None] * scale_b.astype(kind)[None, :]
    room = (length_a[:, None] * error_b[None, :] + error_a[:, None]).astype(kind)
    maybe = near + room >= threshold - SLACK
    sure = near - room >= threshold + SLACK
    if within:
        maybe = np.triu(maybe, 1)
        sure &= maybe
    doubtful = maybe & ~sure
    i, j = np.nonzero(doubtful)
    for low in range(0, len(i), 1 << 16):
        part = slice(low, low + (1 << 16))
        sure[i[part], j[part]] = (unit_a[i[part]] * unit_b[j[part]]).sum(axis=1) >= threshold
    return sure


def _forest(found: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of the tile's links, as row positions: breadth first,
    each row looks once at the rows not reached yet."""
    linked = np.zeros((size, size), bool)
    linked[np.ix_(a, b)] = found
    linked |= linked.T
    fresh = linked.any(axis=1)
    out: list[tuple[int, int]] = []
    while fresh.any():
        todo = [int(np.argmax(fresh))]
        fresh[todo[0]] = False
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & fresh)
            fresh[new] = False
            todo += new.tolist()
            out += [(at, int(x)) for x in new]
    return out


def tile_results(sized: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b, n): joining links (n null), and per class how many vectors of other
    classes it links with, summed per tile (b null)."""
    counts = sized.groupBy("label", "dim").agg(
        F.ceil(F.count("*") * F.col("dim") / F.lit(block * 64)).cast("int").alias("blocks"))
    placed = sized.join(counts, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = spread.select(
        "label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).alias("second"), "cid", "weight", "unit")

    def run(table: pa.Table) -> pa.Table:
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        second = table.column("second").to_numpy()
        units = np.stack(table.column("unit").to_numpy())
        ids, weight = table.column("cid").to_numpy(), table.column("weight").to_numpy()
        a, b = (np.arange(len(ids)),) * 2 if within else (np.flatnonzero(~second), np.flatnonzero(second))
        found = _links_of_tile(units[a], units[b], within, threshold)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, a, found @ weight[b])
        np.add.at(n, b, found.T @ weight[a])
        forest = _forest(found, a, b, len(ids))
        hit = np.flatnonzero(n)
        return pa.table({
            "a": pa.array([ids[x] for x, _ in forest] + ids[hit].tolist(), pa.int64()),
            "b": pa.array([ids[x] for _, x in forest] + [None] * len(hit), pa.int64()),
            "n": pa.array([None] * len(forest) + n[hit].tolist(), pa.int64())})

    return tiles.groupBy("label", "dim", "i", "j").applyInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of equal, non-null labels and equal dimension link from the
    threshold on. Null, empty and zero vectors, those with null or non-finite
    components, and those without a label link with nothing: no links, a
    component of their own, kept. Equal vectors of a label are one class and
    link with each other (cosine one). Rows with a null id count as links of
    others, get a null component and are kept; repeated rows are links of each
    other and share their component. An empty table gives an empty one.
    """
    keyed, sized = classes_of(vectors)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    peak = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    # Dividing by the peak first keeps very small and very large vectors from under- or overflowing.
    scaled = sized.withColumn("peak", peak).withColumn("vec", F.transform("vec", lambda x: x / F.col("peak")))
    units = scaled.withColumn("norm", norm).select(
        "class", "weight", "id", "label", F.size("vec").alias("dim"), F.xxhash64("class").alias("cid"),
        F.transform("vec", lambda x: x / F.col("norm")).alias("unit"))
    units = materialize(units, "classes")
    results = materialize(tile_results(units, threshold, block), "tiles")
    more = results.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
    linked = components(results.where("b is not null").select("a", "b")).withColumnRenamed("id", "cid")
    group = F.coalesce("component", "cid")
    joined = units.select("class", "cid", "weight", "id").join(more, "cid", "left").join(linked, "cid", "left").select(
        "class", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), "id",
        group.alias("grp"))
    least = joined.groupBy("grp").agg(F.min("id").alias("component_id"))
    named = joined.join(least, "grp").select("class", "n_links", "component_id")
    component = F.when(F.col("vec_id").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce("component_id", "vec_id"))
    return keyed.drop("vec", "label").join(named, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
