"""An inverted-list index that grows: vectors are added, dropped and re-listed without
rewriting the lists that a change does not touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.vectors import dot
from rankloom.operators.ivf import mean_vectors, probe_lists, unit_centroids
from rankloom.session import broadcast_if_small, drop_folder, materialize
from rankloom.sources.guards import MissingInput, try_read
from rankloom.sources.stores import Index
from rankloom.sources.versions import State, commit, part_path, read_parts, read_state

#: Kinds of change. ``flat`` and ``base`` hold a whole index, ``add`` and ``replace`` new
#: vectors, ``drop`` ids alone, ``split`` the members of re-listed lists.
HOLD_VECTORS = ("flat", "base", "add", "replace", "split")
HOLD_IDS = ("replace", "drop")
HOLD_CENTRES = ("base", "split")
NO_VECTORS = "doc_id bigint, embedding array<float>"
CENTRES = "list_id bigint, embedding array<double>"


def _kinds(vectors: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "list_id")


def start_index(index: Index | None, path: str) -> None:
    """Make ``index`` the whole content of ``path``. With the loaded index of that path it
    folds all changes into one part, whose predecessors' folders stay until the next time."""
    if index is None:
        raise MissingInput("no index to start from")
    spark = index.vectors.sparkSession
    state = read_state(spark, path)
    part = state.new_part("flat" if index.flat else "base")
    _write_lists(index.vectors, path, part.name)
    if not index.flat:
        index.centroids.select("list_id", "embedding").write.parquet(part_path(path, "centres", part.name))
    commit(spark, path, state, [part], tuple(p.name for p in state.parts))
    for name in state.retired:
        for table in ("vectors", "centres", "ids", "lists"):
            drop_folder(spark, part_path(path, table, name))


def _write_lists(vectors: DataFrame, path: str, part: str) -> None:
    kept = [c for c in vectors.columns if c != "list_id"]
    (vectors.select(*kept, F.col("list_id").cast("bigint").alias("list_id")).hint("rebalance", "list_id")
     .write.partitionBy("list_id").parquet(part_path(path, "vectors", part)))


def _live(spark: SparkSession, path: str, state: State) -> Index | None:
    holders = state.names(*HOLD_VECTORS)
    if not holders:
        return None
    stored = try_read(spark, *[part_path(path, "vectors", n) for n in holders], base=f"{path}/vectors")
    kinds = NO_VECTORS if stored is None else _kinds(stored.drop("part"))
    vectors = read_parts(spark, path, "vectors", holders, f"{kinds}, list_id bigint")
    gone, split = state.names(*HOLD_IDS), state.names("split")
    if gone:
        kind = vectors.schema["doc_id"].dataType.simpleString()
        ids = read_parts(spark, path, "ids", gone, f"doc_id {kind}").groupBy("doc_id").agg(F.max("seq").alias("until"))
        vectors = vectors.join(broadcast_if_small(ids), "doc_id", "left").where(
            F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("until")
    if split:  # no more rows than lists
        lists = read_parts(spark, path, "lists", split, "list_id bigint").select("list_id", F.col("seq").alias("until"))
        vectors = vectors.join(broadcast_if_small(lists), "list_id", "left").where(
            F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("until")
    centres = state.names(*HOLD_CENTRES)
    # The newest centres are whole: a split writes those of the other lists again.
    centroids = read_parts(spark, path, "centres", centres[-1:], CENTRES).drop("seq") if centres else None
    return Index(vectors.drop("seq"), centroids)


def load_growing(spark: SparkSession, path: str) -> Index | None:
    """The index with all committed changes, or none when nothing was started."""
    return _live(spark, path, read_state(spark, path))


def _started(spark: SparkSession, path: str) -> State:
    state = read_state(spark, path)
    if not state.parts:
        raise MissingInput(f"no index at {path}")
    return state


def add_vectors(vectors: DataFrame, path: str, replace: bool = False) -> None:
    """Add ``vectors(doc_id, embedding)`` to the lists of their best centres.

    With ``replace``, earlier vectors of the same ids go; without it ids are new ones.
    Only the added rows are written.
    """
    spark = vectors.sparkSession
    state = _started(spark, path)
    index = _live(spark, path, state)
    vectors = vectors.select("doc_id", "embedding")
    listed = (vectors.withColumn("list_id", F.lit(0)) if index.flat
              else probe_lists(vectors, "doc_id", index.centroids))
    part = state.new_part("replace" if replace else "add")
    listed = materialize(listed, "added")
    if listed.isEmpty():
        return
    _write_lists(listed, path, part.name)
    if replace:
        listed.select("doc_id").distinct().write.parquet(part_path(path, "ids", part.name))
    commit(spark, path, state, [*state.parts, part], state.retired)


def drop_vectors(ids: DataFrame, path: str) -> None:
    """Drop the vectors of ``ids(doc_id)``. Ids are noted; the lists stay as they are."""
    spark = ids.sparkSession
    state = _started(spark, path)
    part = state.new_part("drop")
    ids.select("doc_id").where("doc_id is not null").distinct().write.parquet(part_path(path, "ids", part.name))
    commit(spark, path, state, [*state.parts, part], state.retired)


def split_lists(spark: SparkSession, path: str, most: int, rounds: int = 5) -> int:
    """Divide every list of more than ``most`` live vectors in two and return how many there were.

    The two centres start at the member farthest from the list's centre and the one
    farthest from that, then follow their members' means. All lists are divided in
    the same few jobs, and only their members are written.
    """
    state = _started(spark, path)
    index = _live(spark, path, state)
    if index.flat:
        return 0
    sizes = materialize(index.vectors.groupBy("list_id").agg(F.count("*").alias("n")).where(F.col("n") > most), "large")
    count = sizes.count()
    if count == 0:
        return 0
    large = broadcast_if_small(sizes.select("list_id"))
    members = materialize(index.vectors.join(large, "list_id"), "members")

    def farthest(rows: DataFrame, centre: str, out: str) -> DataFrame:
        return rows.groupBy("list_id").agg(F.min_by(
            F.col("embedding").cast("array<double>"), F.struct(dot(F.col("embedding"), F.col(centre)), "doc_id")).alias(out))

    def with_(rows: DataFrame, lists: DataFrame) -> DataFrame:
        return rows.join(broadcast_if_small(lists, 20_000), "list_id")

    centres = index.centroids.select("list_id", F.col("embedding").alias("centre"))
    ends = materialize(farthest(with_(members, centres), "centre", "left"), "ends")
    ends = materialize(with_(farthest(with_(members, ends), "left", "right"), ends), "ends")
    nearer = F.when(dot(F.col("embedding"), F.col("right")) > dot(F.col("embedding"), F.col("left")), 1).otherwise(0)

    def halves(ends: DataFrame) -> DataFrame:
        """Members with ``half``: twice the list, plus one on the right."""
        return with_(members, ends).withColumn("half", 2 * F.col("list_id") + nearer)

    for _ in range(rounds):
        means = unit_centroids(mean_vectors(halves(ends), "half")).select(
            F.expr("list_id div 2").alias("list_id"), (F.col("list_id") % 2).alias("side"), "embedding")
        moved = means.groupBy("list_id").agg(
            F.max(F.when(F.col("side") == 0, F.col("embedding"))).alias("to_left"),
            F.max(F.when(F.col("side") == 1, F.col("embedding"))).alias("to_right"))
        ends = materialize(ends.join(moved, "list_id").select(
            "list_id", F.coalesce("to_left", "left").alias("left"), F.coalesce("to_right", "right").alias("right")), "ends")

    # One row a list: numbering them takes one task.
    first = index.centroids.agg(F.max("list_id")).first()[0] + 1
    named = materialize(ends.withColumn(
        "first", F.lit(first) + 2 * (F.row_number().over(W.orderBy("list_id")) - 1)), "named")
    part = state.new_part("split")
    kept = [c for c in members.columns if c != "list_id"]
    _write_lists(with_(members, named).select(*kept, (F.col("first") + nearer).alias("list_id")), path, part.name)
    fresh = named.select(F.inline(F.array(
        F.struct(F.col("first").alias("list_id"), F.col("left").alias("embedding")),
        F.struct((F.col("first") + 1).alias("list_id"), F.col("right").alias("embedding")))))
    others = index.centroids.join(large, "list_id", "left_anti").select("list_id", "embedding")
    others.unionByName(fresh).write.parquet(part_path(path, "centres", part.name))
    sizes.select("list_id").write.parquet(part_path(path, "lists", part.name))
    commit(spark, path, state, [*state.parts, part], state.retired)
    return count
