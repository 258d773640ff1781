"""Exact, repeatable train / validation / test splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.text import hash_of
from rankloom.operators.ordering import hash_bucket, running_totals
from rankloom.session import broadcast_if_small, hash_buckets, materialize
from rankloom.sources.guards import require_columns

TEST_SIZE = 250
VAL_SIZE = 250
SEED = 42
Size = int | float


def class_counts(df: DataFrame, label: str = "true_label") -> DataFrame:
    """(label, rows); a null label is a class of its own."""
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def stratifiable(counts: dict) -> bool:
    """At least two classes, none with a single row."""
    return len(counts) >= 2 and min(counts.values()) >= 2


def _rows_for(size: Size, rows: int, rounding=math.ceil) -> int:
    return size if isinstance(size, int) else int(rounding(size * rows))


def stratified_sizes(rows: int, classes: int, test: Size, val: Size) -> tuple[int, int]:
    """Row counts of test and validation. A fraction of validation is of all rows."""
    n_test = _rows_for(test, rows)
    if isinstance(val, int):
        n_val = val
    else:
        share = val / (1 - (test if isinstance(test, float) else n_test / rows))
        n_val = math.ceil(round(share * (rows - n_test), 9))
    if min(n_test, n_val) < classes or rows - n_test - n_val < classes:
        raise ValueError(f"cannot take {n_test} test and {n_val} validation rows of {rows}")
    return n_test, n_val


def fallback_sizes(rows: int, test: Size, val: Size) -> tuple[int, int]:
    """Row counts without strata; sizes that do not fit shrink to a fifth and a tenth."""
    n_test = max(1, _rows_for(test, rows, round))
    n_val = max(1, _rows_for(val, rows, round))
    if n_test + n_val >= rows:
        n_test, n_val = max(1, rows // 5), max(1, rows // 10)
    if n_test + n_val >= rows:
        n_test, n_val = 1, 1
    return n_test, n_val


def largest_remainders(strata: DataFrame, size: int, out: str) -> DataFrame:
    """Stored ``strata(stratum, n, …)`` with ``out``: ``size`` rows shared among strata in
    proportion to ``n`` by largest remainder, ties by stratum.

    Strata stay a relation: only sums come to the driver. Equal remainders are one
    row while they are ordered.
    """
    total = strata.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    exact = F.lit(size).cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")
    shared = materialize(strata.withColumn("_exact", exact).withColumns({
        out: F.expr(f"_exact div {max(total, 1)}L"),
        "_rest": (F.col("_exact") % F.lit(max(total, 1))).cast("long")}).drop("_exact"), "shares")
    left = size - shared.agg(F.coalesce(F.sum(out), F.lit(0))).first()[0]
    rests = materialize(shared.groupBy("_rest").agg(F.count("*").alias("_alike")), "remainders")
    above = running_totals(rests, "_rest", ["_alike"]).select(
        F.col("_rest").cast("long").alias("_rest"), (F.col("run__alike") - F.col("_alike")).alias("_above"))
    place = F.row_number().over(W.partitionBy("_rest").orderBy("stratum")) + F.col("_above")
    return materialize(shared.join(above, "_rest").withColumn(out, F.col(out) + F.when(place <= left, 1).otherwise(
        0)).drop("_rest", "_above"), "quotas")


def _limits(strata: DataFrame, classes: int, rows: int, least: int, test: Size, val: Size) -> DataFrame:
    """Stored (stratum, ends): rising rank limits of test and validation in every stratum."""
    if classes >= 2 and least >= 2:
        n_test, n_val = stratified_sizes(rows, classes, test, val)
    else:
        n_test, n_val = fallback_sizes(rows, test, val)
    quota = largest_remainders(strata, n_test, "for_test")
    quota = largest_remainders(quota.withColumn("n", F.col("n") - F.col("for_test")), n_val, "for_val")
    return quota.select("stratum", F.array("for_test", F.col("for_test") + F.col("for_val")).alias("ends"))


def _stratum(label: str) -> Column:
    """A mark before every value keeps null apart from any label's text."""
    return F.when(F.col(label).isNull(), F.lit("w")).otherwise(F.concat(F.lit("v"), F.col(label).cast("string")))


def _strata(rows: DataFrame, weight: Column) -> tuple[DataFrame, int, int, int]:
    """Stored (stratum, n), the number of strata, all rows, the least of a stratum. One
    stratum ``all`` where there are fewer than two, or one has a single row."""
    strata = materialize(rows.groupBy("stratum").agg(F.sum(weight).alias("n")), "strata")
    classes, total, least = strata.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(
        F.min("n"), F.lit(0))).first()
    if classes >= 2 and least >= 2:
        return strata, classes, total, least
    one = strata.groupBy(F.lit("all").alias("stratum")).agg(F.sum("n").alias("n"))
    return materialize(one, "strata"), 1, total, least


def quota_parts(df: DataFrame, stratum: Column, key: str, limits: DataFrame, seed: int | str = SEED) -> DataFrame:
    """``df`` with ``_part``: the number of rank limits that a row lies beyond in seeded hash order.

    ``limits(stratum, ends)`` holds rising rank limits per stratum. Rows are counted
    per hash bucket; only the buckets a limit falls into are ranked, to find the
    hash at the limit. The rows themselves are then compared with their stratum's
    hashes: where the strata are counted as few the table is not shuffled, whatever
    the size of a stratum.
    """
    buckets = hash_buckets(df.sparkSession)
    keyed = df.select(stratum.alias("stratum"), hash_of(seed, F.col(key)).alias("_hash"),
                      F.col(key).cast("string").alias("_key"))
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_hash"), buckets))
    before = W.partitionBy("stratum").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    filled = (keyed.groupBy("stratum", "_bucket").agg(F.count("*").alias("_rows"))
              .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))))
    # At most one bucket per stratum and limit.
    hit = materialize(
        filled.join(broadcast_if_small(limits), "stratum").select("*", F.posexplode("ends").alias("_mark", "_limit"))
        .where("_limit > _start and _limit <= _start + _rows").drop("ends", "_rows"), "limit_buckets")
    inside = W.partitionBy("stratum", "_bucket").orderBy("_hash", "_key")
    hot = hit.select("stratum", "_bucket", "_start").distinct()
    ranked = keyed.join(broadcast_if_small(hot), ["stratum", "_bucket"]).withColumn(
        "_limit", F.row_number().over(inside) + F.col("_start"))
    last = ranked.join(hit.select("stratum", "_mark", "_limit"), ["stratum", "_limit"]).select(
        "stratum", "_mark", F.concat("_hash", "_key").alias("_last"))
    lasts = last.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("_mark", "_last"))).alias("_lasts"))
    lasts = broadcast_if_small(materialize(lasts.withColumnRenamed("stratum", "_stratum"), "limit_hashes"))
    row_key = F.concat(hash_of(seed, F.col(key)), F.col(key).cast("string"))
    joined = df.withColumn("_stratum", stratum).join(lasts, "_stratum", "left")
    beyond = [F.coalesce(row_key > F.element_at("_lasts", F.lit(mark)), F.lit(True)).cast("int") for mark in (0, 1)]
    return joined.withColumn("_part", beyond[0] + beyond[1]).drop("_stratum", "_lasts")


def create_splits(df: DataFrame, key: str, test: Size = TEST_SIZE, val: Size = VAL_SIZE,
                  seed: int | str = SEED, label: str = "true_label",
                  out: str = "split") -> DataFrame:
    """Add ``split`` (train, val, test) with exact sizes.

    Stratified by label; without strata when a class is missing or has one row.
    ``key`` is unique. Whole numbers are row counts, fractions are shares.
    """
    require_columns(df, label, key)
    strata, classes, rows, least = _strata(df.select(_stratum(label).alias("stratum")), F.lit(1))
    stratum = _stratum(label) if classes > 1 else F.lit("all")
    parted = quota_parts(df, stratum, key, _limits(strata, classes, rows, least, test, val), seed)
    return parted.withColumn(out, _named(F.col("_part"))).drop("_part")


def _named(part: Column) -> Column:
    return F.element_at(F.array(F.lit("test"), F.lit("val"), F.lit("train")), part + 1)


def create_group_splits(df: DataFrame, group: list[str], test: Size = TEST_SIZE, val: Size = VAL_SIZE,
                        seed: int | str = SEED, label: str = "true_label", out: str = "split") -> DataFrame:
    """Add ``split`` so that rows equal in the columns ``group`` stay together.

    A group counts with its rows, in the stratum of its least label (null last).
    In seeded hash order, a group goes where its first row would go alone: so
    ``test``, and ``test`` and ``val`` together, exceed their quotas by less than the
    one group at the limit, per stratum. Null is a value of its own. Running sizes
    are taken per hash bucket, so no stratum is ordered in one task, and a group,
    however large, is one row while groups are ordered.
    """
    require_columns(df, label, *group)
    value = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("w")) for c in group]
    named = df.withColumn("_group", F.md5(F.concat_ws("\x1f", *value)))
    groups = materialize(named.groupBy("_group").agg(
        F.count("*").alias("_size"), F.min(_stratum(label)).alias("stratum")), "groups")
    strata, classes, rows, least = _strata(groups, F.col("_size"))
    limits = _limits(strata, classes, rows, least, test, val)
    if classes < 2:
        groups = groups.withColumn("stratum", F.lit("all"))
    hashed = groups.withColumn("_hash", hash_of(seed, F.col("_group")))
    hashed = hashed.withColumn("_bucket", hash_bucket(F.col("_hash"), hash_buckets(df.sparkSession)))
    before = W.partitionBy("stratum").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = hashed.groupBy("stratum", "_bucket").agg(F.sum("_size").alias("_rows")).select(
        "stratum", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("stratum", "_bucket").orderBy("_hash", "_group").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    part = F.size(F.filter("ends", lambda end: end <= F.col("_first")))
    placed = hashed.join(starts, ["stratum", "_bucket"]).withColumn("_first", first).join(
        broadcast_if_small(limits), "stratum").select("_group", _named(part).alias(out))
    return named.join(materialize(placed, "group_parts"), "_group").drop("_group")


def split_summary(df: DataFrame, label: str = "true_label") -> DataFrame:
    """Size and positive rate of every split."""
    return df.groupBy("split").agg(
        F.count("*").alias("rows"), F.avg(F.col(label)).alias("positive_rate"))


def leaked_pairs(df: DataFrame) -> DataFrame:
    """(query, comment) pairs that occur in more than one split.

    Such a pair has a row in test or validation, so only pairs whose hash is among
    theirs are grouped, by their texts; the others, nearly all, are neither shuffled
    nor held. The splits of a pair are gathered as bits.
    """
    mark = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("w")) for c in ("query", "comment")]
    keyed = df.withColumn("_pair", F.md5(F.concat_ws("\x1f", *mark)))
    held = materialize(keyed.where("split in ('test', 'val')").select("_pair").distinct(), "held_pairs")
    bit = F.when(F.col("split") == "test", 1).when(F.col("split") == "val", 2).otherwise(4)
    per_text = keyed.join(broadcast_if_small(held), "_pair", "left_semi").groupBy("query", "comment").agg(
        F.count("*").alias("copies"),
        F.bit_count(F.bit_or(bit)).cast("long").alias("splits"))
    return per_text.where("splits > 1")
