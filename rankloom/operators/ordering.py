"""Global and per-group order without a global window.

A window over a whole table, or over a group that holds a third of it, runs in
one task. Both operators here slice each group into ordered buckets, sum the
buckets (partial aggregation), turn the sums into starting offsets, and only
then rank rows inside a bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.text import hash_of
from rankloom.session import hash_buckets, materialize, order_buckets

SMALL_ROWS = 200_000
#: Slices of an ordering grow with the rows of the largest group.
ROWS_PER_BUCKET = 100_000


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """Bucket number that grows with the hash; hashes are uniform, so buckets are even."""
    prefix = F.conv(F.substring(hashed, 1, 7), 16, 10).cast("long")
    return F.floor(prefix * F.lit(buckets) / F.lit(16 ** 7)).cast("int")


def number_rows(df: DataFrame, key: str, by: tuple[str, ...] = (), seed: int | str = 42,
                out: str = "position", buckets: int | None = None) -> DataFrame:
    """0-based position of each row in seeded hash order, within ``by``.

    Null is a group of its own. The order, and so the result, is the same for any
    bucket count.
    """
    buckets = buckets or hash_buckets(df.sparkSession)
    keyed = df.withColumn("_hash", hash_of(seed, F.col(key)))
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_hash"), buckets))
    slot = [*by, "_bucket"]
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(*slot).agg(F.count("*").alias("_rows"))
        .select(*slot, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy(*slot).orderBy("_hash", key)
    return (
        join_null_safe(keyed, starts, slot)
        .withColumn(out, (F.row_number().over(inside) - 1 + F.col("_start")).cast("long"))
        .drop("_hash", "_bucket", "_start")
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[f"`{k}`"].eqNullSafe(renamed[f"`_right_{k}`"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def seeded_shuffle(df: DataFrame, key: str, seed: int | str = 42) -> DataFrame:
    """Rows in seeded random order, by a range-partitioned sort."""
    return df.orderBy(hash_of(seed, F.col(key)), key)


def running_totals(table: DataFrame, order: str, values: list[str], by: tuple[str, ...] = (),
                   descending: bool = True, buckets: int | None = None,
                   small: int = SMALL_ROWS) -> DataFrame:
    """Add ``run_<value>``: the inclusive running sum of each value within ``by``.

    ``table`` is a stored table with one row per (``by``, ``order``): group equal
    scores first, so that a tie group, however large, is one row. Bucket edges
    are quantiles of ``order``, so skewed scores still give even buckets. When the
    largest group is counted as small, a plain window takes its place; both give
    the same rows. Null groups are groups. A null ``order`` comes last when
    descending and first when ascending, NaN counts as larger than any number.
    """
    step = F.desc(order) if descending else F.asc(order)
    largest = _largest_group(table, by) if buckets is None else 0
    if buckets is None and largest <= small:
        within = W.partitionBy(*by).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
        return table.withColumns({f"run_{v}": F.sum(v).over(within) for v in values})
    return _run_sums(_bucketed(table, order, descending, buckets, largest), values, by, [step])


def _bucketed(table: DataFrame, order: str, descending: bool, buckets: int | None, largest: int) -> DataFrame:
    """``table`` with ``_bucket``: ordered slices of ``order``, cut at quantiles."""
    buckets = buckets or max(order_buckets(table.sparkSession), -(-largest // ROWS_PER_BUCKET))
    steps = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(table.approxQuantile(order, steps, 1.0 / (4 * buckets)))) if steps else []
    if edges:
        # NaN goes to a bucket above all others.
        splits = [float("-inf"), *edges, float("inf")]
        table = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket", handleInvalid="keep").transform(
            table.withColumn(order, F.col(order).cast("double")))
    else:
        table = table.withColumn("_bucket", F.when(F.isnan(order), 1.0).otherwise(0.0))
    sign = -1 if descending else 1
    bucket = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.col("_bucket")) * sign
    return table.withColumn("_bucket", bucket.cast("int"))


def next_values(table: DataFrame, order: str, values: list[str], by: tuple[str, ...] = (),
                descending: bool = True, buckets: int | None = None, small: int = SMALL_ROWS) -> DataFrame:
    """Add ``next_<value>``: each value of the following row within ``by``; null in the last.

    ``table`` is a stored table with one row per (``by``, ``order``) and values that
    are not null. Rows look inside their bucket; the last row of a bucket takes the
    first row of the next bucket that has rows, which is all that buckets exchange.
    When the largest group is counted as small, a plain window takes its place.
    """
    step = F.desc(order) if descending else F.asc(order)
    row = F.struct(*values)
    largest = _largest_group(table, by) if buckets is None else 0
    if buckets is None and largest <= small:
        found = table.withColumn("_next", F.lead(row).over(W.partitionBy(*by).orderBy(step)))
    else:
        cut = materialize(_bucketed(table, order, descending, buckets, largest), "bucketed")
        slot = [*by, "_bucket"]
        number = F.row_number().over(W.partitionBy(*slot).orderBy(step))
        firsts = cut.select(*slot, row.alias("_row"), number.alias("_number")).where("_number = 1").withColumn(
            "_over", F.lead("_row").over(W.partitionBy(*by).orderBy("_bucket"))).select(*slot, "_over")
        inside = cut.withColumn("_inside", F.lead(row).over(W.partitionBy(*slot).orderBy(step)))
        found = join_null_safe(inside, firsts, slot).withColumn("_next", F.coalesce("_inside", "_over")).drop(
            "_inside", "_over", "_bucket")
    return found.withColumns({f"next_{v}": F.col(f"_next.{v}") for v in values}).drop("_next")


def _largest_group(table: DataFrame, by: tuple[str, ...]) -> int:
    """Rows of the largest group: what one task of a plain window would hold."""
    if not by:
        return table.count()
    return table.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def running_by_hash(table: DataFrame, key: str, values: list[str], seed: int | str = 42,
                    buckets: int | None = None) -> DataFrame:
    """``running_totals`` over the whole table in seeded hash order of a unique key."""
    buckets = buckets or hash_buckets(table.sparkSession)
    table = table.withColumn("_hash", hash_of(seed, F.col(key)))
    table = table.withColumn("_bucket", hash_bucket(F.col("_hash"), buckets))
    return _run_sums(table, values, (), [F.asc("_hash"), F.asc(key)]).drop("_hash")


def _run_sums(table: DataFrame, values: list[str], by: tuple[str, ...],
              order: list[Column]) -> DataFrame:
    """Running sums over rows already cut into ordered ``_bucket``s."""
    slot = [*by, "_bucket"]
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        table.groupBy(*slot).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
        .select(*slot, *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_start_{v}")
                         for v in values])
    )
    inside = W.partitionBy(*slot).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = join_null_safe(table, starts, slot)
    return joined.select(
        *[c for c in table.columns if c != "_bucket"],
        *[(F.sum(v).over(inside) + F.col(f"_start_{v}")).alias(f"run_{v}") for v in values])
