"""Seeded sampling that does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.text import draw, hash_of


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int | str = 42) -> DataFrame:
    """``n`` rows of every group without replacement.

    Every map task keeps at most ``n`` rows per group before the shuffle, so a
    group that holds most rows is no hot spot.
    """
    by = W.partitionBy(group).orderBy(hash_of(seed, F.col(group), F.col(key)), key)
    return (df.withColumn("pick", F.row_number().over(by).cast("long"))
            .where(F.col("pick") <= n))


def repeated_draws(df: DataFrame, n: int, out: str = "i") -> DataFrame:
    """Each row ``n`` times, numbered from 0."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def draw_with_replacement(df: DataFrame, key: str, n: int, pool_size: Column, label: str,
                          seed: int | str = 42) -> DataFrame:
    """``n`` independent pool positions per row, as ``i`` and ``position``."""
    return repeated_draws(df, n).withColumn(
        "position", F.pmod(draw(seed, label, F.col(key), F.col("i")), pool_size.cast("long")))


def distinct_positions(key: Column, n: int, size: Column, label: str,
                       seed: int | str = 42) -> Column:
    """Uniform sample of ``min(n, size)`` different positions below ``size``.

    Each step draws below a bound that grows by one and takes the bound itself
    when the draw was taken before; so no rejects, whatever the size.
    """
    size = size.cast("long")
    take = F.least(F.lit(n).cast("long"), size)

    def step(taken: Column, i: Column) -> Column:
        bound = size - take + i
        pick = F.pmod(draw(seed, label, key, i), bound + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, pick), bound).otherwise(pick))

    empty = F.array().cast("array<bigint>")
    steps = F.sequence(F.lit(0).cast("long"), take - 1)
    return F.when(take > 0, F.aggregate(steps, empty, step)).otherwise(empty)
