"""Connected components of a stored link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialize


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()


#: Links that one task takes; small tables are not spread over all shuffle partitions.
LINKS_PER_TASK = 50_000


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that a link has.

    ``links(a, b)`` of longs; null ends and loops are ignored. Each round hangs
    the larger neighbours of every id on its smallest one (large star), then the
    smaller neighbours as well (small star); rounds grow with the logarithm of
    the longest chain. Every round is a stored table. Links that are stars already,
    every id hung on one centre that hangs on nothing, need no round: these are
    what a round leaves unchanged.
    """
    def unsettled(table: DataFrame) -> bool:
        ends = table.select(F.col("v").alias("id"), F.lit(1).alias("hung")).unionByName(
            table.select(F.col("m").alias("id"), F.lit(0).alias("hung")))
        seen = slim(ends.groupBy("id").agg(F.sum("hung").alias("hung"), F.min("hung").alias("least")))
        return not seen.where("hung > 1 or (hung = 1 and least = 0)").isEmpty()

    def slim(table: DataFrame) -> DataFrame:
        return table.coalesce(tasks) if tasks < partitions else table

    partitions = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = materialize(_directed(links), "links")
    tasks = 4 + edges.count() // LINKS_PER_TASK  # rounds add no links
    while unsettled(edges):
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
            edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("least"))
        large = slim(_directed(slim(both.join(least, "u").where("w > u").select(
            F.col("w").alias("a"), F.col("least").alias("b")))))
        low = large.groupBy("v").agg(F.min("m").alias("least"))
        hung, low = slim(large.join(low, "v")), slim(low)
        small = _directed(hung.select(F.col("m").alias("a"), F.col("least").alias("b")).unionByName(
            low.select(F.col("v").alias("a"), F.col("least").alias("b"))))
        edges = materialize(slim(small), "links")
    return edges.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(
        edges.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())
