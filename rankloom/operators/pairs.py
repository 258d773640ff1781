"""Construction of balanced (query, comment, true_label) sets.

A catalogue lists the right answers: ``(query_id, query, grp, answer_id,
answer)``. Negatives come from answers of other groups and from a generic pool.
Candidates are addressed by position; the product of queries and foreign
answers is never formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import fill_template
from rankloom.operators.ordering import number_rows, running_by_hash
from rankloom.operators.sampling import (
    distinct_positions, draw_with_replacement)
from rankloom.session import materialize

PARAPHRASES = 15
HARD_NEGATIVES = 8
GENERIC_NEGATIVES = 17

TEMPLATES = [
    "In short: {base}",
    "{base} That settled it for me.",
    "Others said the same. {base}",
    "My answer would be this. {base}",
    "{base} I checked it twice.",
]

PAIR_COLUMNS = ["pair_id", "query_id", "query", "comment", "true_label", "branch"]


def query_dimension(catalogue: DataFrame) -> DataFrame:
    """(query_id, query, grp, answers): one row per query."""
    return catalogue.groupBy("query_id", "query", "grp").agg(F.count("*").alias("answers"))


def with_group(queries: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach the group of each query."""
    return queries.join(dimension.select("query_id", "grp"), "query_id")


def answer_pool(catalogue: DataFrame, seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """Number the answers so that every group owns one unbroken range.

    Returns ``(position, answer_id, answer)`` and ``(grp, group_start, group_size)``.
    """
    sizes = catalogue.groupBy("grp").agg(F.count("*").alias("group_size"))
    ranges = running_by_hash(sizes, "grp", ["group_size"], seed).select(
        "grp", (F.col("run_group_size") - F.col("group_size")).alias("group_start"), "group_size")
    ranges = materialize(ranges, "ranges")
    inside = number_rows(catalogue.select("grp", "answer_id", "answer"), "answer_id", ("grp",), seed)
    pool = inside.join(ranges, "grp").select(
        (F.col("group_start") + F.col("position")).alias("position"), "answer_id", "answer")
    return pool, ranges


def foreign_candidates(catalogue: DataFrame) -> DataFrame:
    """Per query, how many answers belong to other groups.

    The candidates are all pool positions outside ``[group_start, group_start +
    group_size)``; they are described, not listed.
    """
    _, ranges = answer_pool(catalogue)
    total = catalogue.agg(F.count("*")).scalar()
    return query_dimension(catalogue).join(ranges, "grp").select(
        "query_id", "grp", "group_size", (total - F.col("group_size")).alias("candidates"))


def hard_negatives(catalogue: DataFrame, n: int = HARD_NEGATIVES, seed: int | str = 42) -> DataFrame:
    """``n`` different answers of other groups for every query."""
    pool, ranges = answer_pool(catalogue, seed)
    total = ranges.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    queries = query_dimension(catalogue).join(ranges, "grp")
    outside = F.lit(total) - F.col("group_size")
    picks = queries.select(
        "query_id", "query", "group_start", "group_size",
        F.posexplode(distinct_positions(F.col("query_id"), n, outside, "hard", seed)).alias("i", "_pick"))
    position = F.when(F.col("_pick") < F.col("group_start"), F.col("_pick")).otherwise(
        F.col("_pick") + F.col("group_size"))
    return (picks.withColumn("position", position).join(pool, "position")
            .select("query_id", "query", F.col("i").cast("long").alias("i"), "answer_id",
                    F.col("answer").alias("comment")))


def paraphrases(catalogue: DataFrame, n: int = PARAPHRASES, templates: list[str] = TEMPLATES,
                seed: int | str = 42) -> DataFrame:
    """``n`` templated copies per query of answers drawn with replacement."""
    drawn = draw_with_replacement(
        query_dimension(catalogue), "query_id", n, F.col("answers"), "base", seed)
    numbered = number_rows(
        catalogue.select("query_id", "answer_id", "answer"), "answer_id", ("query_id",), seed)
    bases = drawn.join(numbered, ["query_id", "position"])
    return bases.select(
        "query_id", "query", "i", "answer_id",
        fill_template(cycled_template(F.col("i"), templates), F.col("answer")).alias("comment"))


def cycled_template(i, templates: list[str]):
    """Template number ``i`` modulo their count; the list is a constant of the plan."""
    return F.element_at(F.array(*[F.lit(t) for t in templates]),
                        (F.pmod(i, F.lit(len(templates))) + 1).cast("int"))


def generic_negatives(queries: DataFrame, pool: DataFrame, n: int = GENERIC_NEGATIVES,
                      seed: int | str = 42) -> DataFrame:
    """``n`` texts per query drawn with replacement from ``pool(pool_id, text)``.

    The numbered pool is written first: a short pool is then known to be short
    and goes to the draws, instead of a few positions drawing all rows.
    """
    size = pool.count()
    if size == 0:
        raise ValueError("the generic pool is empty")
    drawn = draw_with_replacement(queries, "query_id", n, F.lit(size), "generic", seed)
    numbered = materialize(number_rows(pool.select("pool_id", "text"), "pool_id", (), seed), "pool")
    return drawn.join(numbered, "position").select(
        "query_id", "query", "i", "pool_id", F.col("text").alias("comment"))


def balanced_pairs(catalogue: DataFrame, pool: DataFrame, n_paraphrases: int = PARAPHRASES,
                   n_hard: int = HARD_NEGATIVES, n_generic: int = GENERIC_NEGATIVES,
                   templates: list[str] = TEMPLATES, seed: int | str = 42) -> DataFrame:
    """Positives, paraphrases, hard and generic negatives of every query, as one bag.

    All branches read the catalogue, so it is written once.
    """
    catalogue = materialize(catalogue, "catalogue")

    def branch(df: DataFrame, name: str, number: str, label: int) -> DataFrame:
        return df.select(
            F.concat_ws("/", "query_id", F.lit(name), F.col(number).cast("string")).alias("pair_id"),
            "query_id", "query", "comment", F.lit(label).alias("true_label"),
            F.lit(name).alias("branch"))

    positives = catalogue.withColumn("comment", F.col("answer"))
    return (
        branch(positives, "positive", "answer_id", 1)
        .unionByName(branch(paraphrases(catalogue, n_paraphrases, templates, seed), "paraphrase", "i", 1))
        .unionByName(branch(hard_negatives(catalogue, n_hard, seed), "hard", "i", 0))
        .unionByName(branch(generic_negatives(
            query_dimension(catalogue), pool, n_generic, seed), "generic", "i", 0))
    )
