"""How the driver tables stand in for pair sets, catalogues and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.functions.numbers import ratio
from rankloom.operators.encode import EncoderFactory, HashingEncoder, score_pairs_by_models, with_pair_keys
from rankloom.operators.pairs import balanced_pairs
from rankloom.session import materialize
from rankloom.sources.tables import load

STRONG = "hash64"
WEAK = "hash16"
SCORE_DIGITS = 6


def hashing_factory(dim: int) -> EncoderFactory:
    return lambda: HashingEncoder(dim)


ENCODERS: dict[str, EncoderFactory] = {STRONG: hashing_factory(64), WEAK: hashing_factory(16)}


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label; source is the query, distinct-token share the score."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("true_label"))
    words = docs.join(labels, "doc_id").withColumn("_tokens", tokens(F.col("text")))
    share = ratio(F.size(F.array_distinct("_tokens")), F.size("_tokens"))
    return words.select(
        F.col("doc_id").cast("string").alias("pair_id"), F.col("source").alias("query"),
        F.col("text").alias("comment"), "true_label", F.col("n_chars").alias("upvotes"),
        F.round(share, SCORE_DIGITS).alias("score"))


def popularity_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("text").alias("comment"), F.col("n_chars").alias("upvotes"),
        F.col("quality").alias("true_label"), F.col("source").alias("topic"))


def dialogue_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn is a query, the assistant turn after it the answer, the conversation the group.

    An equi-join on (conversation, turn) instead of a window per conversation, so
    a conversation of any length spreads over all tasks.
    """
    turns = load(spark, sf_dir, "conversations")
    turn_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    users = turns.where("role = 'user'").select(
        F.col("conv_id").alias("grp"), F.col("turn"), turn_id.alias("query_id"),
        F.col("text").alias("query"))
    replies = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("grp"), (F.col("turn") - 1).alias("turn"),
        turn_id.alias("answer_id"), F.col("text").alias("answer"))
    return users.join(replies, ["grp", "turn"]).drop("turn")


def generic_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pool_id"), "text")


def dialogue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_pairs(dialogue_catalogue(spark, sf_dir), generic_pool(spark, sf_dir))


def scored_pairs(spark: SparkSession, sf_dir: str, models: tuple[str, ...] = (STRONG,),
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """The dialogue pair set scored by one or more encoders, written once and read back.

    Scored rows carry ids, not texts; the id of a query stands for it as ``query``.
    """
    pairs = materialize(with_pair_keys(dialogue_pairs(spark, sf_dir)), "pairs")
    scored = score_pairs_by_models(
        pairs, {m: ENCODERS[m] for m in models}, SCORE_DIGITS,
        keep=["pair_id", "query_id", "true_label", *keep])
    return materialize(scored, "scored").withColumn("query", F.col("query_id"))
