"""Readers and writers of pair sets, popularity comments and driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rankloom.sources.guards import require_columns

PAIR_SCHEMA = T.StructType([
    T.StructField("pair_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("true_label", T.IntegerType()),
])
POPULARITY_SCHEMA = T.StructType([
    T.StructField("comment", T.StringType()),
    T.StructField("upvotes", T.LongType()),
    T.StructField("true_label", T.IntegerType()),
    T.StructField("topic", T.StringType()),
])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             multi_line: bool = True) -> DataFrame:
    """CSV with header and doubled quotes.

    ``multi_line`` lets a quoted text hold line breaks but makes each file one
    task; large pair sets belong in many files, or in Parquet.
    """
    return (spark.read.schema(schema).option("header", True).option("quote", '"')
            .option("escape", '"').option("multiLine", multi_line).csv(path))


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """A pair set. Without ``multi_line`` a CSV file is cut into many tasks, and no text may hold a line break."""
    pairs = read_csv(spark, path, PAIR_SCHEMA, multi_line) if fmt == "csv" else spark.read.format(fmt).load(path)
    return require_columns(pairs, "query", "comment", "true_label")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a pair set, without a row index."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        (writer.option("header", True).option("quote", '"').option("escape", '"')
         .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        writer.format(fmt).save(path)
