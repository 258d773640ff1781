"""Checks made while a plan is built; none of them starts a job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class MissingInput(ValueError):
    """An input lacks what the operator needs."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingInput(f"missing column(s): {', '.join(missing)}")
    return df


def try_read(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame | None:
    """The Parquet table at ``paths``, or none when there is no such table. Below ``base``
    folder names are columns."""
    reader = spark.read if base is None else spark.read.option("basePath", base)
    try:
        return reader.parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def require_table(spark: SparkSession, path: str) -> DataFrame:
    table = try_read(spark, path)
    if table is None:
        raise MissingInput(f"no table at {path}")
    return table
