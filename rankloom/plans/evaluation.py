"""The offline evaluation: score pairs, split, tune on validation, judge on test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.compare import evaluation_record
from rankloom.operators.encode import Batching, EncoderFactory, score_pairs_by_models, with_pair_keys
from rankloom.operators.splits import SEED, TEST_SIZE, VAL_SIZE, Size, create_splits
from rankloom.operators.threshold import tune
from rankloom.session import materialize


def evaluate_encoders(pairs: DataFrame, encoders: dict[str, EncoderFactory], key: str = "pair_id",
                      test: Size = TEST_SIZE, val: Size = VAL_SIZE,
                      seed: int | str = SEED, digits: int | None = None, group: str | None = None,
                      batching: Batching | None = None,
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored and split pairs, one test record per encoder, one validation record each).

    The split depends on the pair key alone, so all encoders share it. Scored rows
    keep the ``group`` column, or a hash of their query, for grouping instead of the texts.
    """
    divided = materialize(with_pair_keys(create_splits(pairs, key, test, val, seed)), "split")
    keyed = divided.withColumn("query_key", F.col(group) if group else F.md5("query"))
    scored = materialize(score_pairs_by_models(
        keyed, encoders, digits, keep=[key, "query_key", "true_label", "split"], batching=batching), "scored")
    scored = scored.withColumnRenamed("query_key", "query")
    held = scored.where("split = 'val'")
    tuned = tune(held, ("model",))
    return (scored, evaluation_record(scored.where("split = 'test'"), tuned, "test"),
            evaluation_record(held, tuned, "val"))
