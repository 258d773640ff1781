"""A stream of texts encoded into the embedding store, each text once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.encode import Batching, EncoderFactory, distinct_texts, encode_fresh
from rankloom.session import materialize, scratch_scope
from rankloom.sources.stores import append_vectors, read_vectors


def encode_stream(texts: DataFrame, name: str, factory: EncoderFactory, store: str, checkpoint: str,
                  text: str = "text", trigger: dict | None = None,
                  batching: Batching | None = None) -> StreamingQuery:
    """Append vectors of texts the store lacks.

    A retried batch finds what its first run stored and adds only the rest. A batch
    reads the stored keys of the folders its own keys fall into, and leaves no other table behind.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            once = materialize(distinct_texts(batch, text, name), "texts")
            stored = read_vectors(spark, store, once)
            append_vectors(encode_fresh(once, stored, name, factory, batching), store, compared=True)

    return (texts.writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
