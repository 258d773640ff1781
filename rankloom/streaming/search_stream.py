"""A stream of questions answered from a static corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.encode import EncoderFactory
from rankloom.operators.lexical import TokenStatistics
from rankloom.plans.search_flow import KEEP, RETRIEVE, Scorer, search_texts
from rankloom.session import materialize, scratch_scope
from rankloom.sources.guards import try_read
from rankloom.sources.stores import Index


def answer_stream(questions: DataFrame, corpus: DataFrame, corpus_vectors: DataFrame,
                  stats: TokenStatistics, name: str, factory: EncoderFactory, sink: str,
                  checkpoint: str, retrieve: int = RETRIEVE, keep: int = KEEP,
                  trigger: dict | None = None, index: Index | None = None, probes: int = 1,
                  scorer: Scorer | None = None) -> StreamingQuery:
    """Answer each micro-batch of ``questions(query_id, text)`` into ``sink``.

    A micro-batch is small beside the corpus and is sent to the corpus scan. The
    sink keeps one folder per batch and a repeated batch replaces its own, so a
    retry leaves no duplicates. Corpus vectors and token counts are made once. With a
    saved ``index`` a batch reads only the lists it probes. What a batch stores on its
    way goes when its answers are written.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            batch = materialize(batch, "questions")  # read several times below
            if batch.isEmpty():
                return
            hits = search_texts(batch, corpus, name, factory, retrieve, keep, corpus_vectors, stats, index, probes,
                                scorer=scorer)
            hits.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (questions.writeStream.foreachBatch(answer)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


ANSWERS = ("query_id bigint, doc_id bigint, retrieval_score double, retrieval_rank bigint, rerank_score double, "
           "rerank_rank bigint, verdict string, text string")


def read_answers(spark: SparkSession, sink: str) -> DataFrame:
    """All answers so far; none when no question has come yet."""
    table = try_read(spark, sink)
    return spark.createDataFrame([], ANSWERS) if table is None else table.drop("batch_id")
