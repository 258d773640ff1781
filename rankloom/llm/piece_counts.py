"""Token counts: whole texts encoded in Arrow batches, only lengths come back.

An Arrow function encodes chunks of about ``CHUNK_BYTES`` bytes, whatever the
number of rows in them, so memory follows bytes and not rows. A long text is
cut where the pieces cannot know of each other: at a single space between two
ASCII letters or digits. No piece of the vocabulary has a space after another
character, so no merge crosses such a cut, and the dropped space is exactly the
leading mark that the library puts before the next part.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.frames import by_bytes, id_text

CHUNK_BYTES = 1 << 20
LONG_TEXT = 1 << 15
LIMIT = 4096
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


@functools.lru_cache(maxsize=4)
def _processor(path: str | None):
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece.SentencePieceProcessor(model_file=path)


def safe_parts(text: str, size: int = LONG_TEXT) -> list[str]:
    """Parts of at least ``size`` characters whose token counts add up to the text's."""
    parts, start = [], 0
    while len(text) - start > 2 * size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start:cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def count_tokens(texts: list[str], path: str | None = None) -> list[int]:
    parts, owner = [], []
    for row, text in enumerate(texts):
        for part in safe_parts(text) if len(text) > 2 * LONG_TEXT else (text,):
            parts.append(part)
            owner.append(row)
    counts = [0] * len(texts)
    for row, ids in zip(owner, _processor(path).encode(parts, num_threads=1), strict=True):
        counts[row] += len(ids)
    return counts


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    A null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null,
    repeated rows are counted each, an empty table gives an empty one, other
    columns are not carried. ``path`` names the model file on the workers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column("text"), []
            for low, high in by_bytes(texts, CHUNK_BYTES):
                counts += count_tokens(texts.slice(low, high - low).to_pylist(), path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()),
                 pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = id_text(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
