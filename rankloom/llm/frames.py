"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators of every contract, as a regular-expression class and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null becomes empty) alone, so that no other
    column of the caller can clash with a derived one."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def words_of(text: Column) -> Column:
    """Maximal runs of non-separators, in order; an empty array without any."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{SPACE_CLASS}]+")).otherwise(
        F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row.

    An expression named inside a lambda is evaluated for every element; as the
    lambda's own variable it is evaluated before.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BLOCK = 64


def running_sums(lengths: Column) -> Column:
    """Inclusive running sums of an int array, from block totals, so that a text
    with very many parts does not cost their square."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    totals = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                         lambda b: total(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))
    return let(totals, lambda t: F.transform(
        lengths, lambda _, i: total(F.slice(t, 1, F.floor(i / _BLOCK).cast("int"))) + total(
            F.slice(lengths, (i - i % _BLOCK) + 1, i % _BLOCK + 1))))


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def by_bytes(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold about ``limit`` bytes each."""
    start = held = 0
    for row, size in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + size > limit:
            yield start, row
            start, held = row, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
