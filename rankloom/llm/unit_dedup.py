"""Substring deduplication by unit hashing.

A text is cut into units: at least four words, then on to the end of the
sentence or line. A unit is normalised (lower case, separators and sentence
ends collapsed) and hashed to 128 bits. Digests are grouped globally; the
occurrence ranked first, by document and position, stays. Runs of consecutive
repeated units that together hold ``MIN_WORDS`` words or more are removed, and
their offsets in the original text are returned with the shortened text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.frames import SPACE_CHARS, fresh_name, let, running_sums
from rankloom.session import materialize

MIN_WORDS = 15
#: Row number of rows without an id.
NO_ID = 2 ** 63 - 1
_S = r"\x20\x09-\x0D"
UNIT = rf"(?:[{_S}]*(?:[^{_S}]+[{_S}]+){{4}}[^.!?\n]*(?:[.!?\n][.!?{_S}]*|\z))|(?:[\x00-\x{{10FFFF}}]+)"
SPANS = "array<struct<start:int,end:int>>"


def units_of(text: Column) -> Column:
    """Units in order; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def normal_form(unit: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(unit), rf"[{_S}.!?]+", " "), F.lit(SPACE_CHARS))


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, mark, pos, rank, words, h1, h2): every unit of every row with its
    128-bit digest. ``rank`` orders by row, then text, then position, in one number,
    which a hash aggregation can keep. Texts without an id rank by their hash, after
    all that have one; those that share an id by 26 bits of it."""
    units = F.transform(units_of(F.col("text")), lambda u: let(normal_form(u), lambda x: F.struct(
        F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("unit"), x).alias("h2"),
        F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("words"))))
    wide = "decimal(20,0)"
    mark = F.col("mark").cast(wide)
    # an unsigned hash behind all ids: 2^63 more, and 2^64 more where the hash is negative
    shift = F.when(mark < 0, F.lit(str(2 ** 64 + 2 ** 63))).otherwise(F.lit(str(2 ** 63))).cast(wide)
    row = F.when(F.col("row") == NO_ID, mark + shift).otherwise(F.col("row")).cast(wide)
    base = row * F.lit(2 ** 57).cast("decimal(18,0)") + F.col("mark").bitwiseAND(2 ** 26 - 1) * F.lit(2 ** 31)
    found = docs.select("row", "mark", base.cast("decimal(38,0)").alias("base"), F.posexplode(units).alias(
        "pos", "u")).where("u.words > 0")
    rank = (F.col("base") + F.col("pos")).cast("decimal(38,0)")
    return found.select("row", "mark", "pos", rank.alias("rank"), "u.words", "u.h1", "u.h2")


def repeated_units(docs: DataFrame) -> DataFrame:
    """(row, mark, pos, words) of every occurrence but the first of its digest.

    Digests fold per task before they are shuffled, so a line that a third of
    all documents hold is a few partial rows. Those that occur twice are stored,
    so the join back has nothing but shuffles on both sides and adaptive execution
    can split a hot digest over many tasks.
    """
    found = occurrences(docs)
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("rank").alias("first")).where("n > 1")
    first = materialize(first.select("h1", "h2", "first"), "repeated")
    return found.join(first, ["h1", "h2"]).where("rank != first").select(
        "row", "mark", "pos", "words")


def runs_by_row(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, mark, runs): first and last unit of every run to remove, in order."""
    start = F.struct(F.array().cast("array<struct<low:int,high:int,words:int>>").alias("done"),
                     F.lit(None).cast("struct<low:int,high:int,words:int>").alias("open"))

    def step(acc: Column, u: Column) -> Column:
        one = F.struct(u["pos"].alias("low"), u["pos"].alias("high"), u["words"].alias("words"))
        longer = F.struct(acc["open"]["low"].alias("low"), u["pos"].alias("high"),
                          (acc["open"]["words"] + u["words"]).alias("words"))
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), one.alias("open"))).when(
            acc["open"]["high"] + 1 == u["pos"], F.struct(acc["done"].alias("done"), longer.alias("open"))).otherwise(
            F.struct(_closed(acc, min_words).alias("done"), one.alias("open")))

    # A set: rows that repeat a text name each of its places once, folded before the shuffle.
    listed = repeated_units(docs).groupBy("row", "mark").agg(F.array_sort(F.collect_set(F.struct("pos", "words"))).alias("units"))
    runs = F.aggregate("units", start, step, lambda acc: _closed(acc, min_words))
    return listed.select("row", "mark", runs.alias("runs")).where(F.size("runs") > 0)


def _closed(acc: Column, min_words: int) -> Column:
    return F.when(acc["open"]["words"] >= min_words, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])


def _spans(text: Column, runs: Column) -> Column:
    """Code-point offsets of the runs in the original text."""
    def offsets(ends: Column) -> Column:
        return F.transform(runs, lambda r: F.struct(
            F.when(r["low"] == 0, F.lit(0)).otherwise(F.get(ends, r["low"] - 1)).cast("int").alias("start"),
            F.get(ends, r["high"]).cast("int").alias("end")))

    lengths = F.transform(units_of(text), lambda u: F.char_length(u))
    return let(let(lengths, running_sums), offsets)


def _without(text: Column, spans: Column) -> Column:
    """The text without the spans: what lies before each, and the rest."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda low, high: F.substring(text, low + 1, high - low)), "")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with shortened texts and one more column of removed spans, whose
    name is returned. See ``dedup_report`` for the awkward cases."""
    names = {n: fresh_name(docs, n) for n in ("row", "mark", "runs", "removed")}
    ranked = docs.withColumns({names["row"]: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                               names["mark"]: F.xxhash64("text")})
    plain = ranked.select(F.col(names["row"]).alias("row"), F.col(names["mark"]).alias("mark"),
                          F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = runs_by_row(plain, min_words).select(*[F.col(n).alias(names[n]) for n in ("row", "mark", "runs")])
    joined = ranked.join(found, [names["row"], names["mark"]], "left")
    none = F.array().cast(SPANS)
    spans = F.when(F.col(names["runs"]).isNull(), none).otherwise(_spans(F.col("text"), F.col(names["runs"])))
    spanned = joined.withColumn(names["removed"], spans)
    removed = F.col(names["removed"])
    out = []
    for field in docs.schema.fields:
        value = F.col(f"`{field.name}`")
        if field.name == "text":
            value = F.when(F.size(removed) > 0, _without(value, removed)).otherwise(value).alias("text")
        elif field.name == "n_chars":
            gone = F.aggregate(removed, F.lit(0), lambda a, s: a + s["end"] - s["start"])
            value = F.when(F.size(removed) > 0, F.char_length("text") - gone).otherwise(value).cast(
                field.dataType).alias("n_chars")
        out.append(value)
    return spanned.select(*out, removed), names["removed"]


def dedup_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_chars, removed_chars, removed_spans, text_sha256) of every row.

    ``removed_spans`` lists start:end in code points of the original text. Null
    and blank texts have no units and stay as they are (null counts as empty
    here). Rows rank by doc_id, null ids last; different texts of one id, or
    without one, rank by a hash. Equal rows count as one document: neither loses
    text to the other, and what an earlier document holds goes from both. An empty
    table gives an empty one. Other columns are not carried.
    """
    table, removed = drop_repeats(docs.select("doc_id", "text"), min_words)
    gone = F.aggregate(removed, F.lit(0), lambda a, s: a + s["end"] - s["start"])
    left = F.coalesce("text", F.lit(""))
    return table.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.char_length(left) + gone).cast("long").alias("n_chars"), gone.cast("long").alias("removed_chars"),
        F.array_join(F.transform(removed, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast(
            "string"))), ",").alias("removed_spans"),
        F.sha2(left, 256).alias("text_sha256"))
