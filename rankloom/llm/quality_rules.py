"""Quality rules: a table of thresholds compiled into one Spark projection.

``RULES`` names a measure, the scale it is divided by, and the allowed range.
``compile_rules`` turns the table into columns; every measure is a built-in
expression over the row's own text, so the plan is scan, project, write: no
shuffle, no user function, no state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.frames import SPACE_CHARS, SPACE_CLASS, fresh_name, id_text, let, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
STOP_WORDS = [
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "with",
    "aus", "das", "dem", "den", "der", "des", "die", "ein", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "avec", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "pour", "qui", "un", "une",
    "con", "del", "el", "las", "los", "no", "para", "por", "que", "se", "una", "y",
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_marks",
            "n_lines"]


@dataclass(frozen=True)
class Rule:
    """Rejects a row unless ``low * scale <= 1000 * measure <= high * scale``.

    Thresholds are thousandths and whole numbers, so the verdict is exact in
    any engine. Without a scale the measure itself is compared. An open side is None.
    """

    name: str
    measure: str
    scale: str | None
    low: int | None
    high: int | None


RULES = [
    Rule("few_words", "n_words", None, 10, None),
    Rule("word_length", "word_chars", "n_words", 2_000, 15_000),
    Rule("symbols", "n_symbols", "n_words", None, 300),
    Rule("marks", "n_marks", "n_words", None, 500),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 200),
]


def _length_without(text: Column, kept: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more.

    Only rows with a repeated window pay for sorting (hash, position) pairs;
    neighbours of equal hash are repeats, and each counts the words up to the
    next repeated window, five at most.
    """
    last = F.lit(None).cast("struct<h:bigint,i:int>")
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("until"))

    def repeated(ordered: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        before = F.concat(F.array(last), F.slice(ordered, 1, F.size(ordered) - 1))
        after = F.concat(F.slice(ordered, 2, F.size(ordered)), F.array(last))
        marked = F.zip_with(F.arrays_zip(ordered.alias("it"), before.alias("was")), after, lambda x, z: F.when(
            same(x["it"], x["was"]) | same(x["it"], z), x["it"]["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(
            let(pairs, repeated), start,
            lambda acc, i: F.struct(
                (acc["total"] + F.lit(WINDOW) - F.greatest(acc["until"] - i, F.lit(0))).cast("long").alias("total"),
                (i + F.lit(WINDOW)).alias("until")),
            lambda acc: acc["total"])

    return let(windows, lambda found: F.when(
        F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(covered(found)))


def with_measures(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Add the measures under names that clash with nothing; gives measure -> column."""
    names = {m: fresh_name(df, m) for m in [*MEASURES, "words", "lines"]}
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    col = {m: F.col(f"`{n}`") for m, n in names.items()}
    df = df.withColumns({
        names["words"]: words_of(body),
        names["lines"]: F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)})
    hashes = F.transform(col["words"], lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(h) - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumns({
        names["n_words"]: F.size(col["words"]).cast("long"),
        names["word_chars"]: F.char_length(F.array_join(col["words"], "")).cast("long"),
        names["n_symbols"]: _length_without(body, SYMBOLS),
        names["n_marks"]: _length_without(body, "!?"),
        names["n_lines"]: F.size(col["lines"]).cast("long"),
        names["n_dup_lines"]: (F.size(col["lines"]) - F.size(F.array_distinct(col["lines"]))).cast("long"),
        names["n_stop_words"]: F.size(F.filter(col["words"], lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        names["n_repeat_words"]: _repeat_words(windows),
    })
    return df.drop(*[names[m] for m in ("words", "lines")]), {m: names[m] for m in MEASURES}


def compile_rules(rules: list[Rule], names: dict[str, str]) -> dict[str, Column]:
    """Rule name -> whether a row breaks it."""
    def broken(rule: Rule) -> Column:
        value = F.col(f"`{names[rule.measure]}`")
        scale = F.lit(1).cast("long")
        if rule.scale is not None:
            value, scale = value * 1000, F.col(f"`{names[rule.scale]}`")
        sides = []
        if rule.low is not None:
            sides.append(value < F.lit(rule.low) * scale)
        if rule.high is not None:
            sides.append(value > F.lit(rule.high) * scale)
        return sides[0] if len(sides) == 1 else sides[0] | sides[1]

    return {rule.name: broken(rule) for rule in rules}


def rule_report(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, measures, base_failed, kept, broken): every document with its verdict.

    A null text counts as empty: no words, so it is rejected. A null doc_id
    stays null. Equal rows give equal rows. An empty table gives an empty one.
    Other columns are not carried. Windows are compared by 64-bit hashes within
    one text, so a false repeat has a chance of about n^2 / 2^65 for n words.
    """
    measured, names = with_measures(id_text(docs))
    tests = compile_rules(rules, names)
    n_words, repeats = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    base = (n_words < 10) | (100 * repeats > 20 * n_words)
    broken = F.array_join(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), ",")
    judged = measured.drop("text").withColumn("base_failed", base).withColumn("broken", broken)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))


def keep_good(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows whose text breaks no rule, with all their columns and no others."""
    measured, names = with_measures(docs)
    bad = None
    for test in compile_rules(rules, names).values():
        bad = test if bad is None else bad | test
    return measured.where(~bad).select(*[F.col(f"`{c}`") for c in docs.columns])
