"""Secret scans by an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger
remembers which (blob, rule version) pairs were scanned and what they showed.
A run scans one copy of each blob, and of that only the rules not yet in the
ledger, appends the outcome, and joins findings back to all paths by address.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.frames import fresh_name, id_text, let, running_sums
from rankloom.session import materialize, scratch_path


@dataclass(frozen=True)
class SecretRule:
    """Matches are taken leftmost and non-overlapping; those whose ``group`` is
    shorter than ``least`` characters are dropped afterwards. ``hint`` is a
    cheaper pattern that every text with a kept match has. A ``backward`` pattern is
    matched against the reversed text."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str
    backward: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE_RULES = [
    SecretRule("assign", 1, ASSIGN, 2, 8, r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}"),
    SecretRule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    SecretRule("hex", 1, r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
]
# A whole private key: to its END line, past single hyphens; without one, to the last token of
# its base64 body, which may be quoted, prefixed or have escaped line ends. A tail that lost its
# BEGIN line is found from its END line back, as long as tokens last. All but the short parts are
# possessive, so long texts do not recurse.
_GAP = r"""(?:[\x20\x09-\x0D"'>#*|,;]|\\[nrt])"""
_HEAD = rf"{_GAP}*+[A-Za-z][A-Za-z0-9-]*+:\x20[^\n\r\\]*+"
_TOKEN = rf"""{_GAP}*+(?:[A-Za-z0-9+/=]{{16,}}+|[A-Za-z0-9+/=]++(?=[\x20\x09]*+(?:["',;\\\n\r]|\z)))"""
WHOLE_KEY = (rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-{{5,}}END [A-Z ]*PRIVATE KEY-----"
             rf"|(?:(?:{_HEAD})*+(?:{_TOKEN})++)?+)")
_BACK_GAP = r"""(?:[\x20\x09-\x0D"'>#*|,;]|[nrt]\\)"""
_BACK_CHAR = r"(?:[A-Za-z0-9+/=](?!\\))"
KEY_TAIL = (rf"-----YEK ETAVIRP[A-Z ]*\x20DNE-{{5,}}+(?:{_BACK_GAP}++{_BACK_CHAR}++)?+"
            rf"(?:{_BACK_GAP}++{_BACK_CHAR}{{16,}}+)*+")
RULES = [
    *BASE_RULES,
    SecretRule("pem", 2, WHOLE_KEY, 0, 1, r"BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("pem_tail", 1, KEY_TAIL, 0, 1, r"END [A-Z ]*PRIVATE KEY-----", backward=True),
    SecretRule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
    SecretRule("url", 1, r"[a-z]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 1, r"://[^\x20\x09-\x0D/:@]+:"),
]
SPANS = "array<struct<start:int,end:int>>"
PAIRS = f"array<struct<kind:string,version:int,spans:{SPANS}>>"
LEDGER = f"blob string, pairs {PAIRS}"


def rule_spans(text: Column, rule: SecretRule) -> Column:
    """Code-point spans of one rule in one text, in order.

    The text is cut at the matches; running lengths of gaps and matches are the
    offsets. Offsets in a reversed text count from its end.
    """
    read = F.reverse(text) if rule.backward else text
    wanted = F.regexp_extract_all(read, F.lit(rule.pattern), F.lit(rule.group))

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(read, rule.pattern), 1, F.size(found))
        lengths = F.zip_with(gaps, found, lambda g, m: F.char_length(g) + F.char_length(m))
        return F.zip_with(
            let(lengths, running_sums), F.arrays_zip(found.alias("m"), wanted.alias("w")), lambda end, x: F.when(
                F.char_length(x["w"]) >= rule.least,
                F.struct((end - F.char_length(x["m"])).alias("start"), end.alias("end"))))

    none = F.array().cast(SPANS)
    found = F.filter(let(F.regexp_extract_all(read, F.lit(rule.pattern), F.lit(0)), spans), lambda s: s.isNotNull())
    if rule.backward:
        found = F.reverse(F.transform(found, lambda s: F.struct(
            (F.char_length(text) - s["end"]).alias("start"), (F.char_length(text) - s["start"]).alias("end"))))
    return F.when(text.rlike(rule.hint) & read.rlike(rule.pattern), found.cast(SPANS)).otherwise(none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored ledger; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan_into_ledger(docs: DataFrame, path: str, rules: list[SecretRule] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, return (doc_id, blob) of all rows.

    Texts move once, to meet the one row chosen for their blob; a blob that a
    third of all rows share is scanned once.
    """
    versions = id_text(docs).withColumn("blob", F.sha2("text", 256))
    addresses = materialize(versions.select("doc_id", "blob"), "addresses")
    known = read_ledger(docs.sparkSession, path).select("blob", F.explode("pairs").alias("pair")).groupBy("blob").agg(
        F.collect_set(F.concat_ws("@", "pair.kind", "pair.version")).alias("known"))
    every = F.array(*[F.lit(r.key) for r in rules])
    missing = F.array_except(every, F.coalesce(F.col("known"), F.array().cast("array<string>")))
    # The least id speaks for a blob; -1 stands for a blob whose ids are all null.
    fresh = (addresses.groupBy("blob").agg(F.coalesce(F.min("doc_id"), F.lit(-1).cast("long")).alias("speaker"))
             .join(known, "blob", "left").select("blob", "speaker", missing.alias("missing"))
             .where(F.size("missing") > 0))
    texts = versions.withColumn("speaker", F.coalesce("doc_id", F.lit(-1).cast("long"))).drop("doc_id")
    pairs = F.array(*[F.when(F.array_contains("missing", r.key), F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
        rule_spans(F.col("text"), r).alias("spans"))) for r in rules])
    scanned = texts.join(fresh, ["blob", "speaker"]).select(
        "blob", F.filter(pairs, lambda p: p.isNotNull()).cast(PAIRS).alias("pairs")).dropDuplicates(["blob"])
    scanned.write.mode("append").parquet(path)
    return addresses


def all_findings(docs: DataFrame, path: str | None = None, rules: list[SecretRule] = RULES) -> DataFrame:
    """(doc_id, pairs): every row with the spans of every asked rule.

    A null text is the empty blob without findings. Rows with a null doc_id are
    scanned and returned as others are; equal rows give equal rows; an empty
    table gives an empty one. ``path`` is the ledger, kept between runs; without
    one a new ledger is begun in the shared folder.
    """
    path = path or scratch_path(docs.sparkSession, "ledger")
    addresses = scan_into_ledger(docs, path, rules)
    keys = [r.key for r in rules]
    asked = F.filter("pairs", lambda p: (F.size(p["spans"]) > 0) & F.concat_ws("@", p["kind"], p["version"]).isin(keys))
    found = (read_ledger(docs.sparkSession, path).select("blob", F.explode(asked).alias("pair"))
             .groupBy("blob").agg(F.collect_set("pair").alias("pairs")))
    return addresses.join(found, "blob", "left").select(
        "doc_id", "blob", F.coalesce("pairs", F.array().cast(PAIRS)).alias("pairs"))


def spans_of(pairs: Column, rules: list[SecretRule]) -> Column:
    """Spans of the given kinds as (start, order of kind, end, kind), sorted."""
    def of(kind: str, turn: int) -> Column:
        mine = F.flatten(F.transform(F.filter(pairs, lambda p: p["kind"] == kind), lambda p: p["spans"]))
        return F.transform(mine, lambda s: F.struct(
            s["start"].alias("start"), F.lit(turn).alias("turn"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[of(rule.kind, turn) for turn, rule in enumerate(rules)]))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans, per row.

    The END line of a private key is found with its tail as well (``pem_tail``), so
    a whole key has two spans, one inside the other.
    """
    spans = F.col("spans_all")
    table = all_findings(docs, path).withColumn("spans_all", spans_of(F.col("pairs"), RULES))
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, other.kind)) for other in BASE_RULES]
    counts = [(F.size(kinds) - n).cast("long").alias(f"n_{r.kind}") for n, r in zip(counts, BASE_RULES, strict=True)]
    return table.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"),
                        spans_text(spans).alias("spans"))


def redact_secrets(docs: DataFrame, path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``, with found spans replaced by ``mark``.

    Of a private key the body goes with its header. Texts without findings, null
    ones too, stay as they are. ``n_chars``, where present, follows the new text.
    """
    path = path or scratch_path(docs.sparkSession, "ledger")
    blob, pairs = fresh_name(docs, "blob"), fresh_name(docs, "pairs")
    findings = all_findings(docs, path, RULES).select(
        F.col("blob").alias(blob), F.col("pairs").alias(pairs)).where(F.size(pairs) > 0).groupBy(blob).agg(
        F.first(pairs).alias(pairs))
    joined = docs.withColumn(blob, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).join(findings, blob, "left")
    text = F.col("text")
    spans = spans_of(F.col(f"`{pairs}`"), RULES)
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("until"))
    cut = F.aggregate(
        spans, empty,
        lambda acc, s: F.when(s["start"] >= acc["until"], F.struct(
            F.concat(acc["out"], F.substring(text, acc["until"] + 1, s["start"] - acc["until"]), F.lit(mark)).alias(
                "out"), s["end"].alias("until"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["until"], s["end"]).alias("until"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["until"] + 1, F.char_length(text))))
    clean = F.when(F.col(f"`{pairs}`").isNull(), text).otherwise(cut)
    out = []
    for field in docs.schema.fields:
        name = F.col(f"`{field.name}`")
        if field.name == "text":
            name = clean.alias("text")
        elif field.name == "n_chars":
            name = F.when(F.col(f"`{pairs}`").isNull(), name).otherwise(F.char_length(clean)).cast(
                field.dataType).alias("n_chars")
        out.append(name)
    return joined.select(*out)
