"""Redaction takes the body of a private key, not its header alone."""

import base64
import random
from dataclasses import replace

import duckdb

from check import difference
from rankloom.llm import oracle, secret_ledger

RNG = random.Random(3)
RAW = base64.b64encode(bytes(RNG.randrange(256) for _ in range(1190))).decode()
LINES = [RAW[i:i + 64] for i in range(0, len(RAW), 64)]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
BODY = "\n".join(LINES)
HEADS = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0011223344556677\n\n"
#: text, what is left of it
CASES = {
    "whole": (f"before\n{BEGIN}\n{BODY}\n{END}\nafter it", "before\n[SECRET]\nafter it"),
    "two": (f"{BEGIN}\n{BODY}\n{END}\nthen - so\n{BEGIN}\n{BODY}\n{END}", "[SECRET]\nthen - so\n[SECRET]"),
    "heads": (f"x {BEGIN}\n{HEADS}{BODY}\n{END} y", "x [SECRET] y"),
    "no end": (f"x\n{BEGIN}\n{BODY}\n\nThis is the text after it.", "x\n[SECRET]\n\nThis is the text after it."),
    "no end, heads": (f"x\n{BEGIN}\n{HEADS}{BODY}\nThis is text.", "x\n[SECRET]\nThis is text."),
    "cut off": (f"x\n{BEGIN}\n{BODY[:-40]}", "x\n[SECRET]"),
    "cut in END": (f"x\n{BEGIN}\n{BODY}\n-----END RSA PRI", "x\n[SECRET]\n-----END RSA PRI"),
    "escaped": ('{"key": "' + BEGIN + "\\n" + "\\n".join(LINES) + "\\n" + END + '\\n", "b": 1}',
                '{"key": "[SECRET]\\n", "b": 1}'),
    "escaped, no end": ('{"key": "' + BEGIN + "\\n" + "\\n".join(LINES) + '"} and more', '{"key": "[SECRET]"} and more'),
    "one line": (f"k {BEGIN} {' '.join(LINES)} {END} z", "k [SECRET] z"),
    "quoted": ("> " + f"{BEGIN}\n{BODY}\n".replace("\n", "\n> ") + "it is over", "> [SECRET]\n> it is over"),
    "diff": (f"+{BEGIN}\n{BODY}\n{END}".replace("\n", "\n-"), "+[SECRET]"),
    "tail": (f"a word\n{BODY}\n{END}\nb", "a word\n[SECRET]\nb"),
    "header alone": (f"The mark {BEGIN} opens a key, as known.", "The mark [SECRET] opens a key, as known."),
    "other block": (f"{BEGIN}\n{BODY}\n-----BEGIN CERTIFICATE-----\nMIIB\n-----END CERTIFICATE-----",
                    "[SECRET]\n-----BEGIN CERTIFICATE-----\nMIIB\n-----END CERTIFICATE-----"),
    "long": (f"{BEGIN}\n" + "word - by. " * 60000, "[SECRET]\n" + "word - by. " * 60000),
}


def test_no_line_of_a_key_is_left(spark):
    names = sorted(CASES)
    docs = spark.createDataFrame([(i, CASES[n][0]) for i, n in enumerate(names)], "doc_id bigint, text string")
    got = {names[r.doc_id]: r.text for r in secret_ledger.redact_secrets(docs).collect()}
    for name in names:
        assert got[name] == CASES[name][1], (name, got[name][:300])
        assert not any(line in got[name] for line in LINES)


def test_report_shows_what_is_redacted(spark, tmp_path):
    """Report, SQL and redaction use one version of the rule."""
    names = sorted(set(CASES) - {"long"})
    docs = spark.createDataFrame([(i, CASES[n][0]) for i, n in enumerate(names)], "doc_id bigint, text string")
    report = secret_ledger.secret_report(docs)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    known = duckdb.connect()
    known.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = known.execute(oracle.statements()["op3_secret_ledger"]).df()
    assert difference(report.toPandas(), want) is None
    for row in report.collect():
        text, found = CASES[names[row.doc_id]][0], [s.split(":") for s in row.spans.split(",")]
        starts = [int(s[1]) for s in found if s[0].startswith("pem")]
        assert min(starts) == CASES[names[row.doc_id]][1].index("[SECRET]")
        assert any(text[int(a):int(b)].startswith("-----BEGIN") for k, a, b in found if k == "pem") or names[
            row.doc_id] == "tail"


def test_tails_have_no_length(spark):
    """A tail of some thousand tokens goes as a whole, and long texts without END line stay."""
    many = " ".join(f"{i:05d}" + RAW[:40] for i in range(5000))
    rows = [(1, f"a: {many} {END} b"), (2, many), (3, f"{END} " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in secret_ledger.redact_secrets(docs).collect()}
    assert got == {1: "a: [SECRET] b", 2: many, 3: "[SECRET] " * 3000}


def test_ledger_of_an_older_rule_is_scanned_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, CASES["whole"][0])], "doc_id bigint, text string")
    path, pem = str(tmp_path / "ledger"), secret_ledger.RULES[3]
    older = [*secret_ledger.BASE_RULES, replace(pem, version=1, pattern="-----BEGIN [A-Z ]*PRIVATE KEY-----")]
    assert secret_ledger.all_findings(docs, path, older).count() == 1
    assert secret_ledger.redact_secrets(docs, path).collect()[0].text == CASES["whole"][1]
