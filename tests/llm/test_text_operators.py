"""Rules, secrets and piece counts against plain per-row versions."""

import hashlib
import re
from collections import Counter

import pytest

from rankloom.llm import piece_counts, quality_rules, secret_ledger
from tests.llm.helpers import awkward, documents, nothing, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(rows):
    return Counter(tuple(r) for r in rows)


def plain_rules(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_rules_equal_plain_version(spark, sf_dir):
    for docs in (documents(spark, sf_dir), awkward(spark)):
        raw = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = quality_rules.rule_report(docs).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        assert bag(got) == bag(plain_rules(*r) for r in raw)


def test_rules_verdict_and_filter(spark, sf_dir):
    docs = documents(spark, sf_dir)
    report = quality_rules.rule_report(docs)
    assert report.where("kept and base_failed").count() == 0
    assert report.where("kept != (broken = '')").count() == report.where("base_failed and broken = ''").count() == 0
    kept = {r[0] for r in report.where("kept").select("doc_id").collect()}
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    labels = dict(rows_of(sf_dir, "labels", "doc_id, quality"))
    assert sum(labels[d] == 1 and d in kept for d in labels) >= 0.95 * sum(labels.values())
    assert quality_rules.keep_good(awkward(spark)).columns == awkward(spark).columns
    assert quality_rules.rule_report(nothing(spark)).count() == quality_rules.keep_good(nothing(spark)).count() == 0


def plain_spans(text):
    text, found = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def plain_secrets(doc_id, text):
    found = plain_spans(text)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return (doc_id, *[sum(f[3] == k for f in found) for k in ("assign", "access", "hex")],
            hashlib.sha256(joined.encode()).hexdigest())


def test_secrets_equal_plain_version(spark, sf_dir):
    for docs in (documents(spark, sf_dir), awkward(spark)):
        raw = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = secret_ledger.secret_report(docs).drop("spans").collect()
        assert bag(got) == bag(plain_secrets(*r) for r in raw)
    assert secret_ledger.secret_report(nothing(spark)).count() == 0


def test_many_secrets_in_one_text(spark):
    text = "ü token=abcdefgh " * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = secret_ledger.secret_report(docs).first()
    assert got.spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in plain_spans(text)) and got.n_assign == 3000


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    docs = awkward(spark)
    first = secret_ledger.all_findings(docs, path, secret_ledger.BASE_RULES).collect()
    scans = lambda: secret_ledger.read_ledger(spark, path).selectExpr(
        "blob", "explode(pairs) pair").selectExpr("blob", "pair.kind", "pair.version").collect()
    before = bag(scans())
    assert set(before.values()) == {1} and len({r[0] for r in before}) == len({t or "" for _, t in
                                                                                 [tuple(r)[:2] for r in docs.collect()]})
    again = secret_ledger.all_findings(docs, path, secret_ledger.BASE_RULES).collect()
    assert bag(scans()) == before and sorted(map(str, again)) == sorted(map(str, first))
    secret_ledger.all_findings(docs, path).count()
    added = bag(scans()) - before
    assert {r[1] for r in added} == {"pem", "forge", "url"} and set(bag(scans()).values()) == {1}


def test_redaction(spark):
    docs = awkward(spark)
    clean = secret_ledger.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    found = {r.doc_id: r.text for r in clean.collect()}
    assert found[9].startswith('x [SECRET]" password: short secret: token: abcdefgh1 é [SECRET]ü')
    assert found[4] and found[1] is None and "AKIA1234567890" not in found[10]


@pytest.mark.parametrize("size", [3, 17, 1 << 15])
def test_piece_counts(spark, sf_dir, size):
    model = piece_counts._processor(None)
    for docs in (documents(spark, sf_dir), awkward(spark)):
        raw = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        for _, text in raw:
            parts = piece_counts.safe_parts(text or "", size)
            assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text or ""))
        if size > 100:
            got = piece_counts.token_counts(docs).collect()
            assert bag(got) == bag((d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096)
                                   for d, t in raw)
    assert piece_counts.token_counts(nothing(spark)).count() == 0
