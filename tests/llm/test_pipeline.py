"""Every stage against a plain version of its predecessor's rows, and awkward rows."""

import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import quality_rules, secret_ledger, unit_dedup, variable_bins
from tests.llm.helpers import awkward, documents, nothing
from tests.llm.test_near_duplicates import plain_components, plain_sets
from tests.llm.test_text_operators import WORD, plain_rules, plain_spans


def plain_good(text):
    text = text or ""
    _, n, chars, symbols, dup, repeats, failed = plain_rules(0, text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    marks, stops = len(re.findall("[!?]", text)), sum(w.lower() in quality_rules.STOP_WORDS for w in WORD.findall(text))
    return not (failed or not 2 * n <= chars <= 15 * n or 10 * symbols > 3 * n or 2 * marks > n or 50 * stops < n
                or 2 * dup > len(lines))


def plain_repeats(rows):
    """doc_id -> removed spans; rows in rank order."""
    seen, out = set(), {}
    pattern = re.compile(unit_dedup.UNIT.replace(r"\z", r"\Z").replace(r"\x{10FFFF}", "\U0010ffff"))
    for doc_id, text in rows:
        run, spans = [], []
        for m in [*pattern.finditer(text or ""), None]:
            words = re.sub(r"[\x20\x09-\x0D.!?]+", " ", m[0].lower()).strip(" ").split(" ") if m else []
            key = " ".join(words)
            if key and key in seen:
                run.append((m.start(), m.end(), len(words)))
            else:
                if sum(r[2] for r in run) >= unit_dedup.MIN_WORDS:
                    spans.append((run[0][0], run[-1][1]))
                run = []
            seen.add(key)
        out[doc_id] = spans
    return out


def cut(text, spans, mark=""):
    for low, high in reversed(spans):
        text = text[:low] + mark + text[high:]
    return text


def merged(spans):
    out = []
    for low, high in sorted(spans):
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def pairs(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    before = pairs(docs)
    after = stages["quality_rules"](spark, docs, sf_dir)
    assert after.columns == columns and pairs(after) == [r for r in before if plain_good(r[1])]
    docs, before = after, pairs(after)
    after = stages["near_duplicates"](spark, docs, sf_dir)
    groups = plain_components(plain_sets(before), corpus_pipeline.NEAR_PERCENT)
    assert after.columns == columns and pairs(after) == [r for r in before if groups[r[0]] == r[0]]
    docs, before = after, pairs(after)
    after = stages["substring_dedup"](spark, docs, sf_dir)
    spans = plain_repeats(before)
    assert after.columns == columns and pairs(after) == [(d, cut(t, spans[d])) for d, t in before]
    assert all(r.n_chars == len(r.text) for r in after.collect() if spans[r.doc_id])
    docs, before = after, pairs(after)
    after = stages["secret_scan"](spark, docs, sf_dir)
    assert after.columns == columns
    assert pairs(after) == [(d, cut(t, merged((s, e) for s, _, e, _ in plain_spans(t)), "[SECRET]")) for d, t in before]
    packed = stages["best_fit_packing"](spark, after, sf_dir).collect()
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.n_tokens
    assert whole == Counter({r.doc_id: r.n_tokens for r in variable_bins.token_lengths(after).collect()})
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, packed))


def test_repeats_report(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = pairs(docs)
    spans = plain_repeats(rows)
    got = {r.doc_id: r.removed_spans for r in unit_dedup.dedup_report(docs).collect()}
    assert got == {d: ",".join(f"{a}:{b}" for a, b in spans[d]) for d, _ in rows}
    assert any(got.values())


def plain_ranked(rows):
    """``plain_repeats`` for repeated rows and null ids: one document per (id, text)."""
    def rank(row):
        mark = xxhash.xxh64((row[1] or "").encode(), seed=42).intdigest()
        return (row[0] is None, mark if row[0] is None else row[0], mark % 2 ** 26)

    known = sorted(set(rows), key=rank)
    spans = plain_repeats([(row, row[1]) for row in known])
    return Counter((row[0], ",".join(f"{a}:{b}" for a, b in spans[row]), sum(b - a for a, b in spans[row]),
                    len(row[1] or "")) for row in rows)


def test_repeated_rows_and_null_ids(spark):
    """What an earlier document holds goes from equal rows alike, and from all but one of the texts without an id."""
    passages = [" ".join(f"p{p}s{k} one two three four five six seven eight nine." for k in range(4)) for p in range(3)]
    other = "Something else stands here that no other text has at all number {0}. "
    rows = [(1, passages[0] + " The end of it is here now."), (2, other.format(2) + passages[0]),
            (2, other.format(2) + passages[0]), (3, other.format(3) + passages[0]),
            *[(None, other.format(9) + passages[0])] * 3,
            *[(None, f"{passages[1]} {other.format(k)}") for k in range(10, 15)], (4, passages[2] + " one."),
            (4, passages[2] + " two."), (None, None), (None, None), (5, "")] + [(7, passages[0] + passages[2])] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = unit_dedup.dedup_report(docs).collect()
    assert Counter((r.doc_id, r.removed_spans, r.removed_chars, r.n_chars) for r in got) == plain_ranked(rows)
    without = [r for r in got if r.doc_id is None and r.n_chars and "s0" not in r.removed_spans]
    assert sum(r.removed_chars > 0 for r in without) == 3 + 4
    shortened, removed = unit_dedup.drop_repeats(docs.withColumn("n_chars", F.char_length("text")))
    assert all(r.n_chars == len(r.text) for r in shortened.where("text is not null").collect())


def test_planted_passage_inside_lines(spark):
    host = "Alpha beta gamma delta epsilon zeta eta theta number {0} iota kappa. Lambda mu nu xi omicron pi {0} rho sigma."
    passage = " ".join(f"Pass{k} word one two three four five six seven eight nine." for k in range(6))
    rows = [(i, host.format(i).replace("iota", passage if i % 2 else "iota")) for i in range(1, 9)]
    got = {r.doc_id: r for r in unit_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].removed_chars == 0 and all(got[i].removed_chars == 0 for i in (2, 4, 6, 8))
    assert all(got[i].removed_chars > 0.7 * len(passage) for i in (3, 5, 7))


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    for docs in (awkward(spark), nothing(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[1:4]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == columns, name
        found = docs.collect()
        packed = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in found}
    report = unit_dedup.dedup_report(awkward(spark)).collect()
    assert len(report) == awkward(spark).count()
    by = defaultdict(list)
    for r in report:
        by[r.doc_id].append(r)
    assert [r.removed_chars for r in by[4]] == [0, 0] and by[5][0].removed_chars > 0 and by[1][0].n_chars == 0
    assert secret_ledger.RULES[:3] == secret_ledger.BASE_RULES
