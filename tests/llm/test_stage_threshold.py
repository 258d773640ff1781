"""The near-duplicate stage of the pipeline links at 0.80, op7 at 0.85."""

import random

import corpus_pipeline
from rankloom.llm import hyperminhash as hmh
from tests.llm.helpers import documents
from tests.llm.test_near_duplicates import plain_sets


def components_at(sets, percent):
    """doc_id -> least id of its group, all pairs compared."""
    found, ids = {d: d for d in sets}, sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(found[a], found[b])
            changed |= found[a] != found[b]
            found[a] = found[b] = low
    return found


def kept(docs):
    return sorted(r.doc_id for r in docs.collect())


def test_stage_equals_all_pairs_at_080(spark, sf_dir):
    docs = documents(spark, sf_dir)
    sets = plain_sets([tuple(r) for r in docs.select("doc_id", "text").collect()])
    at = {p: [d for d, c in sorted(components_at(sets, p).items()) if c == d] for p in (80, 85)}
    assert kept(corpus_pipeline.near_duplicates(spark, docs, sf_dir)) == at[80]
    assert kept(hmh.first_of_groups(docs)) == at[85] and len(at[80]) < len(at[85])


def test_edits_around_the_threshold(spark):
    """Of 150 words two, three and four edits give 0.87, 0.81 and 0.76."""
    rng, rows = random.Random(11), []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(10 ** 6)}" for _ in range(150)]
        rows.append((10 * group, " ".join(base)))
        for edits in (2, 3, 4):
            copy = list(base)
            for k in range(edits):
                copy[20 + 30 * k] = f"x{group}e{edits}k{k}"
            rows.append((10 * group + edits, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = plain_sets(rows)
    for percent in (80, 85):
        want = components_at(sets, percent)
        assert {r.doc_id: r.component_id for r in hmh.near_duplicates(docs, percent).collect()} == want
        assert (want[3] == 0) == (percent == 80)


def test_bands_follow_the_threshold():
    assert hmh.bands_for(85) == hmh.BANDS
    for percent in (80, 85, 90):
        assert (1 - (percent / 100) ** hmh.ROWS) ** hmh.bands_for(percent) <= 2e-8
