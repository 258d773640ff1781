"""Near-duplicate documents against all pairs."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import hyperminhash as hmh
from rankloom.llm.components import components
from tests.llm.helpers import PROSE, awkward, documents, nothing


def plain_sets(rows):
    found = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        found[doc_id] = frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    return found


def plain_components(sets, percent=85):
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = defaultdict(int)
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def check(docs, rows, percent=85):
    sets = plain_sets(rows)
    want = plain_components(sets, percent)
    got = hmh.near_duplicates(docs, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(
        (d, len(sets[d]), want[d], want[d] == d) for d, _ in rows)


def test_equals_all_pairs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    check(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_large_groups_of_copies(spark):
    """One star of edits around a base, chains of edits, short texts, exact copies."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, base = [], [rng.choice(words) for _ in range(150)]
    for i in range(120):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
            copy[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(200, 240):
        chain = list(chain)
        chain[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 6, 30])))) for i in range(300, 340)]
    rows += [(i, rows[i % 50][1]) for i in range(400, 460)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def edited(rng, base, edits, words):
    copy = list(base)
    for _ in range(edits):
        copy[rng.randrange(len(copy))] = rng.choice(words)
    return copy


def test_large_groups_below_and_around_the_threshold(spark, monkeypatch):
    """Many plausible pairs, few of them links, in tiles of few documents; small and large buckets give the same."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for group in range(3):
        base = [rng.choice(words) for _ in range(120)]
        rows += [(1000 * group + i, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4]), words))) for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(hmh, "TILE_BYTES", 30 * hmh.REGISTERS)
    monkeypatch.setattr(hmh, "SET_TILE_BYTES", 50_000)
    for small, percent in ((0, 80), (10 ** 6, 80), (5, 85)):
        monkeypatch.setattr(hmh, "SMALL_BUCKET", small)
        check(docs, rows, percent)


def test_links_stay_few_in_a_large_group(spark):
    """1,200 near copies of 120 words: the pairs are hundreds of thousands, the links at most two a document."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, 4, words))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    count = hmh.bands_for(80) * hmh.ROWS
    signs = hmh.signatures(docs, count).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands")
    signs = hmh.materialize(signs.dropDuplicates(["n", "bands"]), "registers")
    families = hmh.family_links(signs, 80, count)
    assert sum(t.count() for t in families.tables) <= 2 * len(rows)
    exact = hmh.exact_links(docs, signs, families, 80, count)
    assert sum(t.count() for t in exact.tables) <= 2 * len(rows)
    sets = plain_sets(rows)
    for t in exact.tables:
        assert all(100 * len(sets[r.a] & sets[r.b]) >= 80 * len(sets[r.a] | sets[r.b]) for r in t.collect())


def test_sets_are_joined_once_a_document(spark):
    """Registers alone meet buckets; a full set meets its family, in one row per block."""
    columns = []
    tiles = hmh._tiles
    try:
        hmh._tiles = lambda rows, *rest: columns.append((rows.columns, rows.count(), rows.select(
            "id").distinct().count())) or tiles(rows, *rest)
        rng = random.Random(4)
        words = [f"w{i}" for i in range(4000)]
        base = [rng.choice(words) for _ in range(120)]
        rows = [(i, " ".join(edited(rng, base, 4, words))) for i in range(200)]
        check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, 80)
    finally:
        hmh._tiles = tiles
    with_sets = [c for c in columns if "shingles" in c[0]]
    assert len(with_sets) == 1 and with_sets[0][1] == with_sets[0][2] <= 200


def test_no_pair_of_short_texts_is_missed():
    """Pairs of few shingles at or just above the threshold: the bands of such texts repeat the same hashes."""
    rng = np.random.default_rng(3)
    missed = 0
    for percent in (80, 85):
        count = hmh.bands_for(percent) * hmh.ROWS
        for _ in range(1500):
            size = int(rng.integers(6, 61))
            same = -(-percent * size // 100)
            pool = np.unique(rng.integers(0, 2 ** 63, 2 * size + 9).astype(np.uint64))
            a, b = np.sort(pool[:size]), np.sort(pool[:same])
            if not hmh.linked(a, b, percent):
                continue
            ra, rb = hmh.registers(a, count), hmh.registers(b, count)
            cells = hmh.cell_chances(np.array([len(a), len(b)]), count)
            good = hmh.estimates((ra == rb).mean(), cells[0] @ cells[1], np.array(len(a)), np.array(len(b)), percent,
                                 count)[1]
            missed += not (good and (ra.view(np.int64) == rb.view(np.int64)).any())
    assert missed == 0


def test_awkward_rows(spark):
    got = hmh.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(awkward(spark).collect())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.component_id for r in by[4]] == [4, 4] and by[5][0].component_id == 4 and not by[5][0].kept
    assert all(r.component_id is None and r.kept for r in by[None])
    assert by[1][0].n_shingles == by[2][0].n_shingles == by[3][0].n_shingles == 0 and by[3][0].component_id == 3
    assert hmh.near_duplicates(nothing(spark)).count() == 0
    stay = hmh.first_of_groups(awkward(spark))
    assert stay.columns == awkward(spark).columns
    ids = [r.doc_id for r in stay.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(None) == 2
    assert hmh.first_of_groups(nothing(spark)).count() == 0


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    for size in (12, 100, 1000, 20000):
        for share in (0.85, 0.5, 0.0):
            pool = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
            n_same = int(2 * share * size / (1 + share))
            a, b = np.unique(pool[:size]), np.unique(np.concatenate((pool[:n_same], pool[size:2 * size - n_same])))
            cells = hmh.cell_chances(np.array([len(a), len(b)]))
            same = (hmh.registers(a) == hmh.registers(b)).mean()
            found, good = hmh.estimates(same, cells[0] @ cells[1], np.array(len(a)), np.array(len(b)))
            true = n_same / (2 * size - n_same)
            assert abs(found - true) < 6 * max(0.02, 0.5 / np.sqrt(min(size / 2, 448)))
            assert good or share < 0.8


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(100, 400)] + [(7, 7), (3, 9), (9, 5), (5, 3)]
    links = spark.createDataFrame(rows, "a bigint, b bigint").orderBy(F.rand(3))
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {3: 3, 9: 3, 5: 3}
    assert components(links.where("false")).count() == 0


def test_prose_fixture_is_one_class(spark):
    rows = [(i, PROSE.upper() if i % 2 else PROSE) for i in range(1, 40)]
    got = hmh.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {1} and sum(r.kept for r in got) == 1
