"""Periodic runs against an enumeration of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from rankloom.llm import periodic_runs as runs
from rankloom.llm.catalog import op12_periodic_runs
from tests.llm.helpers import awkward, nothing, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """(start, length, period) by checking every period at every place."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            end = start + q
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            if end - start >= max(6, 4 * q):
                found.setdefault((start, end - start), q)
            start = end - q + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plain_row(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    words = planted(doc_id, words) if plant else words
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def key(row):
    return tuple((x is None, x) if x is not None else (True, 0) for x in row)


def test_query_equals_plain_version(spark, sf_dir):
    got = [tuple(r) for r in op12_periodic_runs(spark, sf_dir).collect()]
    want = [plain_row(*r) for r in rows_of(sf_dir)]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in got) > 10


def test_awkward_rows(spark):
    docs = awkward(spark)
    raw = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    short = [r for r in raw if r[0] != 12]
    got = [tuple(r) for r in runs.run_digests(runs.plant_tails(docs)).collect()]
    assert sorted([r for r in got if r[0] != 12], key=key) == sorted([plain_row(*r) for r in short], key=key)
    long = next(r for r in got if r[0] == 12)
    assert long[1] >= 1
    found = [tuple(r) for r in runs.run_digests(docs).collect()]
    assert (12, 1, 0, 30000, 1, 30000000) == next(r for r in found if r[0] == 12)[:6]
    assert sorted([r for r in found if r[0] != 12], key=key) == sorted([plain_row(*r, False) for r in short], key=key)
    assert runs.run_digests(runs.plant_tails(nothing(spark))).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_words(letters):
    rng = random.Random(letters)
    for _ in range(150):
        words = [rng.randrange(letters) for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(words)), rng.randrange(1, 9)
            words[at:at] = (words[at:at + p] or [0]) * rng.randrange(2, 8)
        got = [(s, e - s, q) for s, e, q in runs.runs_of(np.array(words, np.int64), len(words)).tolist()]
        assert sorted(got) == plain_runs(words)


def test_texts_of_a_chunk_do_not_touch():
    texts = [["a"] * 5, ["a"] * 9, [], ["b", "a"] * 6, ["a"] * 3]
    got = [r.tolist() for r in runs._chunk_runs(texts)]
    assert got == [[], [[0, 9, 1]], [], [[0, 12, 2]], []]


def test_common_extensions():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 40):
        words = rng.integers(0, letters, 300)
        tool = runs.CommonExtensions(words)
        i, j = rng.integers(0, 301, (2, 4000))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            n = 0
            while max(a, b) + n < 300 and words[a + n] == words[b + n]:
                n += 1
            want.append(n)
        assert tool.between(i, j).tolist() == want


def test_cover_meets_every_distance():
    v = runs.COVER_STEP
    assert {(a - b) % v for a in runs.COVER for b in runs.COVER} == set(range(v))
