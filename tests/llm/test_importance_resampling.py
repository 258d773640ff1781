"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import importance_resampling as dsir
from tests.llm.helpers import AWKWARD, PROSE, awkward, nothing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, width):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent=10, least=20, width=1, buckets=10_000, seed=2024):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, width)[1])

    s, t = counts(x for _, x in docs), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
            for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, found = plain_features(text, width)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // max(len(found), 1)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(words)))
    able = sorted((r for r in rows if r[3] is not None and r[4] >= least), key=lambda r: (-r[3], r[0], r[1], r[4], r[2]))
    rank = {}
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        rank.setdefault(r, []).append(place)
    return Counter((*r[:4], rank[r].pop() if rank.get(r) else None) for r in rows)


def got(spark, docs, target, **options):
    return Counter(tuple(r) for r in dsir.resample(
        docs, spark.createDataFrame([(x,) for x in target], "text string"), **options).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    target = [PROSE, None, "word tail", "é"]
    assert got(spark, docs, target, percent=70, least_words=3) == plain_resample(AWKWARD, target, 70, 3)
    assert got(spark, docs, target, percent=50, least_words=1, width=2, buckets=64, seed="x") == plain_resample(
        AWKWARD, target, 50, 1, 2, 64, "x")
    assert got(spark, docs, []) == plain_resample(AWKWARD, [])
    assert got(spark, nothing(spark), target) == Counter()


def test_ties_and_repeated_rows(spark):
    rng = random.Random(3)
    words = PROSE.split()
    rows = [(rng.randrange(40), " ".join(rng.choice(words[:4]) for _ in range(rng.randrange(1, 6)))) for _ in range(300)]
    rows += [(7, PROSE)] * 200
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(spark, docs, [PROSE], percent=60, least_words=2) == plain_resample(rows, [PROSE], 60, 2)


def test_crc_matrices():
    rng = np.random.default_rng(1)
    features = [rng.bytes(n) for n in (0, 1, 2, 3, 3, 8, 8, 1, 40, 40, dsir.MATRIX_BYTES, dsir.MATRIX_BYTES + 1, 5000)]
    assert dsir.crc_values(features).tolist() == [zlib.crc32(f) for f in features]
    assert dsir.crc_values([]).tolist() == []


def test_draw_leans_to_the_target(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    french = docs.where("lang = 'fr'").select("text")
    drawn = dsir.resample(docs, french, percent=20).where(F.col("rank").isNotNull()).join(docs, "doc_id")
    share = drawn.agg(F.avg((F.col("lang") == "fr").cast("double"))).first()[0]
    assert share > 2 * docs.agg(F.avg((F.col("lang") == "fr").cast("double"))).first()[0]
