import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.operators import curves
from rankloom.operators.ordering import next_values, number_rows, running_by_hash, running_totals, seeded_shuffle
from rankloom.session import materialize


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [("hot" if rng.random() < 0.7 else f"g{rng.randrange(4)}", f"k{i}") for i in range(400)]


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_positions_equal_a_plain_sort(spark, rows, buckets):
    df = spark.createDataFrame(rows, "g string, k string")
    got = {r.k: r.position for r in number_rows(df, "k", ("g",), buckets=buckets).collect()}
    groups = defaultdict(list)
    for g, k in rows:
        groups[g].append(k)
    for keys in groups.values():
        for i, k in enumerate(sorted(keys, key=lambda k: md5(f"42:{k}"))):
            assert got[k] == i
    whole = {r.k: r.position for r in number_rows(df, "k", buckets=buckets).collect()}
    assert [k for k, _ in sorted(whole.items(), key=lambda x: x[1])] == [
        r.k for r in seeded_shuffle(df, "k").collect()]


@pytest.mark.parametrize("buckets", [None, 1, 5, 50])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_equal_a_plain_sum(spark, buckets, descending):
    rng = random.Random(5)
    # Most scores sit close together, so equal-width buckets would be lopsided.
    values = {("m", rng.random() ** 8): rng.randrange(9) for _ in range(300)}
    values |= {("n", 0.5): 2}
    df = materialize(spark.createDataFrame(
        [(m, s, v) for (m, s), v in values.items()], "model string, score double, v long"))
    got = {(r.model, r.score): r.run_v for r in running_totals(
        df, "score", ["v"], ("model",), descending, buckets).collect()}
    for (m, s) in values:
        total = sum(v for (m2, s2), v in values.items()
                    if m2 == m and (s2 >= s if descending else s2 <= s))
        assert got[(m, s)] == total


def test_running_by_hash_covers_every_row_once(spark):
    df = spark.range(50).select(F.col("id").alias("g"), (F.col("id") % 5 + 1).alias("size"))
    ends = sorted((r.run_size - r.size, r.run_size) for r in running_by_hash(df, "g", ["size"]).collect())
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_next_values_across_buckets(spark):
    """The same with a plain window and with any buckets, empty ones and groups of one row included."""
    rows = [(g, float(i * i % 97) if g else 3.0, i) for g in (0, 1, 2, None) for i in range(1 if g == 0 else 60)]
    rows = list({(g, s): (g, s, i) for g, s, i in rows}.values())
    table = materialize(spark.createDataFrame(rows, "g int, score double, n long"), "rows")
    for descending in (True, False):
        want = {}
        for g in (0, 1, 2, None):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending)
            want |= {(g, a[1]): b[2] if b else None for a, b in zip(mine, [*mine[1:], None], strict=True)}
        for buckets in (None, 1, 4, 300):
            got = next_values(table, "score", ["n"], ("g",), descending, buckets)
            assert {(r.g, r.score): r.next_n for r in got.collect()} == want


def test_thinned_curve_keeps_the_area(spark):
    rng = random.Random(4)
    rows = [("a" if i % 3 else "b", int(rng.random() < 0.4), rng.randrange(60) / 60 if i % 2 else rng.random())
            for i in range(500)] + [("c", 1, 0.5), ("c", 0, 0.5)]
    scored = spark.createDataFrame(rows, "model string, true_label int, score double")
    whole = curves.roc_curve(scored, ("model",)).collect()
    areas = {r.model: r.roc_auc for r in curves.auc(scored, ("model",)).collect()}
    for buckets in (None, 7):
        thin = curves.roc_curve_thinned(scored, ("model",), buckets).collect()
        assert {tuple(r) for r in thin} < {tuple(r) for r in whole}
        for model, area in areas.items():
            points = [(0.0, 0.0)] + sorted((r.fpr, r.tpr) for r in thin if r.model == model)
            got = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False))
            assert abs(got - area) < 1e-12
