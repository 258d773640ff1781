import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.operators.splits import (
    create_group_splits, create_splits, fallback_sizes, largest_remainders, leaked_pairs, split_summary, stratifiable,
    stratified_sizes)
from rankloom.sources.guards import MissingInput


def table(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "k long, true_label int")


def sizes(df):
    return Counter((r.split, r.true_label) for r in df.collect())


def plain_quotas(counts, size):
    total = sum(counts.values())
    share = {c: size * n // total for c, n in counts.items()}
    order = sorted(counts, key=lambda c: (-((size * counts[c]) % total), c))
    for c in order[:size - sum(share.values())]:
        share[c] += 1
    return share


@pytest.mark.parametrize("counts,size", [
    ({"0": 571, "1": 3409}, 250), ({"a": 1, "b": 1, "c": 1}, 2), ({"a": 3, "b": 7, "c": 20}, 17), ({"a": 9}, 4),
    ({f"k{i:03d}": 1 + i * i % 7 for i in range(300)}, 411)])
def test_quotas_are_exact(spark, counts, size):
    strata = spark.createDataFrame(list(counts.items()), "stratum string, n long")
    got = {r.stratum: r["take"] for r in largest_remainders(strata, size, "take").collect()}
    assert got == plain_quotas(counts, size) and sum(got.values()) == size


def test_very_many_labels(spark):
    """100,000 strata: quotas, limits and hashes stay relations."""
    df = spark.range(300_000, numPartitions=4).select(
        F.col("id").alias("k"), F.when(F.col("id") < 100_000, F.lit(0)).otherwise(F.col("id") % 100_000).alias("true_label"))
    got = create_splits(df, "k", 100_000, 100_000)
    sizes = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert sizes == {"test": 100_000, "val": 100_000, "train": 100_000}
    hot = {r.split: r["count"] for r in got.where("true_label = 0").groupBy("split").count().collect()}
    assert all(abs(n - 100_002 / 3) <= 1 for n in hot.values())


def plain_group_split(rows, n_test, n_val):
    """rows (key, group, label): whole groups in hash order, each where its first row falls."""
    label = {}
    for _, g, y in rows:
        label[g] = min(label.get(g, y), y)
    size = Counter(g for _, g, _ in rows)
    counts = Counter(f"v{label[g]}" for _, g, _ in rows)
    test = plain_quotas(counts, n_test)
    val = plain_quotas({c: n - test[c] for c, n in counts.items()}, n_val)
    out, start = {}, Counter()
    for g in sorted(size, key=lambda g: (hashlib.md5(f"42:{named(g)}".encode()).hexdigest(), named(g))):
        c = f"v{label[g]}"
        out[g] = "test" if start[c] < test[c] else "val" if start[c] < test[c] + val[c] else "train"
        start[c] += size[g]
    return {k: out[g] for k, g, _ in rows}


def named(group):
    return hashlib.md5(("v" + group).encode()).hexdigest()


def test_groups_stay_together(spark):
    rng = random.Random(6)
    rows = [(i, f"g{min(rng.randrange(150), rng.randrange(150))}", rng.randrange(3)) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, g string, true_label int")
    got = create_group_splits(df.repartition(5), ["g"], 200, 100)
    assert {r.k: r.split for r in got.collect()} == plain_group_split(rows, 200, 100)
    assert got.columns == ["k", "g", "true_label", "split"]
    assert got.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    largest = max(Counter(g for _, g, _ in rows).values())
    sizes = Counter(r.split for r in got.collect())
    assert 200 <= sizes["test"] < 200 + 3 * largest


def test_equal_pairs_do_not_leak(spark):
    rows = [("q", "same", 1)] * 20 + [("q", f"c{i}", 0) for i in range(20)] + [(None, "x", 1), (None, "x", 0), ("", "x", None)]
    df = spark.createDataFrame(rows, "query string, comment string, true_label int")
    parts = create_group_splits(df, ["query", "comment"], 10, 10)
    assert parts.count() == len(rows) and leaked_pairs(parts).count() == 0
    one = create_group_splits(df.where("true_label = 0"), ["query", "comment"], 5, 5)
    assert Counter(r.split for r in one.collect()) == {"test": 5, "val": 5, "train": 11}
    assert create_group_splits(df.where("false"), ["query"]).count() == 0


def test_sizes_of_counts_and_shares():
    assert stratified_sizes(1000, 2, 250, 250) == (250, 250)
    assert stratified_sizes(1000, 2, 0.2, 0.1) == (200, 100)
    assert fallback_sizes(1000, 250, 250) == (250, 250)
    assert fallback_sizes(100, 250, 250) == (20, 10)
    assert fallback_sizes(2, 250, 250) == (1, 1)
    with pytest.raises(ValueError):
        stratified_sizes(400, 2, 250, 250)


def test_stratified_split_is_exact_and_keeps_every_row(spark):
    df = table(spark, [int(i % 5 == 0) for i in range(1000)])
    got = create_splits(df, "k", 250, 250)
    assert sizes(got) == {("test", 1): 50, ("test", 0): 200, ("val", 1): 50, ("val", 0): 200,
                          ("train", 1): 100, ("train", 0): 400}
    assert got.select("k").distinct().count() == 1000


def test_split_ignores_partitioning_and_follows_the_seed(spark):
    df = table(spark, [i % 2 for i in range(200)])
    first = {r.k: r.split for r in create_splits(df, "k", 0.2, 0.2).collect()}
    again = {r.k: r.split for r in create_splits(df.repartition(13), "k", 0.2, 0.2).collect()}
    other = {r.k: r.split for r in create_splits(df, "k", 0.2, 0.2, seed=7).collect()}
    assert first == again != other


@pytest.mark.parametrize("labels", [[1] * 40, [1] * 39 + [0], [1] * 39 + [None]])
def test_fallback_without_strata(spark, labels):
    assert not stratifiable(Counter(labels))
    got = Counter(r.split for r in create_splits(table(spark, labels), "k", 10, 5).collect())
    assert got == {"test": 10, "val": 5, "train": 25}


def test_null_label_is_a_stratum(spark):
    got = sizes(create_splits(table(spark, [1] * 20 + [None] * 20), "k", 10, 10))
    assert got[("test", None)] == got[("test", 1)] == 5


@pytest.mark.parametrize("rows", [1, 2, 3])
def test_tiny_tables_keep_all_rows(spark, rows):
    got = create_splits(table(spark, [1] * rows), "k")
    assert got.count() == rows


def test_missing_label(spark):
    with pytest.raises(MissingInput):
        create_splits(spark.range(3), "id")


def test_summary_and_leaks(spark):
    rows = [("q", "same", 1)] * 20 + [("q", f"c{i}", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "query string, comment string, true_label int").withColumn(
        "k", F.monotonically_increasing_id().cast("string"))
    parts = create_splits(df, "k", 10, 10)
    summary = {r.split: r for r in split_summary(parts).collect()}
    assert summary["test"].rows == 10 and summary["test"].positive_rate == 0.5
    assert [(r.comment, r.copies) for r in leaked_pairs(parts).collect()] == [("same", 20)]


def test_assignment_does_not_shuffle_the_rows(spark):
    plan = create_splits(table(spark, [0, 1] * 50), "k", 10, 10)._jdf.queryExecution().toString()
    assert not re.search("Exchange (hash|range|single|Round)|SinglePartition|Window", plan) and "BroadcastHashJoin" in plan
