from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.operators.pairs import (
    balanced_pairs, foreign_candidates, generic_negatives, hard_negatives, paraphrases)
from rankloom.operators.sampling import distinct_positions, sample_per_group

COLUMNS = "query_id string, query string, grp string, answer_id string, answer string"


@pytest.fixture(scope="module")
def catalogue(spark):
    # Group "hot" holds most answers.
    rows = [(f"q{q}", f"question {q}", "hot" if q < 6 else f"g{q}", f"a{q}-{i}", f"answer {q} {i}")
            for q in range(9) for i in range(10)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame([(i, f"generic {i}") for i in range(5)], "pool_id long, text string")


def test_shape_of_a_balanced_set(catalogue, pool):
    pairs = balanced_pairs(catalogue, pool)
    rows = pairs.collect()
    assert Counter(r.branch for r in rows) == {"positive": 90, "paraphrase": 135, "hard": 72, "generic": 153}
    per_query = Counter((r.query_id, r.true_label) for r in rows)
    assert set(per_query.values()) == {25}
    assert len({r.pair_id for r in rows}) == len(rows)


def test_hard_negatives_are_foreign_and_different(catalogue):
    group = {f"q{q}": "hot" if q < 6 else f"g{q}" for q in range(9)}
    owner = {f"a{q}-{i}": f"q{q}" for q in range(9) for i in range(10)}
    got = defaultdict(list)
    for r in hard_negatives(catalogue).collect():
        assert group[r.query_id] != group[owner[r.answer_id]]
        got[r.query_id].append(r.answer_id)
    assert all(len(set(a)) == 8 for a in got.values()) and len(got) == 9


def test_few_foreign_answers_are_all_taken(spark):
    rows = [("q1", "x", "a", "a1", "one"), ("q2", "y", "b", "b1", "two"), ("q2", "y", "b", "b2", "three")]
    got = Counter(r.query_id for r in hard_negatives(spark.createDataFrame(rows, COLUMNS)).collect())
    assert got == {"q1": 2, "q2": 1}


def test_one_group_has_no_hard_negatives(spark):
    only = spark.createDataFrame([("q1", "x", "a", "a1", "one")], COLUMNS)
    assert hard_negatives(only).count() == 0


def test_candidates_are_counted(catalogue):
    got = {r.query_id: r.candidates for r in foreign_candidates(catalogue).collect()}
    assert got["q0"] == 30 and got["q8"] == 80


def test_paraphrases_use_own_answers_and_cycle_templates(catalogue):
    for r in paraphrases(catalogue, 4, ["<{base}>", "[{base}]"]).collect():
        left, right = ("<", ">") if r.i % 2 == 0 else ("[", "]")
        assert r.comment == f"{left}answer {r.query_id[1:]} {r.answer_id.split('-')[1]}{right}"


def test_generic_draws_with_replacement(catalogue, pool):
    queries = catalogue.select("query_id", "query").distinct()
    got = generic_negatives(queries, pool, 17).collect()
    assert len(got) == 9 * 17 and {r.pool_id for r in got} == set(range(5))
    with pytest.raises(ValueError):
        generic_negatives(queries, pool.limit(0))


def test_result_ignores_partitioning(catalogue, pool):
    first = {r.pair_id: r.comment for r in balanced_pairs(catalogue, pool).collect()}
    again = {r.pair_id: r.comment for r in balanced_pairs(catalogue.repartition(11), pool.repartition(3)).collect()}
    assert first == again


def test_positions_are_uniform(spark):
    df = spark.range(4000).select(F.explode(distinct_positions(
        F.col("id").cast("string"), 3, F.lit(6), "test")).alias("p"), "id")
    assert df.groupBy("id").agg(F.count_distinct("p").alias("n")).where("n <> 3").count() == 0
    counts = {r.p: r["count"] for r in df.groupBy("p").count().collect()}
    assert set(counts) == set(range(6))
    assert all(abs(c - 2000) < 200 for c in counts.values())


def test_sample_per_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 990, "hot").otherwise("rare").alias("g"), "id")
    got = Counter(r.g for r in sample_per_group(df, "g", "id", 20).collect())
    assert got == {"hot": 20, "rare": 10}
