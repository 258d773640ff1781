import tracemalloc

import pyarrow as pa

from rankloom.functions.text import TOKEN, token_list
from rankloom.operators import encode
from rankloom.operators.compare import score_question
from rankloom.operators.encode import Batching, HashingEncoder, score_pairs_by_models, with_pair_keys
from rankloom.operators.splits import leaked_pairs

ENCODERS = {"a": lambda: HashingEncoder(8), "b": lambda: HashingEncoder(4)}


def test_a_batch_of_long_texts_is_not_held_as_strings(monkeypatch):
    monkeypatch.setattr(encode, "CHARS_AT_ONCE", 100_000)
    column = pa.array([f"word{i % 7} élan " * 2_000 for i in range(400)] + [None])
    column.slice(0, 1).to_pylist()
    tracemalloc.start()
    vectors, = encode._encode_batch([HashingEncoder(8)], column, Batching(4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000  # the texts are 10 million characters, 20 MB as strings
    assert vectors.to_pylist()[400] == [0.0] * 8 and vectors.to_pylist()[0] == vectors.to_pylist()[7]


def test_known_buckets_are_bounded(monkeypatch):
    monkeypatch.setattr(encode, "BUCKETS_KEPT", 3)
    small, whole = HashingEncoder(8), HashingEncoder(8)
    text = " ".join(f"w{i}" for i in range(50))
    found = small.encode([text, "", text])
    assert len(small._buckets) <= 3
    monkeypatch.undo()
    assert (found == whole.encode([text, "", text])).all() and len(whole._buckets) == 50


def test_tokens_are_those_of_the_rule():
    text = "Ab_c déjà² İx 中文 a b--3.5\x1f!"
    assert token_list(text) == TOKEN.findall(text.lower()) and token_list("") == token_list(" _") == []


def test_stored_keys_give_the_same_scores(spark):
    pairs = spark.createDataFrame(
        [("p1", "x y", "y z"), ("p2", "x y", "x y"), ("p3", None, "x"), ("p4", "q", None), ("p5", "", "x")],
        "pair_id string, query string, comment string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = rows(score_pairs_by_models(pairs, ENCODERS, 6, keep=["pair_id"]))
    assert rows(score_pairs_by_models(with_pair_keys(pairs), ENCODERS, 6, keep=["pair_id"])) == plain
    assert [r for r in plain if r[1] == "a"][:2] == [("p1", "a", 0.5), ("p2", "a", 1.0)] and len(plain) == 6
    assert score_pairs_by_models(with_pair_keys(pairs), ENCODERS).columns == [*pairs.columns, "model", "score"]


def test_question_scores_carry_what_is_kept(spark):
    comments = spark.createDataFrame([("p1", "x y", 1), ("p2", None, 0)], "pair_id string, comment string, true_label int")
    scored = score_question(comments, "x", "y", ENCODERS, keep=["pair_id", "true_label"])
    assert scored.columns == ["pair_id", "true_label", "model", "score"]
    assert "comment" not in scored._jdf.queryExecution().optimizedPlan().output().toString()
    whole = {(r.pair_id, r.model): r.score for r in score_question(comments, "x", "y", ENCODERS).collect()}
    assert {(r.pair_id, r.model): r.score for r in scored.collect()} == whole and len(whole) == 4


def test_only_pairs_of_test_and_validation_are_grouped(spark):
    rows = [("q", "c", "train"), ("q", "c", "test"), ("q", None, "val"), ("q", None, "train"), (None, "c", "test"),
            (None, "c", "test"), ("q", "d", "train"), ("q", "d", "train"), ("x", "c", None), ("x", "c", "val"),
            ("q", "c", "val"), ("w", "w", "val"), (None, None, "train")]
    df = spark.createDataFrame(rows, "query string, comment string, split string")
    found = leaked_pairs(df)
    want = {("q", "c", 3, 3), ("q", None, 2, 2), ("x", "c", 2, 2)}
    assert {tuple(r) for r in found.collect()} == want
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
