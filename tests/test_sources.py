import pytest

from rankloom.operators.rerank import coverage_scores, rerank, score_candidates, verdict
from rankloom.functions.text import token_list
from rankloom.operators.lexical import query_terms, query_weights, token_statistics
from rankloom.plans.evaluation import evaluate_encoders
from rankloom.plans import bindings as b
from rankloom.session import scratch_root
from rankloom.sources.guards import MissingInput, require_columns, require_table
from rankloom.sources.tables import POPULARITY_SCHEMA, read_csv, read_pairs, write_table
from pyspark.sql import functions as F


def test_pair_sink_round_trips_awkward_text(spark, tmp_path):
    awkward = ['plain', 'comma, "quoted"', 'line\nbreak', '  spaces  ', "tab\there", '""', "back\\slash"]
    rows = [(str(i), "q", text, 1) for i, text in enumerate(awkward)]
    pairs = spark.createDataFrame(rows, "pair_id string, query string, comment string, true_label int")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        write_table(pairs, path, fmt)
        got = read_pairs(spark, path, fmt)
        assert [r.comment for r in got.orderBy("pair_id").collect()] == awkward
        assert got.columns == pairs.columns


def test_popularity_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('comment,upvotes,true_label,topic\n"Dodge, then strike",4200,1,boss\nNice art,12,0,misc\n')
    rows = read_csv(spark, str(tmp_path / "c.csv"), POPULARITY_SCHEMA).orderBy("upvotes").collect()
    assert [(r.comment, r.upvotes) for r in rows] == [("Nice art", 12), ("Dodge, then strike", 4200)]


def test_guards(spark, tmp_path):
    with pytest.raises(MissingInput):
        require_table(spark, str(tmp_path / "none"))
    with pytest.raises(MissingInput):
        require_columns(spark.range(1), "id", "query")
    spark.range(2).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(MissingInput):
        read_pairs(spark, str(tmp_path / "bad"))


def test_scratch_follows_the_configured_folder(spark):
    root = scratch_root(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert root == scratch_root(spark) and (configured is None or root.startswith(configured.rstrip("/")))


def length_factory():
    class LengthScorer:
        name = "length"

        def score(self, questions, texts):
            return [len(q) - len(t) for q, t in zip(questions, texts)]

    return lambda: LengthScorer()


def test_plugged_in_pair_scorer_and_stable_rerank(spark):
    rows = [(1, "abc", "ab", 1), (1, "abc", "abcd", 2), (1, "abc", "a", 3), (1, "abc", "xy", 4)]
    cands = spark.createDataFrame(rows, "query_id long, query string, text string, retrieval_rank long")
    scored = score_candidates(cands, "length", length_factory(), batch_size=2)
    got = rerank(scored, 3).orderBy("rerank_rank").select("text", verdict(F.col("rerank_score"))).collect()
    # "ab" and "xy" tie and keep their retrieval order.
    assert [tuple(r) for r in got] == [("a", "RELEVANT"), ("ab", "RELEVANT"), ("xy", "RELEVANT")]
    assert rerank(scored, 0).count() == 4
    assert scored.where("text = 'abcd'").select(verdict(F.col("rerank_score"))).first()[0] == "IRRELEVANT"
    assert spark.range(1).select(verdict(F.lit(0.0))).first()[0] == "IRRELEVANT"


def test_coverage(spark):
    queries = spark.createDataFrame([(1, "red fox"), (2, "zebra"), (3, "!")], "query_id long, text string")
    corpus = spark.createDataFrame([(1, "red fox runs"), (2, "red hen"), (3, "blue")], "doc_id long, text string")
    stats = token_statistics(corpus, query_terms(queries))
    assert stats.documents == 3 and stats.mean_length == 2.0
    cands = spark.createDataFrame([(1, "red red fox"), (1, "blue"), (2, "red"), (3, "red")], "query_id long, text string")
    got = {(r.query_id, r.text): r.rerank_score for r in coverage_scores(cands, queries, stats).collect()}
    assert got == {(1, "red red fox"): 0.5, (1, "blue"): -0.5, (2, "red"): -0.5, (3, "red"): -0.5}


def test_coverage_weighs_each_shared_term(spark):
    queries = spark.createDataFrame([(1, "dog ant cat bee"), (2, None)], "query_id long, text string")
    corpus = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["ant bee", "ant cat", "ant", "dog"])], "doc_id long, text string")
    stats = token_statistics(corpus, query_terms(queries))
    idf = {r.token: r.idf for r in query_weights(queries, stats).collect()}
    texts = ["cat dog", "Dog, zebra cat cat", "bee ant dog cat", "zebra", "", None]
    cands = spark.createDataFrame([(q, t) for q in (1, 2, 3) for t in texts], "query_id long, text string")
    got = {(r.query_id, r.text): r.rerank_score for r in coverage_scores(cands, queries, stats).collect()}
    for text in texts:
        held = sum(idf[t] for t in sorted(idf) if t in set(token_list(text or "")))
        assert abs(got[1, text] - (held / sum(idf.values()) - 0.5)) < 1e-6
        assert got[2, text] == got[3, text] == -0.5


def test_offline_evaluation(spark, sf_dir):
    pairs = b.dialogue_pairs(spark, sf_dir)
    scored, records, _ = evaluate_encoders(pairs, b.ENCODERS)
    rows = {r.model: r for r in records.collect()}
    assert set(rows) == set(b.ENCODERS) and all(r.n_samples == 250 for r in rows.values())
    assert all(0 <= r[c] <= 1 for r in rows.values() for c in ("accuracy", "precision", "recall", "f1", "pr_auc", "ndcg_10"))
    assert scored.groupBy("model").count().select("count").distinct().count() == 1
