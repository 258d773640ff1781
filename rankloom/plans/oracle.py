"""The registered queries as SQL for an independent engine, over the same tables."""

from __future__ import annotations

import re

from rankloom.operators.pairs import GENERIC_NEGATIVES, HARD_NEGATIVES, PARAPHRASES, TEMPLATES
from rankloom.operators.threshold import REPORT_GRID, SWEEP, grid
from rankloom.plans.catalog import (
    JUDGED_THRESHOLD, KEEP, NEIGHBOURS, PAIR_THRESHOLD, PROBES, RETRIEVE)

STRONG, WEAK = 64, 16


def tokens(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def draw(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::UBIGINT)::BIGINT"


def order(key: str) -> str:
    return f"md5('42:' || {key}), {key}"


def r6(value: str) -> str:
    return f"round(({value})::DOUBLE, 6) + 0.0"


def r3(value: str) -> str:
    return f"round(({value})::DOUBLE, 3) + 0.0"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def vectors(name: str, texts: str, dim: int) -> str:
    """CTEs ending in ``name(text, v)``: dense unit vectors of the distinct ``texts``."""
    return f"""
{name}_base AS (SELECT DISTINCT text FROM ({texts})),
{name}_tok AS (SELECT text, unnest({tokens('text')}) AS t FROM {name}_base),
{name}_cnt AS (SELECT text, (('0x' || substr(md5(t), 1, 8))::UBIGINT % {dim})::BIGINT AS b,
               count(*)::DOUBLE AS c FROM {name}_tok GROUP BY ALL),
{name}_nrm AS (SELECT text, sqrt(sum(c * c)) AS n FROM {name}_cnt GROUP BY text),
{name} AS (SELECT text, list(x ORDER BY b) AS v FROM (
  SELECT s.text, g.b, coalesce(c.c / n.n, 0)::FLOAT::DOUBLE AS x
  FROM {name}_base s CROSS JOIN range({dim}) g(b)
  LEFT JOIN {name}_cnt c ON c.text = s.text AND c.b = g.b
  LEFT JOIN {name}_nrm n ON n.text = s.text) GROUP BY text)"""


def exploded(source: str, key: str, vector: str = "v") -> str:
    return (f"SELECT {key}, i::BIGINT AS i, {r6('x')} AS x FROM (SELECT {key}, unnest({vector}) AS x, "
            f"generate_subscripts({vector}, 1) - 1 AS i FROM {source})")


def key_of(dim: int, text: str = "text") -> str:
    return f"md5('hash{dim}::' || {text})"


JUDGED = f"""
judged AS (SELECT d.doc_id::VARCHAR AS pair_id, d.source AS query, d.text AS comment,
  l.quality AS true_label, d.n_chars AS upvotes,
  round(coalesce(len(list_distinct({tokens('d.text')}))::DOUBLE / nullif(len({tokens('d.text')}), 0), 0), 6) AS score
  FROM documents d JOIN labels l USING (doc_id))"""

CATALOGUE = """
catalogue AS (SELECT u.conv_id AS grp, u.conv_id || '-' || u.turn AS query_id, u.text AS query,
  a.conv_id || '-' || a.turn AS answer_id, a.text AS answer
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
dimension AS (SELECT query_id, query, grp, count(*) AS answers FROM catalogue GROUP BY ALL)"""

def template(i: str) -> str:
    listed = ", ".join(quote(t) for t in TEMPLATES)
    return f"replace(list_extract([{listed}], ({i} % {len(TEMPLATES)})::INT + 1), '{{base}}', answer)"


PARAPHRASED = f"""
numbered AS (SELECT query_id, answer_id, answer, row_number() OVER (
  PARTITION BY query_id ORDER BY {order('answer_id')}) - 1 AS position FROM catalogue),
base_draw AS (SELECT query_id, query, i, {draw("'42'", "'base'", 'query_id', 'i')} % answers AS position
  FROM dimension CROSS JOIN range({PARAPHRASES}) g(i)),
paraphrased AS (SELECT query_id, d.query, d.i, answer_id, {template('d.i')} AS comment
  FROM base_draw d JOIN numbered USING (query_id, position))"""


def _hard() -> str:
    step = "hard_0"
    ctes = [f"""
ranges AS (SELECT grp, n AS group_size, (sum(n) OVER (ORDER BY {order('grp::VARCHAR')}) - n)::BIGINT AS group_start
  FROM (SELECT grp, count(*) AS n FROM catalogue GROUP BY grp)),
pool AS (SELECT answer_id, answer, group_start + row_number() OVER (
  PARTITION BY c.grp ORDER BY {order('answer_id')}) - 1 AS position FROM catalogue c JOIN ranges r ON r.grp = c.grp),
hard_0 AS (SELECT query_id, query, group_start, group_size, []::BIGINT[] AS taken,
  ((SELECT count(*) FROM catalogue) - group_size)::BIGINT AS outside FROM dimension JOIN ranges USING (grp))"""]
    for i in range(HARD_NEGATIVES):
        bound = f"(outside - least({HARD_NEGATIVES}, outside) + {i})"
        pick = f"({draw(quote('42'), quote('hard'), 'query_id', quote(str(i)))} % ({bound} + 1))"
        ctes.append(f"""hard_{i + 1} AS (SELECT query_id, query, group_start, group_size,
  CASE WHEN {i} >= outside THEN taken
       WHEN list_contains(taken, {pick}) THEN list_append(taken, {bound})
       ELSE list_append(taken, {pick}) END AS taken, outside FROM {step})""")
        step = f"hard_{i + 1}"
    ctes.append(f"""hard_pick AS (SELECT query_id, query, group_start, group_size, unnest(taken) AS pick,
  generate_subscripts(taken, 1) - 1 AS i FROM {step}),
hard AS (SELECT query_id, query, i::BIGINT AS i, answer_id, answer AS comment FROM hard_pick
  JOIN pool ON position = CASE WHEN pick < group_start THEN pick ELSE pick + group_size END)""")
    return ",\n".join(ctes)


HARD = _hard()
GENERIC = f"""
generic_pool AS (SELECT item_id AS pool_id, text,
  row_number() OVER (ORDER BY {order('item_id::VARCHAR')}) - 1 AS position FROM benchmark),
generic AS (SELECT query_id, query, i, pool_id, text AS comment FROM (
  SELECT query_id, query, i, {draw("'42'", "'generic'", 'query_id', 'i')} % (SELECT count(*) FROM benchmark) AS position
  FROM dimension CROSS JOIN range({GENERIC_NEGATIVES}) g(i)) JOIN generic_pool USING (position))"""

PAIRS = ",".join([CATALOGUE, PARAPHRASED, HARD, GENERIC]) + """,
pairs AS (
  SELECT query_id || '/positive/' || answer_id AS pair_id, query_id, query, answer AS comment,
    1 AS true_label, 'positive' AS branch FROM catalogue
  UNION ALL SELECT query_id || '/paraphrase/' || i, query_id, query, comment, 1, 'paraphrase' FROM paraphrased
  UNION ALL SELECT query_id || '/hard/' || i, query_id, query, comment, 0, 'hard' FROM hard
  UNION ALL SELECT query_id || '/generic/' || i, query_id, query, comment, 0, 'generic' FROM generic)"""


def _scores(dim: int) -> str:
    return vectors(f"vec{dim}", "SELECT query AS text FROM pairs UNION ALL SELECT comment FROM pairs", dim) + f""",
scored{dim} AS (SELECT p.*, 'hash{dim}' AS model, round(list_inner_product(q.v, c.v), 6) + 0.0 AS score
  FROM pairs p JOIN vec{dim} q ON q.text = p.query JOIN vec{dim} c ON c.text = p.comment)"""


SCORED = PAIRS + "," + _scores(STRONG) + ", scored AS (SELECT * FROM scored64)"
BOTH = PAIRS + "," + _scores(STRONG) + "," + _scores(WEAK) + """,
scored AS (SELECT * FROM scored64 UNION ALL SELECT * FROM scored16)"""


def ratio(top: str, bottom: str, empty: str = "0") -> str:
    return f"coalesce(({top})::DOUBLE / nullif(({bottom})::DOUBLE, 0), {empty})"


ACCURACY = ratio("tp + tn", "tp + fp + fn + tn")
PRECISION = ratio("tp", "tp + fp")
RECALL = ratio("tp", "tp + fn")
F1 = ratio("2 * tp", "2 * tp + fp + fn")


def rates(round_: str = "6") -> str:
    f = r6 if round_ == "6" else r3
    return (f"{f(ACCURACY)} AS accuracy, {f(PRECISION)} AS precision, {f(RECALL)} AS recall, {f(F1)} AS f1")


def counts(limit: str, score: str = "score") -> str:
    return (f"count(*) FILTER (true_label = 1 AND {score} >= {limit}) AS tp, "
            f"count(*) FILTER (true_label <> 1 AND {score} >= {limit}) AS fp, "
            f"count(*) FILTER (true_label = 1 AND {score} < {limit}) AS fn, "
            f"count(*) FILTER (true_label <> 1 AND {score} < {limit}) AS tn")


def sweep(source: str, values: list[float], by: str = "") -> str:
    """CTE ``swept``: one naive pass per grid value."""
    keys = f"{by}, " if by else ""
    listed = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(values))
    return f"""
grid(t_idx, threshold) AS (VALUES {listed}),
swept AS (SELECT {keys}t_idx::BIGINT AS t_idx, threshold, {counts('threshold')}
  FROM {source} CROSS JOIN grid GROUP BY ALL),
swept_rates AS (SELECT *, {ACCURACY} AS accuracy, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1 FROM swept),
best AS (SELECT * FROM (SELECT *, row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY f1 DESC, t_idx) AS pos
  FROM swept_rates) WHERE pos = 1)"""


SWEEP_VALUES = grid(*SWEEP)


def curve(source: str, by: str = "'-'", name: str = "curve") -> str:
    """CTE with one row per (model, score): running and total counts."""
    return f"""
{name}_ties AS (SELECT {by} AS g, score, count(*) FILTER (true_label = 1) AS p,
  count(*) FILTER (true_label <> 1) AS n FROM {source} GROUP BY ALL),
{name} AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY g) AS positives,
  sum(n) OVER (PARTITION BY g) AS negatives FROM {name}_ties
  WINDOW w AS (PARTITION BY g ORDER BY score DESC)),
{name}_points AS (SELECT *, {PRECISION} AS precision, {ratio('tp', 'positives', '1')} AS recall,
  fp::DOUBLE / nullif(negatives::DOUBLE, 0) AS fpr FROM {name}),
{name}_areas AS (SELECT g,
  sum({ratio('p', 'positives')} * (precision + {ratio('tp - p', 'tp - p + fp - n', '1')}) / 2) AS pr_auc,
  sum((n::DOUBLE / nullif(negatives::DOUBLE, 0)) * (recall + {ratio('tp - p', 'positives')}) / 2) AS roc_auc
  FROM {name}_points GROUP BY g)"""


def dcg(source: str, by: str, name: str = "rank_dcg") -> str:
    """CTE with tie-averaged NDCG per group ``by`` (a comma list)."""
    cuts = [("5", 5), ("10", 10), ("20", 20), ("all", None)]
    gains = ", ".join(
        f"sum(gain * CASE WHEN {'pos <= ' + str(k) if k else 'true'} THEN 1 / log2(pos + 1) ELSE 0 END) AS d{n}, "
        f"sum(true_label * CASE WHEN {'ideal <= ' + str(k) if k else 'true'} THEN 1 / log2(ideal + 1) ELSE 0 END) AS i{n}"
        for n, k in cuts)
    values = ", ".join(f"coalesce(d{n} / nullif(i{n}, 0), 0) AS ndcg_{n}" for n, _ in cuts)
    return f"""
{name}_rows AS (SELECT {by}, true_label, row_number() OVER (PARTITION BY {by} ORDER BY score DESC) AS pos,
  row_number() OVER (PARTITION BY {by} ORDER BY true_label DESC) AS ideal,
  avg(true_label) OVER (PARTITION BY {by}, score) AS gain FROM {source}),
{name}_sums AS (SELECT {by}, count(*) AS items, sum(true_label)::BIGINT AS positives, {gains}
  FROM {name}_rows GROUP BY {by}),
{name} AS (SELECT {by}, items, positives, {values} FROM {name}_sums)"""


NDCG = ["ndcg_5", "ndcg_10", "ndcg_20", "ndcg_all"]


def quota(counts_cte: str, size: str, name: str) -> str:
    """CTE ``name(true_label, take)``: largest remainder over ``counts_cte(true_label, n)``."""
    return f"""
{name}_base AS (SELECT true_label, ({size})::BIGINT * n AS sn, (SELECT sum(n) FROM {counts_cte})::BIGINT AS total,
  ({size})::BIGINT AS size FROM {counts_cte}),
{name} AS (SELECT true_label, (sn // total + CASE WHEN row_number() OVER (ORDER BY sn % total DESC, true_label::VARCHAR)
  <= size - (SELECT sum(sn // total) FROM {name}_base) THEN 1 ELSE 0 END)::BIGINT AS take FROM {name}_base)"""


def split(source: str, key: str, test: str, val: str) -> str:
    """CTE ``parts``: ``source`` with its stratified split. Sizes may use ``n_rows`` and ``n_test``."""
    return f"""
cls AS (SELECT true_label, count(*) AS n FROM {source} GROUP BY true_label),
sizes AS (SELECT n_rows, n_test, ({val})::BIGINT AS n_val FROM (
  SELECT n_rows, ({test})::BIGINT AS n_test FROM (SELECT count(*) AS n_rows FROM {source}))),
{quota('cls', '(SELECT n_test FROM sizes)', 'q_test')},
rest AS (SELECT true_label, n - take AS n FROM cls JOIN q_test USING (true_label)),
{quota('rest', '(SELECT n_val FROM sizes)', 'q_val')},
parts AS (SELECT s.*, CASE WHEN pos <= t.take THEN 'test' WHEN pos <= t.take + v.take THEN 'val'
  ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (
    PARTITION BY true_label ORDER BY {order(key + '::VARCHAR')}) AS pos FROM {source}) s
  JOIN q_test t USING (true_label) JOIN q_val v USING (true_label))"""


PAIR_SPLIT = split("pairs", "pair_id", "250", "250")

EMBEDDED = "emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
MEAN_QUERY = """
sums AS (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) GROUP BY i),
query AS (SELECT list(m / (SELECT sqrt(sum(m * m)) FROM sums) ORDER BY i) AS q FROM sums),
one AS (SELECT vec_id AS doc_id, list_inner_product((SELECT q FROM query), v) AS score FROM emb)"""
CENTROIDS = """
means AS (SELECT label, i, avg(x) AS m FROM (
  SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) GROUP BY label, i),
centroids AS (SELECT label::BIGINT AS list_id, list(m ORDER BY i) AS c FROM means GROUP BY label),
probed AS (SELECT * FROM (SELECT vec_id, v, list_id, row_number() OVER (
  PARTITION BY vec_id ORDER BY list_inner_product(v, c) DESC, list_id) AS pos FROM emb CROSS JOIN centroids))"""


def knn(source: str) -> str:
    return (f"SELECT query_id, doc_id, {r6('score')} AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER ("
            f"PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {NEIGHBOURS}")


ALL_PAIRS = """
near AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_inner_product(q.v, d.v) AS score
  FROM emb q JOIN emb d ON q.vec_id <> d.vec_id)"""

DISTINCT_DOCS = "docs AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"
TEXT_SEARCH = DISTINCT_DOCS + "," + vectors(
    "tv", "SELECT text FROM documents UNION ALL SELECT text FROM benchmark", STRONG) + f""",
found AS (SELECT * FROM (SELECT b.item_id AS query_id, d.doc_id, d.text, list_inner_product(q.v, c.v) AS score,
  row_number() OVER (PARTITION BY b.item_id ORDER BY list_inner_product(q.v, c.v) DESC, d.doc_id)::BIGINT AS rank
  FROM benchmark b CROSS JOIN docs d JOIN tv q ON q.text = b.text JOIN tv c ON c.text = d.text)
  WHERE rank <= {RETRIEVE})"""

DOC_TOKENS = f"""
dtok AS (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM dtok GROUP BY token)"""


def idf(queries: str) -> str:
    """CTE ``terms(query_id, token, idf)`` of ``queries(query_id, text)``."""
    return f"""
terms AS (SELECT query_id, q.token, ln(1 + ((SELECT count(*) FROM documents) - coalesce(df, 0) + 0.5)::DOUBLE
  / (coalesce(df, 0) + 0.5)) AS idf
  FROM (SELECT DISTINCT query_id, unnest({tokens('text')}) AS token FROM ({queries})) q LEFT JOIN df USING (token))"""


BENCHMARK_QUERIES = "SELECT item_id AS query_id, text FROM benchmark"
PAIR_QUERIES = "SELECT query_id, query AS text FROM dimension"
BM25 = f"""
dl AS (SELECT doc_id, len({tokens('text')})::DOUBLE AS len FROM documents),
tf AS (SELECT doc_id, token, count(*)::DOUBLE AS tf FROM dtok GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len
  / (SELECT avg(len) FROM dl)))), 6) AS score FROM terms JOIN tf USING (token) JOIN dl USING (doc_id) GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM bm) WHERE rank <= {RETRIEVE})"""


def coverage(source: str, key: str) -> str:
    """CTE ``covered``: ``source(query_id, key, text)`` with ``rerank_score``."""
    return f"""
cand_tok AS (SELECT DISTINCT {key}, query_id, unnest({tokens('text')}) AS token FROM {source}),
held AS (SELECT c.{key}, c.query_id, sum(idf) AS held FROM cand_tok c
  JOIN terms t ON t.query_id = c.query_id AND t.token = c.token GROUP BY ALL),
whole AS (SELECT query_id, sum(idf) AS whole FROM terms GROUP BY query_id),
covered AS (SELECT s.*, round(coalesce(coalesce(held, 0) / nullif(whole, 0), 0) - 0.5, 6) + 0.0 AS rerank_score
  FROM {source} s LEFT JOIN held h ON h.{key} = s.{key} AND h.query_id = s.query_id
  LEFT JOIN whole w ON w.query_id = s.query_id)"""


RERANKED = f"""
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY rerank_score DESC, rank)::BIGINT AS rerank_rank FROM covered)
  WHERE rerank_rank <= {KEEP})"""


def histogram(source: str, keys: str, bins: int) -> str:
    return with_(source, f"""
span AS (SELECT {keys}, CASE WHEN min(score) = max(score) THEN min(score) - 0.5 ELSE min(score) END AS lo,
  CASE WHEN min(score) = max(score) THEN max(score) + 0.5 ELSE max(score) END AS hi FROM hist GROUP BY ALL),
rough AS (SELECT {keys}, score, lo, (hi - lo) / {bins}::DOUBLE AS w,
  least({bins} - 1, floor((score - lo) / ((hi - lo) / {bins}::DOUBLE))) AS b FROM hist JOIN span USING ({keys})),
binned AS (SELECT {keys}, (CASE WHEN score < lo + b * w THEN b - 1
  WHEN score >= lo + (b + 1) * w AND b < {bins} - 1 THEN b + 1 ELSE b END)::BIGINT AS bin, count(*) AS rows
  FROM rough GROUP BY ALL)""", select=f"""
SELECT {keys}, g.bin::BIGINT AS bin, {r6(f'lo + g.bin * ((hi - lo) / {bins}::DOUBLE)')} AS low,
  {r6(f'CASE WHEN g.bin = {bins} - 1 THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / {bins}::DOUBLE) END')} AS high,
  coalesce(rows, 0)::BIGINT AS rows
FROM span CROSS JOIN range({bins}) g(bin) LEFT JOIN binned b USING ({keys}, bin)""")


def record(source: str, thresholds: str, split_name: str) -> str:
    """CTE ``record``: one row per model."""
    return f"""
rec_rows AS (SELECT s.*, t.threshold FROM {source} s JOIN {thresholds} t USING (model)),
rec_counts AS (SELECT model, threshold, {counts('threshold')} FROM rec_rows GROUP BY ALL),
{curve(source, 'model', 'rc')},
{dcg(source, 'model, query', 'rd')},
rec_ndcg AS (SELECT model, {', '.join(f'coalesce(round(avg({n}) FILTER (items >= 2 AND positives > 0), 3), 0) AS {n}' for n in NDCG)}
  FROM rd GROUP BY model),
record AS (SELECT model, '{split_name}' AS split, threshold, {rates()}, {r6('pr_auc')} AS pr_auc, {', '.join(NDCG)},
  tp, tn, fp, fn, tp + tn + fp + fn AS n_samples
  FROM rec_counts JOIN rec_ndcg USING (model) JOIN rc_areas ON g = model)"""


FIXED = f"fixed AS (SELECT * FROM (VALUES ('hash64', {PAIR_THRESHOLD}::DOUBLE), ('hash16', {PAIR_THRESHOLD}::DOUBLE)) t(model, threshold))"
SPLIT_SCORED = PAIR_SPLIT + ", ss AS (SELECT s.*, split FROM scored s JOIN (SELECT pair_id, split FROM parts) USING (pair_id))"


def _question(dim: int) -> str:
    """CTE ``asked{dim}``: all judged documents scored against question and context."""
    texts = "SELECT comment AS text FROM judged UNION ALL SELECT text FROM benchmark"
    return vectors(f"qv{dim}", texts, dim) + f""",
fm{dim} AS (SELECT list_transform(q.v, lambda x, i: (x + c.v[i]) / 2) AS m
  FROM (SELECT arg_min(text, item_id) AS question, arg_max(text, item_id) AS context FROM benchmark)
  JOIN qv{dim} q ON q.text = question JOIN qv{dim} c ON c.text = context),
fq{dim} AS (SELECT list_transform(m, lambda x: coalesce(x / nullif(sqrt(list_inner_product(m, m)), 0), 0)) AS f FROM fm{dim}),
asked{dim} AS (SELECT pair_id, true_label, 'hash{dim}' AS model,
  round(list_inner_product((SELECT f FROM fq{dim}), v), 6) + 0.0 AS score FROM judged JOIN qv{dim} ON text = comment)"""


QUESTION = _question(STRONG) + "," + _question(WEAK) + """,
scored AS (SELECT * FROM asked64 UNION ALL SELECT * FROM asked16)"""


def statements() -> dict[str, str]:
    retrieved = with_(TEXT_SEARCH, DOC_TOKENS, idf(BENCHMARK_QUERIES), coverage("found", "doc_id"), RERANKED, select=f"""
SELECT query_id, doc_id, {r6('score')} AS retrieval_score, rank AS retrieval_rank, rerank_score, rerank_rank,
  CASE WHEN rerank_score > 0 THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS verdict, text FROM ranked""")
    listed = with_(EMBEDDED, CENTROIDS, f"""
near AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_inner_product(q.v, d.v) AS score FROM probed q
  JOIN probed d ON d.list_id = q.list_id AND d.pos = 1 AND d.vec_id <> q.vec_id WHERE q.pos <= {PROBES})""", select=knn("near"))
    judged_counts = f"SELECT {counts(str(JUDGED_THRESHOLD))} FROM judged"
    return {
        "pair_scan": with_(CATALOGUE, select="SELECT query_id AS pair_id, query, answer AS comment, 1 AS true_label FROM catalogue"),
        "popularity_scan": "SELECT d.text AS comment, d.n_chars AS upvotes, l.quality AS true_label, d.source AS topic FROM documents d JOIN labels l USING (doc_id)",
        "embedding_store_roundtrip": with_(vectors("e", "SELECT text FROM conversations", WEAK),
            f"k AS (SELECT {key_of(WEAK)} AS text_key, v FROM e)", vectors("f", "SELECT text FROM conversations", STRONG),
            f"h AS (SELECT {key_of(STRONG)} AS text_key, v FROM f)", select=exploded("k", "text_key") + " UNION ALL " + exploded("h", "text_key")),
        "index_store_roundtrip": with_(EMBEDDED, CENTROIDS, select=f"""SELECT vec_id AS doc_id, p.list_id, len(v)::BIGINT AS dim,
  {r6('v[1]')} AS first_x, {r6('v[-1]')} AS last_x, {r6('c[1]')} AS center_x FROM probed p JOIN centroids USING (list_id) WHERE pos = 1"""),
        "pair_projection": with_(PAIRS, select="SELECT query, comment, true_label FROM pairs"),
        "pair_score": with_(SCORED, select="SELECT pair_id, score FROM scored"),
        "l2_normalize": with_("""
scaled AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * label) AS s FROM embeddings),
unit AS (SELECT vec_id, list_transform(s, lambda x: coalesce(x / nullif(sqrt(list_inner_product(s, s)), 0), 0)) AS v FROM scaled)""",
            select=exploded("unit", "vec_id")),
        "query_context_fusion": with_(vectors("e", "SELECT text FROM conversations", STRONG), """
pair AS (SELECT u.conv_id || '-' || u.turn AS query_id, q.v AS q, c.v AS c FROM conversations u
  JOIN e q ON q.text = u.text LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN e c ON c.text = a.text WHERE u.role = 'user'),
mean AS (SELECT query_id, list_transform(q, lambda x, i: (x + c[i]) / 2) AS m FROM pair WHERE c IS NOT NULL),
fused AS (SELECT query_id, list_transform(m, lambda x: coalesce(x / nullif(sqrt(list_inner_product(m, m)), 0), 0)) AS v FROM mean
  UNION ALL SELECT query_id, q FROM pair WHERE c IS NULL)""",
            select=exploded("fused", "query_id")),
        "threshold_predict": with_(JUDGED, select=f"SELECT pair_id, (score >= {JUDGED_THRESHOLD})::INT AS predicted FROM judged"),
        "sign_verdict": with_(JUDGED, select=f"SELECT pair_id, CASE WHEN score - {JUDGED_THRESHOLD}::DOUBLE > 0 THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS verdict FROM judged"),
        "content_key": f"SELECT doc_id, {key_of(STRONG)} AS text_key FROM documents",
        "template_fill": with_(CATALOGUE, select=f"SELECT answer_id, {template('pos')} AS comment FROM (SELECT *, row_number() OVER (ORDER BY {order('answer_id')}) - 1 AS pos FROM catalogue)"),
        "metric_rounding": with_(JUDGED, select=f"SELECT query, {rates('3')} FROM (SELECT query, {counts(str(JUDGED_THRESHOLD))} FROM judged GROUP BY query)"),
        "class_filter": with_(JUDGED, select="SELECT pair_id, score FROM judged WHERE true_label = 1"),
        "encode_hash": with_(vectors("e", "SELECT text FROM documents", STRONG),
            f"k AS (SELECT {key_of(STRONG)} AS text_key, v FROM e)", select=exploded("k", "text_key")),
        "encode_incremental": with_(vectors("e", "SELECT text FROM conversations", STRONG),
            f"k AS (SELECT {key_of(STRONG)} AS text_key, text NOT IN (SELECT text FROM conversations WHERE role = 'user') AS fresh, v FROM e)",
            select=exploded("k", "text_key, fresh")),
        "multi_model_scores": with_(BOTH, select="SELECT pair_id, model, score FROM scored"),
        "align_pairs": with_(CATALOGUE, vectors("e", "SELECT query AS text FROM catalogue UNION ALL SELECT answer FROM catalogue", STRONG), """
both_v AS (SELECT query_id, l.v AS lv, r.v AS rv FROM catalogue JOIN e l ON l.text = query JOIN e r ON r.text = answer)""",
            select=f"SELECT query_id, i::BIGINT AS i, {r6('l')} AS left_x, {r6('r')} AS right_x FROM (SELECT query_id, unnest(lv) AS l, unnest(rv) AS r, generate_subscripts(lv, 1) - 1 AS i FROM both_v)"),
        "one_to_many_scores": with_(EMBEDDED, MEAN_QUERY, select=f"SELECT doc_id, {r6('score')} AS score FROM one"),
        "topk_exact": with_(EMBEDDED, MEAN_QUERY, select=f"SELECT doc_id, {r6('score')} AS score FROM (SELECT * FROM one ORDER BY score DESC, doc_id LIMIT 20)"),
        "ivf_build": "SELECT vec_id AS doc_id, true AS in_best_list FROM embeddings",
        "ivf_search_full_probe": with_(EMBEDDED, ALL_PAIRS, select=knn("near")),
        "ivf_search_given_centroids": listed,
        "ivf_search_saved": listed,
        "ivf_search_bounded": with_(EMBEDDED, ALL_PAIRS, select=knn("near")),
        "ivf_search_grown": with_(EMBEDDED, ALL_PAIRS, select=knn("near")),
        "ivf_recall": f"""
SELECT count(DISTINCT query_id) AS queries, count(*) AS expected, count(hit) AS found, {r6('count(hit)::DOUBLE / count(*)')} AS recall
FROM ({with_(EMBEDDED, ALL_PAIRS, select=knn("near"))}) LEFT JOIN (SELECT query_id, doc_id, 1 AS hit FROM ({listed})) USING (query_id, doc_id)""",
        "knn_join": with_(EMBEDDED, ALL_PAIRS, select=knn("near")),
        "hit_lookup": with_(TEXT_SEARCH, select="SELECT query_id, doc_id, rank, text FROM found"),
        "cross_group_candidates": with_(CATALOGUE, select="""
SELECT d.query_id, d.grp, (SELECT count(*) FROM catalogue c WHERE c.grp = d.grp) AS group_size,
  (SELECT count(*) FROM catalogue c WHERE c.grp <> d.grp) AS candidates FROM dimension d"""),
        "group_dimension": with_(PAIRS, select="SELECT pair_id, grp FROM pairs JOIN dimension USING (query_id)"),
        "retrieve_rerank": retrieved,
        "retrieve_rerank_index": retrieved,
        "retrieve_rerank_scorer": with_(TEXT_SEARCH, """
asked AS (SELECT f.*, round(least(length(b.text), length(f.text))::DOUBLE / greatest(length(b.text), length(f.text), 1) - 0.5, 6) AS rerank_score
  FROM found f JOIN benchmark b ON b.item_id = f.query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::BIGINT AS rerank_rank FROM asked)""",
            select=f"""SELECT query_id, doc_id, {r6('score')} AS retrieval_score, rank AS retrieval_rank, {r6('rerank_score')} AS rerank_score,
  rerank_rank, CASE WHEN rerank_score > 0 THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS verdict, text FROM ranked WHERE rerank_rank <= {KEEP}"""),
        "lexical_candidates": with_(DOC_TOKENS, idf(BENCHMARK_QUERIES), BM25, select="SELECT query_id, doc_id, score, rank FROM lexical"),
        "lexical_saved": with_(DOC_TOKENS, idf(BENCHMARK_QUERIES), BM25, select="SELECT query_id, doc_id, score, rank FROM lexical"),
        # Each step is stored: the time must not depend on how the plan orders the joins.
        "pair_rescore": re.sub(r"(?m)^(pairs|terms|df|dtok|cand|cand_tok|held|whole) AS \(", r"\1 AS MATERIALIZED (",
            with_(PAIRS, DOC_TOKENS, idf(PAIR_QUERIES), "cand AS (SELECT pair_id, query_id, comment AS text FROM pairs)",
                  coverage("cand", "pair_id"), select="SELECT pair_id, rerank_score FROM covered")),
        "rerank_topk": with_(DOC_TOKENS, idf(BENCHMARK_QUERIES), BM25,
            "cand AS (SELECT l.*, text FROM lexical l JOIN documents USING (doc_id))", coverage("cand", "doc_id"), RERANKED,
            select="SELECT query_id, doc_id, rank AS retrieval_rank, rerank_score, rerank_rank FROM ranked"),
        "split_stratified": with_(PAIRS, PAIR_SPLIT, select="SELECT pair_id, true_label, split FROM parts"),
        "split_grouped": with_(PAIRS, """named AS (SELECT pair_id, true_label AS own, md5('v' || query || chr(31) || 'v' || comment) AS g FROM pairs),
labelled AS (SELECT *, min(own) OVER (PARTITION BY g) AS true_label FROM named)""", split("labelled", "pair_id", "250", "250"),
            f"""started AS (SELECT g, true_label, size, sum(size) OVER (PARTITION BY true_label ORDER BY {order('g')}
  ROWS UNBOUNDED PRECEDING) - size AS first FROM (SELECT g, true_label, count(*) AS size FROM labelled GROUP BY ALL))""",
            select="""SELECT l.pair_id, l.own AS true_label, CASE WHEN first < t.take THEN 'test'
  WHEN first < t.take + v.take THEN 'val' ELSE 'train' END AS split
FROM labelled l JOIN started s USING (g) JOIN q_test t ON t.true_label = l.true_label JOIN q_val v ON v.true_label = l.true_label"""),
        "split_fractions": with_("judged AS (SELECT doc_id, quality AS true_label FROM labels)",
            split("judged", "doc_id", "ceil(0.2 * n_rows)", "ceil(round((0.1 / (1 - 0.2)) * (n_rows - n_test), 9))"),
            select="SELECT doc_id, true_label, split FROM parts"),
        "split_fallback": f"""
WITH sizes AS (SELECT n, CASE WHEN 500 >= n THEN greatest(1, n // 5) ELSE 250 END AS t,
  CASE WHEN 500 >= n THEN greatest(1, n // 10) ELSE 250 END AS v FROM (SELECT count(*) AS n FROM documents))
SELECT doc_id, CASE WHEN pos <= t THEN 'test' WHEN pos <= t + v THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {order('doc_id::VARCHAR')}) AS pos FROM documents) CROSS JOIN sizes""",
        "seeded_shuffle": with_(PAIRS, select=f"SELECT pair_id, row_number() OVER (ORDER BY {order('pair_id')}) - 1 AS position FROM pairs"),
        "sample_without_replacement": """
SELECT source, doc_id, pick FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source
  ORDER BY md5('42:' || source || ':' || doc_id), doc_id) AS pick FROM documents) WHERE pick <= 8""",
        "sample_foreign_answers": with_(CATALOGUE, HARD, select="SELECT query_id, i, answer_id FROM hard"),
        "sample_with_replacement": with_(CATALOGUE, GENERIC, select="SELECT query_id, i, pool_id FROM generic"),
        "template_cycle": with_(CATALOGUE, PARAPHRASED, select="SELECT query_id, i, answer_id, comment FROM paraphrased"),
        "balanced_pairs": with_(PAIRS, select="SELECT pair_id, query_id, query, comment, true_label, branch FROM pairs"),
        "class_counts": with_(PAIRS, select="SELECT count(*) AS rows, count(*) FILTER (true_label = 1) AS relevant, count(*) FILTER (true_label = 0) AS irrelevant FROM pairs"),
        "distinct_queries": with_(PAIRS, select="SELECT count(DISTINCT query) AS queries FROM pairs"),
        "score_stats": with_(SCORED, select=f"SELECT {r6('min(score)')} AS min_score, {r6('max(score)')} AS max_score, {r6('avg(score)')} AS mean_score, {r6('stddev_pop(score)')} AS std_score FROM scored"),
        "class_mean_score": with_(SCORED, select=f"SELECT true_label, {r6('avg(score)')} AS mean_score FROM scored GROUP BY true_label"),
        "embedding_dim": "SELECT min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim FROM embeddings",
        "confusion": with_(SCORED, select=f"SELECT {counts(str(PAIR_THRESHOLD))} FROM scored"),
        "classification_metrics": with_(JUDGED, select=f"SELECT tp, fp, fn, tn, {rates()} FROM ({judged_counts})"),
        "threshold_sweep": with_(SCORED, sweep("scored", SWEEP_VALUES), select=f"SELECT t_idx, {r6('threshold')} AS threshold, tp, fp, fn, tn, {rates()} FROM swept"),
        "best_threshold": with_(SCORED, sweep("scored", SWEEP_VALUES), select=f"SELECT t_idx, {r6('threshold')} AS raw_threshold, {r3('threshold')} AS threshold, {r6('f1')} AS best_f1 FROM best"),
        "fixed_threshold_table": with_(JUDGED, sweep("judged", REPORT_GRID), select=f"SELECT t_idx, {r6('threshold')} AS threshold, {rates()} FROM swept"),
        "pr_curve": with_(SCORED, curve("scored"), select=f"SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, {r6('precision')} AS precision, {r6('recall')} AS recall FROM curve_points"),
        "pr_auc": with_(SCORED, curve("scored"), select=f"SELECT {r6('pr_auc')} AS pr_auc FROM curve_areas"),
        "roc_curve": with_(SCORED, curve("scored"), select=f"SELECT score, {r6('recall')} AS tpr, {r6('fpr')} AS fpr FROM curve_points"),
        "roc_curve_thinned": with_(SCORED, curve("scored"), select=f"""SELECT score, {r6('recall')} AS tpr, {r6('fpr')} AS fpr FROM (
  SELECT *, lead(p) OVER w AS next_p, lead(n) OVER w AS next_n FROM curve_points WINDOW w AS (ORDER BY score DESC))
WHERE (tp = p AND fp = n) OR next_p IS NULL OR next_p <> p OR next_n <> n"""),
        "score_sketch_areas": with_(SCORED, f"""
cells AS (SELECT floor(score * 64) AS cell, count(*) FILTER (true_label = 1) AS p, count(*) FILTER (true_label <> 1) AS n
  FROM scored GROUP BY ALL),
summed AS (SELECT p, n, sum(p) OVER above AS tp, sum(n) OVER above AS fp, sum(p) OVER () AS positives, sum(n) OVER () AS negatives
  FROM cells WINDOW above AS (ORDER BY cell DESC ROWS UNBOUNDED PRECEDING))""",
            select=f"""SELECT max(positives)::BIGINT AS positives, max(negatives)::BIGINT AS negatives,
  {r6('max((p + n)::DOUBLE / (positives + negatives))')} AS rank_error,
  {r6("sum(n::DOUBLE / negatives * (tp - p) / positives)")} AS roc_low, {r6("sum(n::DOUBLE / negatives * tp / positives)")} AS roc_high,
  {r6("sum(" + ratio('p', 'positives') + " * " + ratio('tp - p', 'tp - p + fp', '1') + ")")} AS pr_low,
  {r6("sum(" + ratio('p', 'positives') + " * " + ratio('tp', 'tp + fp - n', '1') + ")")} AS pr_high FROM summed"""),
        "roc_auc": with_(SCORED, curve("scored"), select=f"SELECT {r6('roc_auc')} AS roc_auc FROM curve_areas"),
        "ndcg_grouped": with_(SCORED, dcg("scored", "query"), select="SELECT " + ", ".join(
            f"coalesce(round(avg({n}) FILTER (items >= 2 AND positives > 0), 3), 0) AS {n}" for n in NDCG) + " FROM rank_dcg"),
        "ndcg_global": with_(JUDGED, "one_list AS (SELECT *, 1 AS whole_list FROM judged)", dcg("one_list", "whole_list"),
            select="SELECT " + ", ".join(f"round({n}, 3) AS {n}" for n in NDCG) + " FROM rank_dcg"),
        "eval_record": with_(SCORED, SPLIT_SCORED, FIXED, "test AS (SELECT * FROM ss WHERE split = 'test')",
            record("test", "fixed", "test"), select="SELECT * FROM record"),
        "split_summary": with_(PAIRS, PAIR_SPLIT, select=f"SELECT split, count(*) AS rows, {r6('avg(true_label)')} AS positive_rate FROM parts GROUP BY split"),
        "per_query_metrics": with_(SCORED, select=f"SELECT query_id, tp, fp, fn, tn, {rates()} FROM (SELECT query_id, {counts(str(PAIR_THRESHOLD))} FROM scored GROUP BY query_id)"),
        "compare_models": with_(BOTH, sweep("scored", SWEEP_VALUES, "model"),
            f"chosen AS (SELECT model, CASE WHEN model = 'hash16' THEN 0.5 ELSE {r3('threshold')} END AS threshold FROM best)",
            f"cm AS (SELECT model, threshold, {counts('threshold')} FROM (SELECT s.*, c.threshold FROM scored s JOIN chosen c USING (model)) GROUP BY ALL)",
            dcg("scored", "model"), select=f"SELECT model, threshold, {rates('3')}, round(ndcg_10, 3) AS ndcg_10 FROM cm JOIN rank_dcg USING (model)"),
        "compare_models_question": with_(JUDGED, QUESTION, sweep("scored", SWEEP_VALUES, "model"),
            f"chosen AS (SELECT model, {r3('threshold')} AS threshold FROM best)",
            f"cm AS (SELECT model, threshold, {counts('threshold')} FROM (SELECT s.*, c.threshold FROM scored s JOIN chosen c USING (model)) GROUP BY ALL)",
            dcg("scored", "model"), select=f"SELECT model, threshold, {rates('3')}, round(ndcg_10, 3) AS ndcg_10 FROM cm JOIN rank_dcg USING (model)"),
        "two_model_report": with_(BOTH, SPLIT_SCORED, "val AS (SELECT * FROM ss WHERE split = 'val')",
            "test AS (SELECT * FROM ss WHERE split = 'test')", sweep("val", SWEEP_VALUES, "model"),
            f"tuned AS (SELECT model, {r3('threshold')} AS threshold FROM best)", record("test", "tuned", "test"), select="SELECT * FROM record"),
        "eval_record_validation": with_(BOTH, SPLIT_SCORED, "val AS (SELECT * FROM ss WHERE split = 'val')",
            sweep("val", SWEEP_VALUES, "model"), f"tuned AS (SELECT model, {r3('threshold')} AS threshold FROM best)",
            record("val", "tuned", "val"), select="SELECT * FROM record"),
        "metrics_missing_scores": with_(JUDGED, """
loose AS (SELECT coalesce(nullif(d.source, 'src0'), '') AS query, j.true_label, CASE WHEN right(d.doc_id::VARCHAR, 1) <> '7' THEN j.score END AS score
  FROM documents d LEFT JOIN judged j ON j.pair_id = d.doc_id::VARCHAR),
rated AS (SELECT * FROM loose WHERE score IS NOT NULL AND true_label IS NOT NULL)""",
            f"cut AS (SELECT query, {counts(str(JUDGED_THRESHOLD))} FROM rated GROUP BY query)", curve("rated", "query", "pc"), dcg("rated", "query", "pd"),
            select=f"""SELECT nullif(query, '') AS query, tp, fp, fn, tn, f1, {r6('pr_auc')} AS pr_auc, items, {r6('ndcg_10')} AS ndcg_10
  FROM (SELECT query, tp, fp, fn, tn, {rates()} FROM cut) JOIN pc_areas ON g = query JOIN pd USING (query)"""),
        "metrics_long": with_(BOTH, FIXED, record("scored", "fixed", "all"), select=" UNION ALL ".join(
            f"SELECT model, '{m}' AS metric, {m} AS value FROM record" for m in ("accuracy", "precision", "recall", "f1", "pr_auc"))),
        "score_histogram": histogram(SCORED + ", hist AS (SELECT true_label, score FROM scored WHERE true_label IN (0, 1))", "true_label", 30),
        "rerank_histograms": histogram(",".join([SCORED, DOC_TOKENS, idf(PAIR_QUERIES),
            "cand AS (SELECT *, comment AS text FROM scored)", coverage("cand", "pair_id"),
            """hist AS (SELECT stage, true_label, score FROM (SELECT 'retrieval' AS stage, true_label, score FROM covered
               UNION ALL SELECT 'rerank', true_label, rerank_score FROM covered))"""]), "stage, true_label", 25),
        "operating_point": with_(SCORED, sweep("scored", SWEEP_VALUES, "model"),
            f"chosen AS (SELECT model, {r3('threshold')} AS threshold FROM best)",
            f"op AS (SELECT model, threshold, {counts('threshold')} FROM (SELECT s.*, c.threshold FROM scored s JOIN chosen c USING (model)) GROUP BY ALL)",
            select=f"SELECT model, {r6('threshold')} AS threshold, {r6(PRECISION)} AS precision, {r6(RECALL)} AS recall FROM op"),
        "tagged_curves": with_(BOTH, sweep("scored", SWEEP_VALUES, "model"), curve("scored", "model"), select=f"""
SELECT model, 'f1' AS curve, {r6('threshold')} AS x, {r6('f1')} AS y FROM swept_rates
UNION ALL SELECT g, 'pr', {r6('recall')}, {r6('precision')} FROM curve_points
UNION ALL SELECT g, 'roc', {r6('fpr')}, {r6('recall')} FROM curve_points"""),
        "class_support": """
SELECT count(*) AS classes, min(n) AS smallest, count(*) >= 2 AND min(n) >= 2 AS stratified
FROM (SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality)""",
        "display_rank": with_(TEXT_SEARCH, select="SELECT query_id, doc_id, '#' || rank AS place FROM found"),
        "running_counts": with_(SCORED, curve("scored"), select="SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM curve"),
        "tie_averaged_dcg": with_(SCORED, dcg("scored", "query_id"), select="SELECT query_id, items, positives, " + ", ".join(
            f"{r6(n)} AS {n}" for n in NDCG) + " FROM rank_dcg"),
        "quota_rank": with_(PAIRS, select=f"SELECT pair_id, true_label, row_number() OVER (PARTITION BY true_label ORDER BY {order('pair_id')}) - 1 AS position FROM pairs"),
        "top_popular": with_(JUDGED, select=f"SELECT pair_id, upvotes, score, (score >= {JUDGED_THRESHOLD})::INT AS relevant FROM (SELECT * FROM judged ORDER BY upvotes DESC, pair_id LIMIT 20)"),
        "viral_irrelevant": with_(JUDGED, select=f"SELECT pair_id, upvotes, score, (score >= {JUDGED_THRESHOLD})::INT AS relevant FROM (SELECT * FROM judged ORDER BY upvotes DESC, pair_id LIMIT 20) WHERE score < {JUDGED_THRESHOLD}"),
        "distinct_texts": with_(DISTINCT_DOCS, select="SELECT doc_id, text FROM docs"),
        "branch_union": with_(PAIRS, select="SELECT branch, true_label, count(*) AS rows FROM pairs GROUP BY ALL"),
        "split_leak_check": with_(PAIRS, PAIR_SPLIT, select="SELECT * FROM (SELECT query, comment, count(*) AS copies, count(DISTINCT split) AS splits FROM parts GROUP BY ALL) WHERE splits > 1"),
        "stream_search": retrieved,
        "stream_encode": with_(vectors("e", "SELECT text FROM documents", WEAK),
            f"k AS (SELECT {key_of(WEAK)} AS text_key, v FROM e)", select=exploded("k", "text_key")),
    }
