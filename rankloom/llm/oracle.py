"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from rankloom.llm.quality_rules import RULES, STOP_WORDS
from rankloom.llm.unit_dedup import UNIT

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rule_sql() -> str:
    def broken(rule) -> str:
        value, scale = (f"1000 * {rule.measure}", rule.scale) if rule.scale else (rule.measure, "1")
        sides = [f"{value} < {rule.low} * {scale}"] if rule.low is not None else []
        sides += [f"{value} > {rule.high} * {scale}"] if rule.high is not None else []
        return f"CASE WHEN {' OR '.join(sides)} THEN '{rule.name}' END"

    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH worded AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, {_WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
grams AS (
    SELECT rid, i, list_slice(w, i, i + 4) AS g FROM worded, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
steps AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS n FROM twice),
covered AS (SELECT rid, sum(n) AS n FROM steps GROUP BY rid),
measured AS (
    SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
        CAST(length(regexp_replace(body, '[^!?]+', '', 'g')) AS BIGINT) AS n_marks,
        CAST(len(l) AS BIGINT) AS n_lines
    FROM worded LEFT JOIN covered USING (rid)),
judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        concat_ws(',', {", ".join(broken(r) for r in RULES)}) AS broken
    FROM measured)
SELECT * EXCLUDE (rid), NOT base_failed AND broken = '' AS kept FROM judged"""


_SECRETS = r"""
WITH kinds(kind, turn, pattern, grp, least) AS (VALUES
    ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
    ('access', 1, 'AKIA[A-Z0-9]+', 0, 16), ('hex', 2, '[0-9a-f]{32,}', 0, 32),
    ('pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-{5,}END [A-Z ]*PRIVATE KEY-----'
        || '|(?:(?:__GAP__*[A-Za-z][A-Za-z0-9-]*:\x20[^\n\r\\]*)*(?:__GAP__*(?:[A-Za-z0-9+/=]{16,}'
        || '|[A-Za-z0-9+/=]+[\x20\x09]*(?:["'',;\n\r]|\\[nrt]|\\|\z)))+)?)', 0, 1),
    ('pem_tail', 4, '(?:[A-Za-z0-9+/=]{16,}__GAP__+)*(?:[A-Za-z0-9+/=]+__GAP__+)?-{5,}END [A-Z ]*PRIVATE KEY-----', 0, 1),
    ('forge', 5, 'gh[pousr]_[A-Za-z0-9]+', 0, 40),
    ('url', 6, '[a-z]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@', 0, 1)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
cut AS (
    SELECT rid, kind, turn, least, regexp_extract_all(body, pattern) AS m,
        CASE kind WHEN 'assign' THEN regexp_extract_all(body, '__ASSIGN__', 2) ELSE m END AS w,
        string_split_regex(body, pattern) AS gaps
    FROM docs, kinds WHERE regexp_matches(body, pattern)),
spans AS (
    SELECT rid, kind, turn, length(w[i]) AS wide, least,
        list_sum(list_transform(gaps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS found_at,
        -- the letter of an escaped line end is none of a tail's first token
        found_at + CASE WHEN kind = 'pem_tail' AND right(gaps[i], 1) = chr(92) THEN 1 ELSE 0 END AS s,
        found_at + length(CASE kind WHEN 'pem' THEN regexp_replace(m[i], '(?:[\x20\x09-\x0D"'',;]|\\[nrt]|\\)+$', '')
            ELSE m[i] END) AS e  -- a short last token is matched with the line end after it
    FROM cut, unnest(range(1, len(m) + 1)) AS u(i)),
kept AS (SELECT *, concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)) AS said FROM spans WHERE wide >= least),
told AS (
    SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k,
        count(*) FILTER (kind = 'hex') AS h,
        string_agg(said, ',' ORDER BY s, turn) FILTER (turn < 3) AS base, string_agg(said, ',' ORDER BY s, turn) AS every
    FROM kept GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN told USING (rid)""".replace(
    "__ASSIGN__",
    r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""").replace("__GAP__", r"""(?:[\x20\x09-\x0D"''>#*|,;]|\\[nrt])""")


_NEAR = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s
    FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
    SELECT p.doc_id AS a, q.doc_id AS b FROM shingles p JOIN shingles q ON p.x = q.x AND p.doc_id != q.doc_id
    GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)"""


_VECTORS = """
WITH RECURSIVE vecs AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND list_count(embedding) = len(embedding)
        AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x != 0))),
links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM vecs p JOIN vecs q
    ON p.label = q.label AND p.vec_id != q.vec_id AND len(p.v) = len(q.v)
    WHERE list_cosine_similarity(p.v, q.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)"""


_UNITS = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '__UNIT__') AS u FROM documents),
units AS (
    SELECT doc_id, i - 1 AS pos, trim(regexp_replace(lower(u[i]), '[\x20\x09-\x0D.!?]+', ' ', 'g')) AS x,
        coalesce(list_sum(list_transform(u[1:i - 1], lambda y: length(y))), 0) AS s, s + length(u[i]) AS e
    FROM cut, unnest(range(1, len(u) + 1)) AS t(i)),
ranked AS (
    SELECT *, len(string_split(x, ' ')) AS words, row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) > 1 AS again
    FROM units WHERE x != ''),
runs AS (
    SELECT doc_id, min(s) AS s, max(e) AS e FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM ranked WHERE again)
    GROUP BY doc_id, run HAVING sum(words) >= 15),
told AS (
    SELECT doc_id, sum(e - s) AS gone, list(CAST(s AS BIGINT) ORDER BY s) AS ss, list(CAST(e AS BIGINT) ORDER BY s) AS es,
        string_agg(concat(CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s) AS spans
    FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(body) AS BIGINT) AS n_chars, CAST(coalesce(gone, 0) AS BIGINT) AS removed_chars,
    coalesce(spans, '') AS removed_spans,
    sha256(CASE WHEN spans IS NULL THEN body ELSE array_to_string(list_transform(range(1, len(ss) + 2), lambda k:
        substring(body, CASE WHEN k = 1 THEN 1 ELSE es[k - 1] + 1 END,
            (CASE WHEN k > len(ss) THEN length(body) ELSE ss[k] END) - (CASE WHEN k = 1 THEN 0 ELSE es[k - 1] END))), '')
        END) AS text_sha256
FROM cut LEFT JOIN told USING (doc_id)""".replace("__UNIT__", UNIT)


_PAGES = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, upper(sha1(coalesce(html, ''))) AS h FROM pages),
told AS (
    SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT)) AS fives,
        min(page_id) OVER (PARTITION BY body) AS first FROM hashed)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id != first THEN first END AS refers_to
FROM told"""


_RESAMPLE = r"""
WITH steps AS (
    SELECT list(crc ORDER BY b) AS step FROM (
        SELECT b, list_reduce(list_concat([b], range(8)), lambda c, _: CASE WHEN c & 1 = 1
            THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) AS r(b))),
texts AS (
    SELECT row_number() OVER () AS rid, 0 AS side, doc_id, text FROM documents
    UNION ALL SELECT row_number() OVER (), 1, NULL, text FROM benchmark),
worded AS (
    SELECT rid, side, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT rid, side, unnest(w) AS word FROM worded),
hexed AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM features),
hashed AS (
    SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(h) // 2),
        lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, step[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
    FROM hexed, steps),
counts AS (
    SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
    FROM features JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
    SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000)
        / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS gain FROM counts, sums),
weights AS (
    SELECT rid, floor(sum(gain) / count(*)) AS weight
    FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY rid),
scored AS (
    SELECT rid, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256(
            concat('2024:', doc_id)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM worded LEFT JOIN weights USING (rid) WHERE side = 0),
placed AS (
    SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
    CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (rid)"""


def statements() -> dict[str, str]:
    return {"op2_unit_dedup": _UNITS, "op3_secret_ledger": _SECRETS, "op6_int8_pairs": _VECTORS,
            "op7_hyperminhash": _NEAR,
            "op9_quality_rules": _rule_sql(), "op11_warc_dictionary": _PAGES,
            "op13_importance_resampling": _RESAMPLE}
