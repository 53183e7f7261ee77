"""DuckDB SQL of the queries over the test tables, in parts that several share."""

from __future__ import annotations

QUERY = "de la en"

CHUNKS = r"""
nodes AS (
  SELECT doc_id AS node_id, lang AS repository, lang || '-' || doc_id || '.txt' AS name,
         '/' || source || '/' || lang || '-' || doc_id || '.txt' AS path, source AS folder, n_chars AS size_bytes
  FROM documents
), split AS (
  SELECT doc_id, lang, source, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents
), chunks AS (
  SELECT doc_id AS node_id, lang AS repository, '/' || source || '/' || lang || '-' || doc_id || '.txt' AS path,
         unnest(range(len(l))) AS ordinal, unnest(l) AS text FROM split
), c AS (
  SELECT *, node_id * 1000000 + ordinal AS chunk_id, node_id * 1000000 + ordinal // 6 AS section_id FROM chunks
)"""


def trigrams(x: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def similarity(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)"


TERMS = "['de', 'la', 'en']"
Q = f"(SELECT {trigrams(repr(QUERY))})"
VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COSINE = f"list_dot_product(embedding::DOUBLE[], {VECTOR}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({VECTOR}, {VECTOR})))"
ANY_TERM = "(contains(lower({0}), 'de') OR contains(lower({0}), 'la') OR contains(lower({0}), 'en'))"
WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"



def round_even(x: str) -> str:
    """SQL of a number of at least 0 rounded to one decimal by its exact value, ties to even: in whole steps of 2^-60."""
    units = "((v - floor(v)) * 1152921504606846976)::HUGEINT * 10"
    kept = f"(floor(v)::HUGEINT * 10 + ({units}) // 1152921504606846976)"
    rest = f"({units}) % 1152921504606846976 - 576460752303423488"
    return f"list_transform([{x}], lambda v: ({kept} + CASE WHEN {rest} > 0 OR {rest} = 0 AND {kept} % 2 = 1 THEN 1 ELSE 0 END)::DOUBLE / 10)[1]"


def places(words: str, token: str) -> str:
    """SQL of the places of a token in a list of words, from 1, as the rank keeps them."""
    return f"list_slice(list_sort(list_distinct(list_transform(list_filter(range(1, len({words}) + 1), lambda i: {words}[i] = {token}), lambda i: least(i, 16383)))), 1, 255)"


def rank(p: str) -> str:
    """SQL of the rank of a text that has all words, from the lists of their places."""
    near = "CASE WHEN abs(a - b) BETWEEN 1 AND 100 THEN ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a - b) / 1.5 - 2)))) ELSE 0 END::DOUBLE"
    pair = f"list_sum(flatten(list_transform({p}[i], lambda a: list_transform({p}[k], lambda b: {near}))))"
    logs = f"list_sum(flatten(list_transform(range(2, len({p}) + 1), lambda i: list_transform(range(1, i), lambda k: {pair}))))"
    alone = f"list_sum(list_transform(range(1, len({p}[1]) + 1), lambda j: 0.1 / (j * j)))::DOUBLE / 1.64493406685"
    return f"round(CASE WHEN len({p}) = 1 THEN {alone} ELSE 1 - exp({logs}) END, 7)"


LEGS = f"""
qt AS (SELECT {trigrams(repr(QUERY))} AS g),
vec AS (SELECT vec_id, {COSINE} AS s FROM embeddings),
leg_vector AS (
  SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) - 1 AS rnk, s AS score
  FROM (SELECT vec_id * 1000000 AS chunk_id, s FROM vec WHERE vec_id * 1000000 IN (SELECT chunk_id FROM c) ORDER BY s DESC, vec_id LIMIT 24) WHERE s >= 0.15
),
top_sections AS (SELECT vec_id * 1000000 AS section_id, s, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS srank FROM (SELECT * FROM vec ORDER BY s DESC, vec_id LIMIT 8)),
in_sections AS (
  SELECT chunk_id, s, srank, row_number() OVER (PARTITION BY srank ORDER BY {similarity(trigrams('text'), 'g')} DESC, ordinal, chunk_id) AS within
  FROM c JOIN top_sections USING (section_id), qt
),
leg_section AS (SELECT chunk_id, row_number() OVER (ORDER BY srank, within) - 1 AS rnk, s AS score FROM in_sections WHERE within <= 4),
lex AS (SELECT chunk_id, {WORDS} AS w FROM c),
lexs AS (SELECT chunk_id, {rank("p")} AS score FROM (SELECT chunk_id, list_transform(['de', 'la', 'en'], lambda t: {places("w", "t")}) AS p FROM lex) WHERE len(p[1]) > 0 AND len(p[2]) > 0 AND len(p[3]) > 0),
leg_lexical AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rnk, score FROM (SELECT * FROM lexs ORDER BY score DESC, chunk_id LIMIT 24)),
tri AS (SELECT chunk_id, {similarity(trigrams('text'), 'g')} AS score, length(text) AS n FROM c, qt WHERE {ANY_TERM.format('text')}),
leg_trigram AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, n, chunk_id) - 1 AS rnk, score FROM (SELECT * FROM tri ORDER BY score DESC, n, chunk_id LIMIT 24)),
files AS (SELECT node_id, {similarity(trigrams('path'), 'g')} AS score FROM nodes, qt WHERE {ANY_TERM.format('path')} ORDER BY score DESC, node_id LIMIT 8),
in_files AS (
  SELECT chunk_id, score, prank, row_number() OVER (PARTITION BY prank ORDER BY {similarity(trigrams('text'), 'g')} DESC, ordinal, chunk_id) AS within
  FROM c JOIN (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS prank FROM files) USING (node_id), qt
),
leg_path AS (SELECT chunk_id, row_number() OVER (ORDER BY prank, within) - 1 AS rnk, score FROM in_files WHERE within <= 3)"""

FUSED = """
legs AS (
  SELECT 0 AS leg, chunk_id, rnk FROM leg_vector UNION ALL SELECT 1, chunk_id, rnk FROM leg_section UNION ALL SELECT 2, chunk_id, rnk FROM leg_lexical
  UNION ALL SELECT 3, chunk_id, rnk FROM leg_trigram UNION ALL SELECT 4, chunk_id, rnk FROM leg_path
), per AS (
  SELECT chunk_id,
    coalesce(max(CASE WHEN leg = 0 THEN 1.0::DOUBLE / (60.0::DOUBLE + rnk) END), 0) + coalesce(max(CASE WHEN leg = 1 THEN 0.8::DOUBLE / (60.0::DOUBLE + rnk) END), 0)
    + coalesce(max(CASE WHEN leg = 2 THEN 0.7::DOUBLE / (60.0::DOUBLE + rnk) END), 0) + coalesce(max(CASE WHEN leg = 3 THEN 0.5::DOUBLE / (60.0::DOUBLE + rnk) END), 0)
    + coalesce(max(CASE WHEN leg = 4 THEN 0.4::DOUBLE / (60.0::DOUBLE + rnk) END), 0) AS score,
    min(leg * 1000 + rnk) AS first, list_sort(list(leg)) AS leg_list
  FROM legs GROUP BY chunk_id
), fused AS (SELECT * FROM per ORDER BY score DESC, first, chunk_id LIMIT 24)"""

PASSAGES = r"""
won AS (
  SELECT node_id, ordinal, score, leg_list, CASE WHEN ordinal - lag(ordinal) OVER (PARTITION BY node_id ORDER BY ordinal) > 3 THEN 1 ELSE 0 END AS gap
  FROM fused JOIN c USING (chunk_id)
), runs AS (
  SELECT node_id, run, min(ordinal) AS first, max(ordinal) AS last, max(score) AS score, flatten(list(leg_list ORDER BY ordinal)) AS all_legs
  FROM (SELECT *, sum(gap) OVER (PARTITION BY node_id ORDER BY ordinal) AS run FROM won) GROUP BY node_id, run
), passages AS (
  SELECT r.node_id, r.first, any_value(r.score) AS score, list(c.ordinal ORDER BY c.ordinal) AS ordinals,
         list_filter(any_value(all_legs), lambda x, i: list_position(any_value(all_legs), x) = i) AS leg_ids,
         regexp_replace(string_agg(c.text, chr(10) ORDER BY c.ordinal), '^\s+|\s+$', '', 'g') AS text
  FROM runs r JOIN c ON c.node_id = r.node_id AND c.ordinal BETWEEN r.first - 1 AND r.last + 1 GROUP BY r.node_id, r.run, r.first
)"""
PASSAGES = PASSAGES.replace("list_filter(any_value(all_legs), lambda x, i: list_position(any_value(all_legs), x) = i) AS leg_ids", "any_value(all_legs) AS all_legs")

PLACED = """
late AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, first) > 3 AS late FROM passages),
placed AS (SELECT *, row_number() OVER (ORDER BY late, score DESC, node_id, first) AS place FROM late)"""

NAMES = "list_transform(list_filter(all_legs, lambda x, i: list_position(all_legs, x) = i), lambda x: ['vector', 'section', 'lexical', 'trigram', 'path'][x + 1])"

BUDGET = """
fit AS (
  SELECT *, {0} - coalesce(sum(length(text)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM placed WHERE place <= 8
), fitted AS (
  SELECT * EXCLUDE (text), CASE WHEN length(text) > rest THEN regexp_replace(substr(text, 1, rest::INT), '\\s+$', '') || '…' ELSE text END AS text FROM fit WHERE rest > 200
)"""


def many(questions: str, terms: str, top: int) -> str:
    """SQL of the searches of a table of questions (query_id, text, v): up to fitted, with query_id, place, node_id, first, score, text."""
    sim = "coalesce(len(list_intersect(cg, g)) / nullif(len(list_distinct(list_concat(cg, g))), 0), 0.0)"
    v = "embedding::DOUBLE[]"
    weights = [(0, 1.0), (1, 0.8), (2, 0.7), (3, 0.5), (4, 0.4)]
    parts = " + ".join(f"coalesce(max(CASE WHEN leg = {i} THEN {w}::DOUBLE / (60.0::DOUBLE + rnk) END), 0)" for i, w in weights)
    union = " UNION ALL ".join(f"SELECT query_id, {i} AS leg, chunk_id, rnk FROM leg_{n}" for i, n in enumerate(["vector", "section", "lexical", "trigram", "path"]))
    return rf"""{CHUNKS},
asked AS ({questions}),
p AS MATERIALIZED (SELECT query_id, v, {trigrams("text")} AS g, {terms} AS terms, list_distinct({WORDS}) AS w FROM asked WHERE text <> ''),
cg AS MATERIALIZED (SELECT *, {trigrams("text")} AS cg, {WORDS} AS cw, lower(text) AS low FROM c),
ng AS MATERIALIZED (SELECT node_id, {trigrams("path")} AS cg, lower(path) AS low FROM nodes),
vec AS MATERIALIZED (SELECT query_id, vec_id, list_dot_product({v}, v) / (sqrt(list_dot_product({v}, {v})) * sqrt(list_dot_product(v, v))) AS s FROM embeddings, p WHERE v IS NOT NULL),
leg_vector AS (SELECT query_id, chunk_id, k - 1 AS rnk FROM (SELECT query_id, vec_id * 1000000 AS chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM vec WHERE vec_id * 1000000 IN (SELECT chunk_id FROM c)) WHERE k <= 24 AND s >= 0.15),
top_sections AS (SELECT * FROM (SELECT query_id, vec_id * 1000000 AS section_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS srank FROM vec) WHERE srank <= 8),
in_sections AS (SELECT query_id, chunk_id, srank, row_number() OVER (PARTITION BY query_id, srank ORDER BY {sim} DESC, ordinal, chunk_id) AS within FROM cg JOIN top_sections USING (section_id) JOIN p USING (query_id)),
leg_section AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY srank, within) - 1 AS rnk FROM in_sections WHERE within <= {max(2, top // 2)}),
lexs AS (SELECT query_id, chunk_id, {rank("x")} AS score FROM (SELECT query_id, chunk_id, list_transform(w, lambda t: {places("cw", "t")}) AS x FROM cg, p WHERE len(w) > 0 AND list_has_all(cw, w))),
leg_lexical AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rnk FROM lexs) WHERE rnk < 24),
tri AS (SELECT query_id, chunk_id, {sim} AS score, length(text) AS n FROM cg, p WHERE len(list_filter(terms, lambda t: contains(low, t))) > 0),
leg_trigram AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n, chunk_id) - 1 AS rnk FROM tri) WHERE rnk < 24),
files AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY {sim} DESC, node_id) AS prank FROM ng, p WHERE len(list_filter(terms, lambda t: contains(low, t))) > 0),
in_files AS (SELECT query_id, chunk_id, prank, row_number() OVER (PARTITION BY query_id, prank ORDER BY {sim} DESC, ordinal, chunk_id) AS within FROM cg JOIN (SELECT * FROM files WHERE prank <= 8) USING (node_id) JOIN p USING (query_id)),
leg_path AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY prank, within) - 1 AS rnk FROM in_files WHERE within <= 3),
legs AS ({union}),
per AS (SELECT query_id, chunk_id, {parts} AS score, min(leg * 1000 + rnk) AS first FROM legs GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS k FROM per) WHERE k <= {3 * top}),
won AS (SELECT query_id, node_id, ordinal, score, CASE WHEN ordinal - lag(ordinal) OVER (PARTITION BY query_id, node_id ORDER BY ordinal) > 3 THEN 1 ELSE 0 END AS gap FROM fused JOIN c USING (chunk_id)),
runs AS (SELECT query_id, node_id, run, min(ordinal) AS first, max(ordinal) AS last, max(score) AS score FROM (SELECT *, sum(gap) OVER (PARTITION BY query_id, node_id ORDER BY ordinal) AS run FROM won) GROUP BY 1, 2, 3),
passages AS (
  SELECT r.query_id, r.node_id, r.first, any_value(r.score) AS score, regexp_replace(string_agg(c.text, chr(10) ORDER BY c.ordinal), '^\s+|\s+$', '', 'g') AS text
  FROM runs r JOIN c ON c.node_id = r.node_id AND c.ordinal BETWEEN r.first - 1 AND r.last + 1 GROUP BY r.query_id, r.node_id, r.run, r.first
),
late AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, first) > 3 AS late FROM passages),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, node_id, first) AS place FROM late),
fit AS (SELECT *, 18000 - coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM placed WHERE place <= {top}),
fitted AS (SELECT * EXCLUDE (text), CASE WHEN length(text) > rest THEN regexp_replace(substr(text, 1, rest::INT), '\s+$', '') || '…' ELSE text END AS text FROM fit WHERE rest > 200)"""
