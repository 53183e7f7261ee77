"""The engine's queries over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniq import sqls as Q
from graniq.config import SearchConfig
from graniq.functions import scores as S
from graniq.functions import text as T
from graniq.functions import vectors as V
from graniq.operators import browse, cells, chunking, fusion, index, legs, matching, ops, records
from graniq.plans import indexing, many, providers, runs
from graniq.plans import search as plans
from graniq.plans import stored, tools
from graniq.plans.plugins import Plugin, Registry
from graniq.sources import corpus, files, sinks, store, versions
from graniq.streaming import handlers, ingest, joins, leases, queue

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CFG = SearchConfig().resolved()
AS_OF = "2024-01-30 00:00:00"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return corpus.table(spark, d, name)


def _vector(spark: SparkSession, d: str) -> list[float]:
    """The query's vector, that of vec_id 0."""
    return [float(x) for x in _t(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]]


def _leg(name: str):
    def leg(spark: SparkSession, d: str) -> DataFrame:
        return stored.candidate_legs(stored.of_tables(spark, d), Q.QUERY, _vector(spark, d), CFG, names=[name])[name].select("chunk_id", "rnk", F.round("score", 6).alias("score"))

    leg.__name__ = f"leg_{name}"
    return query(f"WITH {Q.CHUNKS}, {Q.LEGS} SELECT chunk_id, rnk, round(score, 6) AS score FROM leg_{name}")(leg)


for _name in ("vector", "section", "lexical", "trigram", "path"):
    _leg(_name)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return stored.fused(stored.of_tables(spark, d), Q.QUERY, _vector(spark, d), CFG)


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return stored.passages(stored.of_tables(spark, d), _fused(spark, d), CFG)


@query(f"WITH {Q.CHUNKS}, {Q.LEGS}, {Q.FUSED} SELECT chunk_id, round(score, 8) AS score, array_to_string(list_transform(leg_list, lambda x: ['vector', 'section', 'lexical', 'trigram', 'path'][x + 1]), ',') AS legs FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("chunk_id", F.round("score", 8).alias("score"), F.array_join("legs", ",").alias("legs"))


@query(f"WITH {Q.CHUNKS}, {Q.LEGS}, {Q.FUSED}, {Q.PASSAGES} SELECT node_id, first, round(score, 8) AS score, array_to_string(ordinals, ',') AS ordinals, md5(text) AS text_md5 FROM passages")
def neighbor_expand(spark, d):
    return _passages(spark, d).select("node_id", "first", F.round("score", 8).alias("score"), F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ",").alias("ordinals"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {Q.CHUNKS}, {Q.LEGS}, {Q.FUSED}, {Q.PASSAGES}, {Q.PLACED} SELECT place, node_id, first FROM placed WHERE place <= 24")
def diversify_cap(spark, d):
    return fusion.diversify(_passages(spark, d), CFG.max_per_document, CFG.pool).select("place", "node_id", "first")


@query(f"WITH {Q.CHUNKS}, {Q.LEGS}, {Q.FUSED}, {Q.PASSAGES}, {Q.PLACED}, {Q.BUDGET.format(3000)} SELECT place, node_id, length(text) AS n_chars, md5(text) AS text_md5 FROM fitted")
def context_budget(spark, d):
    best = fusion.diversify(_passages(spark, d), CFG.max_per_document, CFG.pool).filter(F.col("place") <= CFG.top_k)
    return fusion.fit_budget(best, 1000).select("place", "node_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {Q.CHUNKS}, {Q.LEGS}, {Q.FUSED}, {Q.PASSAGES}, {Q.PLACED}, {Q.BUDGET.format(18000)} SELECT place, node_id, first, round(score, 4) AS score, text FROM fitted")
def hybrid_search(spark, d):
    return stored.search(stored.of_tables(spark, d), Q.QUERY, _vector(spark, d)).select("place", "node_id", "first", "score", "text")


@query(f"WITH {Q.CHUNKS}, {Q.LEGS}, {Q.FUSED}, {Q.PASSAGES}, {Q.PLACED}, {Q.BUDGET.format(18000)} SELECT place, node_id, first, round(score, 4) AS score, text FROM fitted")
def hybrid_search_scan(spark, d):
    """The same search without an index: every leg scans the chunks."""
    vector = F.array(*[F.lit(x) for x in _vector(spark, d)])
    found = plans.search(corpus.chunks(spark, d), corpus.nodes(spark, d), corpus.sections(spark, d), Q.QUERY, vector, vectors=corpus.vectors(spark, d))
    return found.select("place", "node_id", "first", "score", "text")


@query(f"""WITH {Q.CHUNKS}, {Q.LEGS}, {Q.FUSED}, {Q.PASSAGES}, {Q.PLACED}, {Q.BUDGET.format(18000)}
SELECT '[검색된 문서 발췌]' || chr(10) || string_agg(chr(10) || '[' || place || '] ' || ltrim(n.path, '/') || chr(10) || text, chr(10) ORDER BY place) AS context FROM fitted JOIN nodes n USING (node_id)""")
def context_block(spark, d):
    found = hybrid_search(spark, d).join(corpus.nodes(spark, d).select("node_id", "path"), "node_id")
    return fusion.context_block(found.withColumns({"heading_path": F.lit(""), "page": F.lit(None).cast("int")}))


_PARTICLE = "CASE " + " ".join(f"WHEN ends_with(w, '{p}') AND length(w) > {len(p) + 1} THEN left(w, length(w) - {len(p)})" for p in T.PARTICLES) + " ELSE w END"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


_TERMS = rf"""(SELECT list_slice(list_filter(u, lambda x, i: list_position(u, x) = i), 1, 8) FROM (SELECT list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2), lambda w: {_PARTICLE}), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})) AS u))"""


@query(f"SELECT item_id, array_to_string({_TERMS}, ' ') AS terms FROM benchmark")
def query_terms(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query(rf"""WITH {Q.CHUNKS}, q AS (SELECT item_id AS query_id, list_distinct({Q.WORDS}) AS w FROM benchmark), x AS (SELECT chunk_id, {Q.WORDS} AS cw FROM c),
f AS (SELECT query_id, chunk_id, {Q.rank("p")} AS score FROM (SELECT query_id, chunk_id, list_transform(w, lambda t: {Q.places("cw", "t")}) AS p FROM x, q WHERE len(w) > 0 AND list_has_all(cw, w)))
SELECT query_id, chunk_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rnk FROM f) WHERE rnk < 24""")
def batch_search(spark, d):
    """Whole benchmark items as queries by words: the chunks that have all words of an item."""
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return many.lexical(stored.of_tables(spark, d), asked, 24).select("query_id", "chunk_id", "score", "rnk")


_QUESTIONS = r"SELECT item_id AS query_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text, embedding::DOUBLE[] AS v FROM benchmark LEFT JOIN embeddings ON vec_id = item_id"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as questions, each with the vector of its number."""
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vectors, "query_id", "left")


@query(f"WITH {Q.many(_QUESTIONS, _TERMS, 6)} SELECT query_id, place, node_id, first, round(score, 4) AS score, md5(text) AS text_md5 FROM fitted")
def search_many(spark, d):
    """All benchmark items as questions through all legs at once."""
    found = many.search(stored.of_tables(spark, d), _questions(spark, d), SearchConfig(top_k=6))
    return found.select("query_id", "place", "node_id", "first", "score", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {Q.many(_QUESTIONS, _TERMS, 6)},
e AS (SELECT query_id, '[검색된 문서 발췌]' || chr(10) || string_agg(chr(10) || '[' || place || '] ' || ltrim(n.path, '/') || chr(10) || text, chr(10) ORDER BY place) AS context, count(*) AS n, string_agg(n.path || ':' || md5(left(text, 400)), ' ' ORDER BY place) AS cites FROM fitted JOIN nodes n USING (node_id) GROUP BY 1)
SELECT item_id AS query_id, md5(coalesce(context, '')) AS context_md5, coalesce(n, 0) AS n, coalesce(cites, '') AS cites FROM benchmark LEFT JOIN e ON query_id = item_id""")
def evidence_many(spark, d):
    """What a model is shown, and may cite, for each of all benchmark items."""
    got = many.evidence(stored.of_tables(spark, d), _questions(spark, d))
    cites = F.array_join(F.transform("citations", lambda c: F.concat(c["path"], F.lit(":"), F.md5(c["quote"].cast("binary")))), " ")
    return got.select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), F.size("citations").cast("long").alias("n"), cites.alias("cites"))


@query(rf"""WITH {Q.CHUNKS}, x AS (SELECT chunk_id, {Q.WORDS} AS w FROM c), t AS (SELECT chunk_id, unnest(list_distinct(w)) AS word, w FROM x), n AS (SELECT word, len(list_filter(w, lambda y: y = word)) AS n FROM t)
SELECT word, count(*) AS chunks, least(max(n), 255)::INT AS most, sum(least(n, 255))::BIGINT AS places FROM n GROUP BY 1""")
def index_words(spark, d):
    """The index of words, written anew: what it holds of each word, from its postings."""
    own = index.build(corpus.chunks(spark, d), corpus.nodes(spark, d))
    return own.table("postings").groupBy("word").agg(F.sum("chunks").alias("chunks"), F.max("most").alias("most"), F.sum(F.size("place")).alias("places"))


@query(rf"""WITH {Q.CHUNKS} SELECT gram AS word, count(*) AS chunks, 'chunk' AS kind FROM (SELECT unnest({Q.trigrams('text')}) AS gram FROM c) GROUP BY 1
UNION ALL SELECT gram, count(*), 'path' FROM (SELECT unnest({Q.trigrams('path')}) AS gram FROM nodes) GROUP BY 1""")
def index_grams(spark, d):
    """What the index of trigrams holds of each, for chunks and for paths."""
    own = stored.of_tables(spark, d).index
    return own.table("gram_list").withColumn("kind", F.lit("chunk")).unionByName(own.table("path_gram_list").withColumn("kind", F.lit("path")))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM v a, v b WHERE a.vec_id % 100 = 0)
SELECT query_id, id, round(s, 6) AS score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) - 1 AS rnk FROM s) WHERE rnk < 24""")
def vector_cells(spark, d):
    """Nearest neighbours of the vectors whose id is divisible by 100 among all, by the cells of an index built anew, exactly."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return cells.nearest(cells.build(v), v.filter("id % 100 = 0"), 24, exact=True).select("query_id", "id", F.round("score", 6).alias("score"), "rnk")


@query()
def vector_recall(spark, d):
    """The same approximately: per query, how many of its exact 24 nearest are found by codes and exact re-ranking."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    own, asked = cells.build(v), v.filter("id % 100 = 0")
    right = cells.nearest(own, asked, 24, exact=True).select("query_id", "id")
    found = cells.nearest(own, asked, 24).select("query_id", "id", F.lit(1).alias("hit"))
    return right.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("nearest"), F.count("hit").alias("found"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
b AS (SELECT doc_id, ('0x' || left(md5(w), 7))::BIGINT % 256 AS bucket, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, bucket, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""")
def hash_embed(spark, d):
    return V.hash_counts(_t(spark, d, "documents"), "doc_id").select("doc_id", "bucket", "n", F.round("weight", 6).alias("weight"))


@query("SELECT vec_id, 96 AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, 0.0::DOUBLE AS last, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS length2 FROM embeddings")
def vector_pad(spark, d):
    v = F.col("v")
    rows = _t(spark, d, "embeddings").select("vec_id", V.pad(F.col("embedding"), 96).alias("v"))
    return rows.select("vec_id", F.size(v).alias("dim"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.element_at(v, -1).alias("last"), F.round(V.dot(v, v), 5).alias("length2"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')) AS text_md5 FROM documents""")
def clean_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("text_md5"))


@query(r"""SELECT page_id, left(CASE WHEN s = '' THEN 'repo' ELSE s END, 100) AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""")
def slugify(spark, d):
    return _t(spark, d, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@query(r"""SELECT page_id, CASE WHEN n <> '' THEN left(n, 255) END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(list_last(string_split(replace(url, '\', '/'), '/')), '^\s+|\s+$', '', 'g'), '^[. ]+|[. ]+$', '', 'g') AS n FROM pages)""")
def clean_name(spark, d):
    return _t(spark, d, "pages").select("page_id", T.clean_name(F.col("url")).alias("name"))


def _html_sql() -> str:
    x = r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav", "footer", "noscript"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    unescape = lambda y: "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')".format(y)
    b = r"regexp_replace(x, '(?is)<head\b.*?</head\s*>', ' ', 'g')"
    b = rf"regexp_replace({b}, '(?i)<h[1-3](\s[^>]*)?>', chr(10) || chr(10) || '## ', 'g')"
    b = rf"regexp_replace({b}, '(?i)</?(p|div|article|section|li|ul|ol|table|tr|h[1-6]|br|blockquote|pre)(\s[^>]*)?/?>', chr(10), 'g')"
    b = rf"regexp_replace({unescape(f'''regexp_replace({b}, '<[^>]*>', '', 'g')''')}, '[ \t]+', ' ', 'g')"
    b = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({b}, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')"
    t = unescape(r"trim(regexp_replace(regexp_extract(x, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))")
    return f"SELECT page_id, CASE WHEN t <> '' THEN t || chr(10) || chr(10) || b ELSE b END AS text FROM (SELECT page_id, {t} AS t, {b} AS b FROM (SELECT page_id, {x} AS x FROM pages))"


@query(_html_sql())
def html_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


_MARKED = "CASE WHEN doc_id % 3 <> 0 AND pos % 17 = 3 THEN repeat('#', (1 + (pos * 7) % 4)::INT) || ' Part ' || pos WHEN pos % 23 = 11 THEN '[page ' || pos || ']' ELSE x END"


def _structure_sql(mark: str) -> str:
    """SQL of the sections and chunks of all documents, their lines as ``mark`` makes them of x at pos."""
    return rf"""WITH RECURSIVE l AS (
  SELECT doc_id, pos, rtrim({mark}, {_WS}) AS line
  FROM (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
), a AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*\[page \d+\]$') THEN regexp_extract(line, '\[page (\d+)\]', 1)::INT END AS number FROM l),
b AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS page,
  last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM a),
c AS (SELECT doc_id, pos, line, page, regexp_matches(line, '^#{{1,4}}\s+') AS head, row_number() OVER w = 1 AS lead, CASE WHEN lead(pos) OVER w IS NULL THEN final ELSE lead(page) OVER w END AS after FROM b WHERE number IS NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
d AS (SELECT *, CASE WHEN head THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 1 END AS level, sum((head OR lead)::INT) OVER w - 1 AS section, sum(head::INT) OVER w AS nth FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, regexp_extract(line, '^#+\s+(.*)$', 1) AS title FROM d WHERE head),
paths AS (
  SELECT doc_id, nth, [title] AS p FROM h WHERE nth = 1
  UNION ALL SELECT h.doc_id, h.nth, list_append(list_slice(p.p, 1, h.level - 1), h.title) FROM paths p JOIN h ON h.doc_id = p.doc_id AND h.nth = p.nth + 1
), n AS (
  SELECT d.*, coalesce(array_to_string(p, ' > '), '') AS path, {_TOKENS.format('line')} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM d LEFT JOIN paths USING (doc_id, nth) WHERE NOT head
), fold AS (
  SELECT doc_id, k, section, w > 200 AS long, w AS open, 1 AS part FROM n WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.k, n.section, n.w > 200, CASE WHEN n.section <> f.section OR n.w > 200 OR f.long OR f.open > 0 AND f.open + n.w > 120 THEN n.w ELSE f.open + n.w END,
    f.part + (n.section <> f.section OR n.w > 200 OR f.long OR f.open > 0 AND f.open + n.w > 120)::INT
  FROM fold f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1
), g AS (
  SELECT doc_id, part, min(section) AS section, max(path) AS path, bool_or(long) AS long, last(page ORDER BY pos) AS own, last(after ORDER BY pos) AS after, string_agg(line, chr(10) ORDER BY pos) AS raw
  FROM fold JOIN (SELECT doc_id, k, pos, path, page, after, line FROM n) USING (doc_id, k) GROUP BY 1, 2
), t AS (
  SELECT doc_id, part, 0 AS i, section, path, after AS page, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text FROM g WHERE NOT long
  UNION ALL
  SELECT doc_id, part, i, section, path, own, regexp_replace(array_to_string(list_slice(x, i + 1, i + 200), ''), '\s+$', '') FROM (
    SELECT *, unnest(range(0, ceil((len(x) - 200) / 180)::INT * 180 + 1, 180)) AS i FROM (SELECT *, regexp_extract_all(raw, '([\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}])\s*') AS x FROM g WHERE long))
), ch AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, i) - 1 AS ordinal, {_TOKENS.format('text')} AS tokens FROM t WHERE text <> ''),
s AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS kept FROM (SELECT doc_id, section, min(ordinal) AS first, max(ordinal) AS last FROM ch GROUP BY 1, 2)
  JOIN (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS text, any_value(path) AS path FROM n GROUP BY 1, 2) USING (doc_id, section)
  JOIN (SELECT doc_id, section, page AS page FROM d WHERE head OR lead) USING (doc_id, section)
), opened AS (SELECT doc_id, section, level, CASE WHEN head THEN regexp_extract(line, '^#+\s+(.*)$', 1) ELSE '본문' END AS title FROM d WHERE head OR lead),
o AS (SELECT *, (SELECT max(u.section) FROM opened u WHERE u.doc_id = x.doc_id AND u.section < x.section AND u.level < x.level) AS parent FROM opened x),
single AS (SELECT ch.*, max(page) OVER (PARTITION BY doc_id) AS paged FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE kept > 1)),
runs AS (
  SELECT doc_id, ordinal, page, 0 AS run, 1 AS size FROM single WHERE ordinal = 0
  UNION ALL
  SELECT c.doc_id, c.ordinal, c.page, CASE WHEN c.paged IS NULL THEN c.ordinal // 6 WHEN r.size >= 2 AND c.page IS DISTINCT FROM r.page THEN r.run + 1 ELSE r.run END, CASE WHEN r.size >= 2 AND c.page IS DISTINCT FROM r.page THEN 1 ELSE r.size + 1 END
  FROM runs r JOIN single c ON c.doc_id = r.doc_id AND c.ordinal = r.ordinal + 1
), made AS (
  SELECT doc_id, run, first(page ORDER BY ordinal) FILTER (page > 0) AS p, last(page ORDER BY ordinal) FILTER (page > 0) AS q, min(ordinal) AS first, max(ordinal) AS last, sum(tokens)::BIGINT AS tokens, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM single JOIN (SELECT doc_id, ordinal, run FROM runs) USING (doc_id, ordinal) GROUP BY 1, 2
), named AS (SELECT *, CASE WHEN p IS NULL THEN '본문 ' || (run + 1) WHEN p = q THEN 'p.' || p ELSE 'p.' || p || '–' || q END AS title FROM made)
SELECT s.doc_id AS node_id, 'section' AS kind, s.section::BIGINT AS ordinal, s.section::BIGINT AS section, page, path AS heading_path, {_TOKENS.format('text')} AS tokens, md5(text) AS text_md5, o.level::INT AS level, o.title, o.parent::BIGINT AS parent, first, last FROM s JOIN o USING (doc_id, section) WHERE kept > 1
UNION ALL SELECT doc_id, 'chunk', ordinal, section::BIGINT, page, path, tokens, md5(text), NULL, NULL, NULL, NULL, NULL FROM ch WHERE doc_id IN (SELECT doc_id FROM s WHERE kept > 1)
UNION ALL SELECT doc_id, 'section', run, run, p, title, tokens, md5(text), 1, title, NULL, first, last FROM named
UNION ALL SELECT doc_id, 'chunk', ordinal, run, page, CASE WHEN path <> '' THEN path ELSE title END, single.tokens, md5(single.text), NULL, NULL, NULL, NULL, NULL FROM single JOIN (SELECT doc_id, ordinal, run FROM runs) USING (doc_id, ordinal) JOIN named USING (doc_id, run)"""


@query(_structure_sql(_MARKED))
def chunk_structure(spark, d):
    """Sections and chunks of all documents, with headings and page marks in place of some lines."""
    mark = lambda x, i: F.when((F.col("doc_id") % 3 != 0) & (i % 17 == 3), F.concat(F.repeat(F.lit("#"), 1 + (i * 7) % 4), F.lit(" Part "), i.cast("string"))).when(i % 23 == 11, F.concat(F.lit("[page "), i.cast("string"), F.lit("]"))).otherwise(x)
    docs = _t(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))
    parts = chunking.structure(docs, "doc_id", target=120, most=200, overlap=20)
    return parts.select(F.col("doc_id").alias("node_id"), "kind", "ordinal", "section", "page", "heading_path", "tokens", F.md5(F.col("text").cast("binary")).alias("text_md5"), "level", "title", "parent", "first", "last")


@query(rf"""WITH RECURSIVE l AS (
  SELECT doc_id, unnest(range(len(x))) AS pos, rtrim(unnest(x), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)
), n AS (SELECT doc_id, pos, line, {_TOKENS.format('line')} AS w FROM l),
fold AS (
  SELECT doc_id, pos, w AS open, 0 AS part FROM n WHERE pos = 0
  UNION ALL
  SELECT n.doc_id, n.pos, CASE WHEN f.open > 0 AND f.open + n.w > 120 THEN n.w ELSE f.open + n.w END, CASE WHEN f.open > 0 AND f.open + n.w > 120 THEN f.part + 1 ELSE f.part END
  FROM fold f JOIN n ON n.doc_id = f.doc_id AND n.pos = f.pos + 1
), p AS (
  SELECT doc_id, part, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM fold JOIN n USING (doc_id, pos) GROUP BY 1, 2
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS ordinal, {_TOKENS.format('text')} AS tokens, md5(text) AS text_md5 FROM p WHERE text <> ''""")
def chunk_pack(spark, d):
    return chunking.pack_lines(_t(spark, d, "documents"), "doc_id", 120).select("doc_id", "ordinal", "tokens", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 100) / 80)::INT) * 80 + 1, 80)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i // 80 AS n, md5(array_to_string(list_slice(w, i + 1, i + 100), ' ')) AS text_md5 FROM s""")
def sliding_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(chunking.sliding(F.col("text"), 100, 20)).alias("n", "text")).select("doc_id", F.col("n").cast("long"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {Q.CHUNKS} SELECT section_id, node_id, '본문 ' || (min(ordinal) // 6 + 1) AS title, min(ordinal) AS first, max(ordinal) AS last, sum({_TOKENS.format('text')})::BIGINT AS tokens FROM c GROUP BY section_id, node_id")
def section_synth(spark, d):
    c = corpus.chunks(spark, d)
    title = F.concat(F.lit(f"{chunking.BODY} "), (F.floor(F.min("ordinal") / corpus.SECTION_CHUNKS) + 1).cast("string"))
    return c.groupBy("section_id", "node_id").agg(title.alias("title"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.sum(T.token_count(F.col("text"))).alias("tokens"))


@query("""SELECT kind, name, path, repository, size_bytes::BIGINT AS size_bytes FROM (
  SELECT 'folder' AS kind, source AS name, '/' || source AS path, lang AS repository, sum(n_chars) AS size_bytes FROM documents GROUP BY source, lang) ORDER BY name, repository LIMIT 200""")
def browse_children(spark, d):
    return browse.children(browse.with_folders(corpus.nodes(spark, d)), "").select("kind", "name", "path", "repository", "size_bytes")


@query("""SELECT doc_id AS node_id, 0 AS depth, source AS crumb, '/' || source AS crumb_path FROM documents
UNION ALL SELECT doc_id, 1, lang || '-' || doc_id || '.txt', '/' || source || '/' || lang || '-' || doc_id || '.txt' FROM documents""")
def breadcrumbs(spark, d):
    return browse.breadcrumbs(corpus.nodes(spark, d))


@query(rf"""WITH {Q.CHUNKS}, s AS (SELECT node_id, min(ordinal) // 6 AS ordinal, string_agg(text, chr(10) ORDER BY ordinal) AS body FROM c GROUP BY node_id, section_id),
p AS (SELECT node_id, ordinal, trim(regexp_replace(body, '\s+', ' ', 'g')) AS t FROM s)
SELECT node_id, ordinal, '본문 ' || (ordinal + 1) AS line, CASE WHEN length(t) > 180 THEN left(t, 180) || '…' ELSE t END AS summary FROM p WHERE ordinal < 300""")
def outline(spark, d):
    c = corpus.chunks(spark, d)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n")
    own = c.groupBy("node_id", "section_id").agg(F.floor(F.min("ordinal") / corpus.SECTION_CHUNKS).alias("ordinal"), body.alias("summary"))
    return browse.outline(own.withColumns({"level": F.lit(1), "title": F.concat(F.lit(f"{chunking.BODY} "), (F.col("ordinal") + 1).cast("string"))}))


@query(f"""WITH {Q.CHUNKS}, b AS (SELECT node_id, ordinal, text, row_number() OVER w AS nth, coalesce(sum(length(text) + 1) OVER (PARTITION BY node_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WINDOW w AS (PARTITION BY node_id ORDER BY ordinal))
SELECT node_id, count(*) AS n_chunks, md5(string_agg(left(text, (6000 - before)::INT), chr(10) ORDER BY ordinal)) AS text_md5 FROM b WHERE nth <= 80 AND before < 6000 GROUP BY node_id""")
def read_document(spark, d):
    return browse.read_document(corpus.chunks(spark, d)).select("node_id", "n_chunks", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {Q.CHUNKS} SELECT ordinal, text FROM c WHERE node_id = 0 ORDER BY ordinal LIMIT 100 OFFSET 1")
def content_page(spark, d):
    return browse.content_page(corpus.chunks(spark, d), 0, 1).select("ordinal", "text")


@query("SELECT lang AS repository, count(*) AS n FROM documents WHERE source = 'src1' GROUP BY 1")
def subtree_scope(spark, d):
    return legs.scope(corpus.nodes(spark, d), None, "/src1/").groupBy("repository").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS node_id, CASE WHEN source = 'src1' THEN '/archive/old' ELSE '/' || source END || '/' || lang || '-' || doc_id || '.txt' AS path FROM documents")
def subtree_rewrite(spark, d):
    return browse.move_subtree(corpus.nodes(spark, d), "/src1", "/archive/old").select("node_id", "path")


@query(f"WITH {Q.CHUNKS} SELECT repository, n_files, n_bytes, coalesce(n_chunks, 0) AS n_chunks FROM (SELECT repository, count(*) AS n_files, sum(size_bytes)::BIGINT AS n_bytes FROM nodes GROUP BY 1) LEFT JOIN (SELECT repository, count(*) AS n_chunks FROM c GROUP BY 1) USING (repository)")
def repo_counts(spark, d):
    return ops.repository_counts(corpus.nodes(spark, d), corpus.chunks(spark, d))


@query("SELECT r_regionkey AS key, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 9 GROUP BY 1")
def collection_counts(spark, d):
    parents = _t(spark, d, "region").select(F.col("r_regionkey").alias("key"))
    return ops.zero_filled_counts(parents, _t(spark, d, "nation").filter("n_nationkey > 9").select(F.col("n_regionkey").alias("key")), "key")


@query(f"WITH {Q.CHUNKS} SELECT node_id, count(*) AS n_chunks, count(DISTINCT section_id) AS n_sections, sum({_TOKENS.format('text')})::BIGINT AS n_tokens FROM c GROUP BY 1")
def node_totals(spark, d):
    return ops.node_totals(corpus.chunks(spark, d))


@query("SELECT 'documents' AS name, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents UNION ALL SELECT 'pages', count(*), sum(length(html))::BIGINT FROM pages UNION ALL SELECT 'events', count(*), count_if(event_type = 'error') FROM events UNION ALL SELECT 'conversations', count(DISTINCT conv_id), count(*) FROM conversations")
def admin_overview(spark, d):
    one = lambda name, table, n, total: _t(spark, d, table).agg(F.lit(name).alias("name"), n.alias("n"), total.cast("long").alias("total"))
    out = one("documents", "documents", F.count("*"), F.sum("n_chars")).unionByName(one("pages", "pages", F.count("*"), F.sum(F.length("html"))))
    return out.unionByName(one("events", "events", F.count("*"), F.count_if(F.col("event_type") == "error"))).unionByName(one("conversations", "conversations", F.count_distinct("conv_id"), F.count("*")))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, d):
    return ops.histogram(_t(spark, d, "orders"), "o_orderstatus")


@query(f"SELECT count(*) AS n_calls, coalesce(round(sum(value), 2), 0.0) AS tokens FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS")
def usage_24h(spark, d):
    return ops.usage(_t(spark, d, "events"), F.lit(AS_OF).cast("timestamp")).withColumn("tokens", F.round("tokens", 2))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def log_page(spark, d):
    return ops.log_page(_t(spark, d, "events")).select("event_id", "event_type", "user_id")


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS GROUP BY 1")
def retention_purge(spark, d):
    return ops.retain(_t(spark, d, "events"), F.lit(AS_OF).cast("timestamp"), 7).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 4)")
def history_window(spark, d):
    return ops.history(_t(spark, d, "conversations"), 4)


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(CASE WHEN role = 'user' THEN '[사용자]' ELSE '[assistant]' END || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations WHERE role = 'user' OR role = 'assistant' AND coalesce(text, '') <> '' GROUP BY 1""")
def transcript(spark, d):
    return ops.transcript(_t(spark, d, "conversations"))


@query(r"SELECT conv_id, left(string_split(regexp_replace(arg_min(text, turn), '^\s+|\s+$', '', 'g'), chr(10))[1], 80) AS title FROM conversations WHERE role = 'user' GROUP BY 1")
def conversation_title(spark, d):
    return ops.conversation_titles(_t(spark, d, "conversations"))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored records of every part, and new ones of the large parts and of suppliers."""
    p, s = _t(spark, d, "part"), _t(spark, d, "supplier")
    none = F.array().cast("array<string>")
    old = p.select(F.lit("part").alias("collection"), F.col("p_partkey").cast("string").alias("external_id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string")).alias("attributes"), F.array("p_brand").alias("labels"), none.alias("evidence"))
    more = p.filter("p_size > 25").select(F.lit("part").alias("collection"), F.col("p_partkey").cast("string").alias("external_id"), F.upper("p_name").alias("title"), F.lit("").alias("summary"), F.create_map(F.lit("size"), F.lit("big"), F.lit("price"), F.round("p_retailprice", 2).cast("string")).alias("attributes"), F.lit(None).cast("array<string>").alias("labels"), none.alias("evidence"))
    other = s.select(F.lit("supplier").alias("collection"), F.col("s_suppkey").cast("string").alias("external_id"), F.col("s_name").alias("title"), F.lit("new").alias("summary"), F.create_map().cast("map<string,string>").alias("attributes"), none.alias("labels"), none.alias("evidence"))
    return old, more.unionByName(other)


@query("""SELECT 'part' AS collection, p_partkey::VARCHAR AS external_id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS title, p_type AS summary, p_brand AS brand, CASE WHEN p_size > 25 THEN 'big' ELSE p_size::VARCHAR END AS size, CASE WHEN p_size > 25 THEN 3 ELSE 2 END AS n_attributes, p_brand AS labels, false AS created FROM part
UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name, 'new', NULL, NULL, 0, '', true FROM supplier""")
def record_upsert(spark, d):
    done = records.upsert_records(*_parts(spark, d))
    return done.select("collection", "external_id", "title", "summary", F.col("attributes")["brand"].alias("brand"), F.col("attributes")["size"].alias("size"), F.size("attributes").alias("n_attributes"), F.array_join("labels", ",").alias("labels"), "created")


@query("""WITH o AS (SELECT l_partkey AS f, l_suppkey AS t, max(l_quantity) AS s, CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 'approved' WHEN (l_partkey + l_suppkey) % 3 = 1 THEN 'rejected' ELSE 'candidate' END AS status FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2),
n AS (SELECT l_partkey AS f, l_suppkey AS t, max(l_extendedprice) AS s FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2)
SELECT coalesce(o.f, n.f) AS from_id, coalesce(o.t, n.t) AS to_id, coalesce(n.s, o.s) AS score, CASE WHEN o.status IN ('approved', 'rejected') OR n.s IS NULL THEN o.status ELSE 'candidate' END AS status, o.status IS NULL AS created FROM o FULL JOIN n ON o.f = n.f AND o.t = n.t""")
def link_upsert(spark, d):
    li = _t(spark, d, "lineitem")
    keys = [F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.lit("supplies").alias("kind")]
    n = (F.col("from_id") + F.col("to_id")) % 3
    status = F.when(n == 0, "approved").when(n == 1, "rejected").otherwise("candidate")
    old = li.filter("l_linenumber < 4").groupBy(*keys).agg(F.max("l_quantity").alias("score")).withColumns({"rationale": F.lit("old"), "status": status})
    new = li.filter("l_linenumber > 2").groupBy(*keys).agg(F.max("l_extendedprice").alias("score")).withColumns({"rationale": F.lit("new"), "status": F.lit("candidate")})
    return records.upsert_links(old, new).select("from_id", "to_id", "score", "status", "created")


@query("""SELECT p_partkey AS record_id, CASE WHEN p_size % 2 = 0 THEN round(p_size * 2.0, 1) ELSE 50.0 END::DOUBLE AS total, CASE WHEN p_size % 2 = 0 THEN (CASE WHEN p_size * 2.0 >= 78 THEN 'core' WHEN p_size * 2.0 >= 60 THEN 'short' ELSE 'long' END) ELSE 'long' END AS tier, CASE WHEN p_size % 2 = 0 THEN 'candidate' ELSE 'approved' END AS status FROM part""")
def score_upsert(spark, d):
    from graniq.functions.scores import tier

    p = _t(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.lit("card").alias("card_id"), "p_size")
    old = p.select("record_id", "card_id", F.lit(50.0).alias("total"), F.lit("long").alias("tier"), F.lit("approved").alias("status"))
    new = p.filter("p_size % 2 = 0").select("record_id", "card_id", F.round(F.col("p_size") * F.lit(2.0), 1).alias("total")).withColumn("tier", tier(F.col("total")))
    return records.upsert_scores(old, new).select("record_id", "total", "tier", "status")


TAXONOMY = ["Metal > Brass", "Metal > Steel", "Finish · Polished", "Finish · Plated", "Size/Small", "Size/Large", "Economy", "Standard", "Promo"]


def _taxonomy_sql() -> str:
    import re

    rows = []
    for i, label in enumerate(TAXONOMY):
        terms = dict.fromkeys(t for t in re.split(r"\s+", re.sub("[>·/]", " ", label).lower()) if len(t) >= 2)
        rows.append(f"struct_pack(hits := {' + '.join(f'contains(h, {t!r})::INT' for t in terms)}, pos := {i}, label := '{label}')")
    found = f"list_filter([{', '.join(rows)}], lambda x: x.hits > 0)"
    ordered = f"list_sort(list_transform({found}, lambda x: struct_pack(hits := -x.hits, pos := x.pos, label := x.label)))"
    return f"SELECT p_partkey AS record_id, array_to_string(list_transform(list_slice({ordered}, 1, 3), lambda x: x.label), ' | ') AS labels FROM (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand) AS h FROM part)"


@query(_taxonomy_sql())
def taxonomy_keyword(spark, d):
    taxonomy = spark.createDataFrame(list(enumerate(TAXONOMY)), "pos int, label string")
    p = _t(spark, d, "part").withColumnRenamed("p_partkey", "record_id")
    return records.classify(p, taxonomy, "record_id", F.concat_ws(" ", "p_name", "p_type", "p_brand")).select("record_id", F.array_join("labels", " | ").alias("labels"))


_CARD = [("size", 25), ("price", 50), ("demand", 25)]
_METRICS = f"""m AS (SELECT p_partkey AS record_id, p_size * 2.0::DOUBLE AS size, p_retailprice / 20 AS price, coalesce(q, 0) AS demand FROM part LEFT JOIN (SELECT l_partkey, count(*)::DOUBLE AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
scored AS (SELECT record_id, {Q.round_even("(0 + least(100, greatest(0, size)) * 0.25::DOUBLE + least(100, greatest(0, price)) * 0.5::DOUBLE + least(100, greatest(0, demand)) * 0.25::DOUBLE)")} AS total FROM m)"""
_TIER = "CASE WHEN total >= 78 THEN 'core' WHEN total >= 60 THEN 'short' ELSE 'long' END AS tier"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    demand = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").cast("double").alias("demand"))
    return _t(spark, d, "part").join(demand, "p_partkey", "left").select(F.col("p_partkey").alias("record_id"), (F.col("p_size") * F.lit(2.0)).alias("size"), (F.col("p_retailprice") / 20).alias("price"), F.coalesce("demand", F.lit(0.0)).alias("demand"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return records.weighted_scores(_metrics(spark, d), "record_id", _CARD)


@query(f"WITH {_METRICS} SELECT record_id, total, {_TIER} FROM scored")
def weighted_score_tier(spark, d):
    return _scored(spark, d)


@query(f"WITH {_METRICS} SELECT tier, count(*) AS n FROM (SELECT {_TIER} FROM scored) GROUP BY 1")
def tier_histogram(spark, d):
    return _scored(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS record_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def unscored_records(spark, d):
    scored = _t(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("record_id"))
    return records.unscored(_t(spark, d, "part").select(F.col("p_partkey").alias("record_id")), scored, "record_id")


@query(f"WITH {_METRICS} SELECT p_partkey AS record_id, p_name AS title, total, tier FROM (SELECT p_partkey, p_name, total, tier FROM part LEFT JOIN (SELECT record_id, total, {_TIER} FROM scored WHERE record_id % 2 = 0) s ON record_id = p_partkey ORDER BY CASE WHEN coalesce(total, 0) <> 0 THEN total ELSE -1 END DESC, p_partkey LIMIT 100)")
def records_ranked(spark, d):
    scores = _scored(spark, d).filter("record_id % 2 = 0").withColumn("card_id", F.lit(1))
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"))
    return records.ranked_records(p, scores, 100)


_LINKS = "links AS (SELECT s_suppkey AS from_id, c_custkey AS to_id, round(s_acctbal + c_acctbal, 2) AS score FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_custkey % 20 = s_suppkey % 20)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 20).alias("k"))
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 20).alias("k"))
    return records.pairs(s, c, ["nation", "k"]).select(F.col("s_suppkey").alias("from_id"), F.col("c_custkey").alias("to_id"), F.round(F.col("s_acctbal") + F.col("c_acctbal"), 2).alias("score"))


@query(f"WITH {_LINKS}, b AS (SELECT from_id AS record_id, to_id AS other_id, score FROM links UNION ALL SELECT to_id, from_id, score FROM links) SELECT b.record_id, b.other_id, coalesce(c_name, '') AS title, score FROM b LEFT JOIN customer ON c_custkey = b.other_id")
def record_detail_links(spark, d):
    named = _t(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("title"))
    return records.links_of(_links(spark, d), named)


@query("""SELECT doc_id AS target_id, CASE WHEN toxic = 1 THEN 'revise' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS verdict, 2 AS n_reviews, CASE WHEN toxic = 1 THEN 'candidate' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status FROM labels""")
def latest_verdict(spark, d):
    rows = _t(spark, d, "labels")
    verdict = F.when(F.col("toxic") == 1, "revise").when(F.col("quality") == 1, "approved").otherwise("rejected")
    log = rows.select(F.col("doc_id").alias("target_id"), F.lit("approved").alias("verdict"), F.lit(1).alias("at")).unionByName(rows.select(F.col("doc_id").alias("target_id"), verdict.alias("verdict"), F.lit(2).alias("at")))
    return records.latest_verdict(log)


_DIMENSIONS = [("size", "Size", 0.25), ("price", "Price", 0.5), ("demand", "Demand", 0.25)]


@query(rf"""WITH {_METRICS}, {_LINKS}, best AS (SELECT record_id, total, {_TIER} FROM scored ORDER BY total DESC, record_id LIMIT 20),
t AS (SELECT from_id AS record_id, to_id, score, p_name AS other, row_number() OVER (PARTITION BY from_id ORDER BY score DESC, to_id) AS nth FROM links LEFT JOIN part ON p_partkey = to_id AND p_size <> 7),
l AS (SELECT record_id, '## 매칭 후보' || chr(10) || chr(10) || string_agg('- ' || CASE to_id % 3 WHEN 0 THEN '✅ 승인' WHEN 1 THEN '❌ 반려' ELSE '· 후보' END || ' **' || coalesce(other, to_id::VARCHAR) || '** (유사도 ' || score || CASE WHEN to_id % 2 = 0 THEN ', 재평가 0.5' ELSE '' END || ')' || CASE WHEN to_id % 5 = 0 THEN ' — why' ELSE '' END || chr(10), '' ORDER BY nth) || chr(10) AS block FROM t WHERE nth <= 5 GROUP BY 1),
d AS (SELECT best.*, p_name, p_type, p_brand, p_size, m.size AS a, m.price AS b, m.demand AS c FROM best JOIN part ON p_partkey = best.record_id AND p_size <> 7 JOIN m ON m.record_id = best.record_id)
SELECT d.record_id, left(trim(regexp_replace(p_name, '[^\p{{L}}\p{{N}} \-_()]', '', 'g')), 80) || '.md' AS file,
  '# ' || p_name || chr(10) || chr(10) || '- 종합점수: **' || total || '** (' || CASE tier WHEN 'core' THEN '핵심 Portfolio' WHEN 'short' THEN 'Short-list' ELSE 'Long-list' END || ')' || chr(10) || '- 분류: ' || CASE WHEN p_size % 2 = 0 THEN p_brand || ', x' ELSE '-' END || chr(10) || '- 검토상태: candidate' || chr(10) || chr(10)
  || CASE WHEN p_size % 3 > 0 THEN '## 개요' || chr(10) || p_type || chr(10) || chr(10) ELSE '' END
  || '## 주요 항목' || chr(10) || chr(10) || '- **brand**: ' || p_brand || chr(10) || '- **size**: ' || p_size || chr(10) || chr(10)
  || '## 차원별 평가' || chr(10) || chr(10) || '| 차원 | 가중치 | 점수 | 판단 근거 |' || chr(10) || '|---|---|---|---|' || chr(10)
  || '| Size | 25% | ' || round(a, 1) || ' | a/b |' || chr(10) || '| Price | 50% | ' || round(b, 1) || ' | a/b |' || chr(10) || '| Demand | 25% | ' || round(c, 1) || ' | a/b |' || chr(10) || chr(10)
  || coalesce(block, '')
  || CASE WHEN p_size % 4 = 0 THEN '## 근거 인용' || chr(10) || chr(10) || '**[1]** /a.txt > Part p.3' || chr(10) || chr(10) || '> two lines' || chr(10) || chr(10) || '**[2]** /b.txt' || chr(10) || chr(10) || '> ' || p_type || chr(10) || chr(10) ELSE '' END
  || '---' || chr(10) || chr(10) || '이 카드는 자동으로 생성되었습니다. 점수와 판단 근거는 전문가 검증(Human-in-the-Loop) 대상입니다.' AS markdown
FROM d LEFT JOIN l ON l.record_id = d.record_id""")
def evidence_card(spark, d):
    none = F.array().cast("array<string>")
    p = _t(spark, d, "part").filter("p_size <> 7").select(
        F.col("p_partkey").alias("record_id"), F.lit("part").alias("collection"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).otherwise("").alias("summary"),
        F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.lit("x"))).otherwise(none).alias("labels"), F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"), F.lit("blank"), F.lit(" ")).alias("attributes"), "p_type", "p_size",
    )
    cited = lambda path, heading, page, quote: F.struct(path.alias("path"), heading.alias("heading"), page.cast("int").alias("page"), quote.alias("quote"))
    evidence = F.when(F.col("p_size") % 4 == 0, F.array(cited(F.lit("/a.txt"), F.lit("Part"), F.lit(3), F.lit("two\nlines")), cited(F.lit("/b.txt"), F.lit(""), F.lit(None), F.col("p_type"))))
    values = _metrics(spark, d)
    rated = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(w).alias("weight"), F.round(c, 1).alias("score"), F.lit("a|b").alias("rationale")) for c, label, w in _DIMENSIONS])
    about = values.select("record_id", rated.alias("dimensions")).join(_t(spark, d, "part").select(F.col("p_partkey").alias("record_id"), "p_type", "p_size"), "record_id").select("record_id", "dimensions", evidence.alias("evidence"))
    scores = _scored(spark, d).withColumn("status", F.lit("candidate")).join(about, "record_id")
    to = F.col("to_id")
    links = _links(spark, d).withColumns({"status": F.when(to % 3 == 0, "approved").when(to % 3 == 1, "rejected").otherwise("candidate"), "rerank_score": F.when(to % 2 == 0, F.lit(0.5)), "rationale": F.when(to % 5 == 0, "why")})
    return records.evidence_cards(p.drop("p_type", "p_size"), scores, links, tier="long", collection="part")


_PAIR = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e.filter("label < 2"), e.filter("label >= 2")


@query(f"SELECT from_id, to_id, round(s, 4) AS score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY s DESC, to_id) AS rnk FROM (SELECT a.vec_id AS from_id, b.vec_id AS to_id, {_PAIR} AS s FROM embeddings a, embeddings b WHERE a.label < 2 AND b.label >= 2) WHERE s >= 0.1) WHERE rnk <= 5")
def semantic_link(spark, d):
    left, right = _sides(spark, d)
    return matching.nearest(left, right, 5, 0.1)


@query(f"""WITH p AS (SELECT a.vec_id AS from_id, b.vec_id AS to_id, {_PAIR} AS s FROM embeddings a, embeddings b WHERE a.label < 2 AND b.label >= 2)
SELECT from_id, to_id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY s DESC, to_id) AS r1, row_number() OVER (PARTITION BY to_id ORDER BY s DESC, from_id) AS r2 FROM p WHERE s >= 0.1) WHERE r1 <= 3 OR r2 <= 3""")
def semantic_link_both_ways(spark, d):
    left, right = _sides(spark, d)
    return matching.both_ways(left, right, 3, 0.1)


_JOBS = f"""jobs AS (SELECT event_id AS job_id, event_type AS kind, ['queued', 'running', 'done', 'failed'][(event_id % 4 + 1)::INT] AS status, (event_id % 7)::INT AS priority, ts AS run_at, (user_id % 5)::INT AS attempts, 4 AS max_attempts, CASE WHEN event_id % 4 = 1 THEN ts END AS locked_at, CASE WHEN event_id % 3 > 0 THEN event_type || '-' || user_id END AS dedupe_key FROM events)"""


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "done", "failed")]), (n % 4 + 1).cast("int"))
    key = F.when(n % 3 > 0, F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")))
    return _t(spark, d, "events").select(n.alias("job_id"), F.col("event_type").alias("kind"), status.alias("status"), (n % 7).cast("int").alias("priority"), F.col("ts").alias("run_at"), (F.col("user_id") % 5).cast("int").alias("attempts"), F.lit(4).alias("max_attempts"), F.when(n % 4 == 1, F.col("ts")).alias("locked_at"), key.alias("dedupe_key"))


@query(f"WITH {_JOBS} SELECT job_id, priority FROM jobs WHERE status = 'queued' AND run_at <= TIMESTAMP '{AS_OF}' ORDER BY priority, run_at, job_id LIMIT 100")
def job_claim_order(spark, d):
    return queue.claim_order(_jobs(spark, d), F.lit(AS_OF).cast("timestamp"), 100).select("job_id", "priority")


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN status = 'running' THEN (CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'queued' END) ELSE status END AS status,
floor(epoch(CASE WHEN status = 'running' AND attempts < max_attempts THEN TIMESTAMP '{AS_OF}' + to_seconds(least(600, 5 * pow(2, attempts))::BIGINT) ELSE run_at END))::BIGINT AS run_at FROM jobs""")
def job_backoff(spark, d):
    done = queue.fail(_jobs(spark, d), F.col("status") == "running", F.lit(AS_OF).cast("timestamp"))
    return done.select("job_id", "status", F.unix_seconds("run_at").alias("run_at"))


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN status = 'running' AND locked_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 MINUTES THEN (CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'queued' END) ELSE status END AS status FROM jobs")
def job_lease_requeue(spark, d):
    return queue.expire_leases(_jobs(spark, d), F.lit(AS_OF).cast("timestamp")).select("job_id", "status")


@query(f"""WITH {_JOBS}, o AS (SELECT * FROM jobs WHERE job_id % 2 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY job_id) AS k FROM jobs WHERE job_id % 2 = 1)
SELECT job_id, dedupe_key FROM o UNION ALL SELECT job_id, dedupe_key FROM n WHERE (k = 1 OR dedupe_key IS NULL) AND (dedupe_key IS NULL OR dedupe_key NOT IN (SELECT dedupe_key FROM o WHERE status IN ('queued', 'running') AND dedupe_key IS NOT NULL))""")
def job_dedupe(spark, d):
    jobs = _jobs(spark, d)
    return queue.enqueue(jobs.filter("job_id % 2 = 0"), jobs.filter("job_id % 2 = 1")).select("job_id", "dedupe_key")


@query(rf"""WITH {Q.CHUNKS}, h AS (SELECT node_id, string_agg(text, ' ' ORDER BY ordinal) AS text FROM c WHERE ordinal < 4 GROUP BY 1)
SELECT node_id, path AS external_id, regexp_replace(name, '\.[^.]*$', '') AS title, left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 400) AS summary FROM nodes LEFT JOIN h USING (node_id) WHERE starts_with(path, '/src2/')""")
def document_records(spark, d):
    return records.document_records(corpus.nodes(spark, d), corpus.chunks(spark, d), "/src2").drop("labels")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types FROM events GROUP BY 1")
def bridge_lists(spark, d):
    return records.grouped_ids(_t(spark, d, "events"), "user_id", "event_type").select("user_id", F.array_join("event_type", ",").alias("event_types"))


@query(f"WITH {_LINKS} SELECT from_id, to_id, coalesce(s_name, '') AS from_title, coalesce(c_name, '') AS to_title, score FROM (SELECT * FROM links WHERE to_id % 3 = 0 ORDER BY score DESC, from_id, to_id LIMIT 400) LEFT JOIN supplier ON s_suppkey = from_id LEFT JOIN customer ON c_custkey = to_id")
def link_page(spark, d):
    sides = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("record_id"), F.lit("from").alias("side"), F.col("s_name").alias("title")).unionByName(_t(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.lit("to").alias("side"), F.col("c_name").alias("title")))
    links = _links(spark, d).withColumn("status", F.when(F.col("to_id") % 3 == 0, "approved").otherwise("candidate"))
    return records.link_page(links, sides.filter("side = 'from'"), status="approved", to=sides.filter("side = 'to'"))


@query("SELECT user_id, count(*) AS n_searches, sum(event_id % 7)::BIGINT AS hits, max(value) AS top_score, bool_or(event_type = 'click') AS reranked FROM events GROUP BY 1")
def turn_totals(spark, d):
    log = _t(spark, d, "events").select("user_id", (F.col("event_id") % 7).alias("hits"), F.col("value").alias("score"), (F.col("event_type") == "click").alias("reranked"))
    return ops.turn_totals(log, "user_id")


@query("SELECT event_id, 'data: ' || '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events")
def event_frames(spark, d):
    return _t(spark, d, "events").select("event_id", sinks.event_frame(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("frame"))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """An extension: hourly windows, the same expression for tables and streams."""
    return ingest.event_counts(_t(spark, d, "events")).select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n")


@query("""WITH a AS (SELECT vec_id // 10 AS search, vec_id % 10 AS place, vec_id % 37 AS node_id FROM embeddings), f AS (SELECT node_id, min(search * 1000 + place) AS k FROM a GROUP BY 1)
SELECT row_number() OVER (ORDER BY k, node_id) AS number, node_id, k // 1000 AS search, k % 1000 AS place FROM f""")
def citation_numbers(spark, d):
    rows = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("search"), (F.col("vec_id") % 10).alias("place"), (F.col("vec_id") % 37).alias("node_id"), F.array(F.lit(0)).alias("ordinals"))
    return fusion.citations(rows).drop("ordinals")


@query("SELECT l_partkey AS key, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY 1 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_size > 40")
def replace_children(spark, d):
    old = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"))
    new = _t(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("node_id"))
    return records.replace_children(old, new).groupBy(F.col("node_id").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT lang AS repository, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY 1")
def subtree_delete(spark, d):
    return browse.delete_subtree(corpus.nodes(spark, d), [], "/src3")[0].groupBy("repository").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS node_id FROM documents WHERE doc_id = 5")
def resolve_node(spark, d):
    nodes = corpus.nodes(spark, d)
    name = nodes.filter("node_id = 5").select("name").first()[0]
    return browse.resolve(nodes, name).select("node_id")


@query(r"""SELECT doc_id, n, CASE WHEN n <= 8 THEN repeat('*', n) ELSE left(w, 4) || '…' || right(w, 4) END AS masked FROM (SELECT doc_id, left(regexp_replace(text, '\s', '', 'g'), 6 + doc_id::INT % 7) AS w, length(left(regexp_replace(text, '\s', '', 'g'), 6 + doc_id::INT % 7)) AS n FROM documents)""")
def mask_secrets(spark, d):
    w = F.substr(F.regexp_replace("text", r"\s", ""), F.lit(1), (6 + F.col("doc_id") % 7).cast("int"))
    return _t(spark, d, "documents").select("doc_id", F.length(w).alias("n"), T.mask(w).alias("masked"))


@query("SELECT n_name AS name, r_name AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 AS is_default FROM nation JOIN region ON r_regionkey = n_regionkey")
def scoped_defaults(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    least = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("least"))
    return records.single_default(n.join(least, "n_regionkey"), F.col("n_nationkey") == F.col("least")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"), "is_default")


@query("SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS slug, count(*) AS n FROM pages GROUP BY 1")
def visible_hosts(spark, d):
    """Repositories that a user may see: here pages by host, all of them shared."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1))
    rows = _t(spark, d, "pages").select(host.alias("slug"), F.lit("someone").alias("owner_id"), F.lit("shared").alias("visibility"))
    return browse.visible(rows, "nobody").groupBy("slug").agg(F.count("*").alias("n"))


_RECORDS = """records AS (SELECT p_partkey AS record_id, p_name AS title, p_type AS summary, p_brand AS collection, CASE WHEN p_size % 10 = 0 THEN 'archived' ELSE 'active' END AS status, p_partkey % 977 AS created_at FROM part)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.col("p_brand").alias("collection"), F.when(F.col("p_size") % 10 == 0, "archived").otherwise("active").alias("status"), (F.col("p_partkey") % 977).alias("created_at"))


@query(f"""WITH {_METRICS}, {_RECORDS}, s AS (SELECT record_id, arg_max(total, score_id) AS total FROM (SELECT record_id, total, 1 AS score_id FROM scored WHERE record_id % 3 > 0 UNION ALL SELECT record_id, 100 - total, 2 FROM scored WHERE record_id % 5 = 0) GROUP BY 1),
page AS (SELECT * FROM records WHERE status = 'active' AND (title ILIKE '%a%' OR summary ILIKE '%a%') ORDER BY created_at DESC, record_id DESC LIMIT 300)
SELECT record_id, title, total, {_TIER} FROM page JOIN s USING (record_id) WHERE total < 60""")
def record_search(spark, d):
    """Records by a text, the newest 300, then those of a tier; the last of several scores counts."""
    one = _scored(spark, d)
    again = one.filter("record_id % 5 = 0").select("record_id", (F.lit(100.0) - F.col("total")).alias("total"))
    scores = one.filter("record_id % 3 > 0").select("record_id", "total").withColumn("score_id", F.lit(1)).unionByName(again.withColumn("score_id", F.lit(2))).withColumn("tier", S.tier(F.col("total")))
    found = records.record_list(_records(spark, d), scores, q="A", tier="long", limit=900)
    return found.select("record_id", "title", "total", "tier")


_REVIEWS = "reviews AS (SELECT ['record', 'link', 'score'][(event_id % 3 + 1)::INT] AS target_type, event_id % 53 AS target_id, event_type AS verdict, ts AS moment, event_id AS review_id FROM events)"


@query(f"""WITH {_LINKS}, {_REVIEWS}, l AS (SELECT from_id, to_id, score, (from_id * 7 + to_id) % 53 AS link_id FROM links), b AS (SELECT from_id AS record_id, link_id, score FROM l UNION ALL SELECT to_id, link_id, score FROM l),
k AS (SELECT record_id, link_id FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, link_id) AS n FROM b) WHERE n <= 20),
t AS (SELECT s_suppkey AS record_id, 'record' AS target_type, s_suppkey AS target_id FROM supplier UNION SELECT k.record_id, 'link', link_id FROM k JOIN supplier ON s_suppkey = record_id UNION SELECT s_suppkey, 'score', s_suppkey % 11 FROM supplier)
SELECT record_id, nth, target_type, target_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY moment DESC, review_id DESC) AS nth FROM t JOIN reviews USING (target_type, target_id)) WHERE nth <= 30""")
def record_reviews(spark, d):
    n = F.col("event_id")
    kind = F.element_at(F.array(F.lit("record"), F.lit("link"), F.lit("score")), (n % 3 + 1).cast("int"))
    reviews = _t(spark, d, "events").select(kind.alias("target_type"), (n % 53).alias("target_id"), F.col("event_type").alias("verdict"), F.col("ts").alias("at"), n.alias("review_id"))
    own = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("record_id"))
    links = _links(spark, d).withColumn("link_id", (F.col("from_id") * 7 + F.col("to_id")) % 53)
    return records.record_reviews(own, links, own.withColumn("score_id", F.col("record_id") % 11), reviews)


@query("""WITH c AS (SELECT s_suppkey AS card_id, 'r' || s_nationkey AS repository, s_suppkey % 4 AS k FROM supplier), d AS (SELECT repository, max(card_id) AS d FROM c WHERE k = 1 GROUP BY 1)
SELECT card_id, repository, CASE WHEN k = 1 THEN 'new' ELSE 'old' END AS name, CASE WHEN k = 1 THEN 'a=0.25,b=0.75' WHEN k = 2 THEN 'a=0.5,b=0.5' ELSE 'x=1.0' END AS dimensions, CASE WHEN d IS NULL THEN card_id % 2 = 0 ELSE card_id = d END AS is_default FROM c LEFT JOIN d USING (repository)""")
def scorecard_update(spark, d):
    k = F.col("card_id") % 4
    dim = lambda *pairs: F.array(*[F.struct(F.lit(n).alias("key"), F.lit(float(w)).alias("weight")) for n, w in pairs])
    cards = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("card_id"), F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("repository"), F.lit("old").alias("name"), dim(("x", 1)).alias("dimensions"), (F.col("s_suppkey") % 2 == 0).alias("is_default"))
    given = F.when(k == 1, dim(("a", 25), ("b", 75), ("", 9))).when(k == 2, dim(("a", -1), ("b", 0))).otherwise(dim(("", 3)))
    changes = cards.filter(k > 0).select("card_id", F.when(k == 1, "new").otherwise("").alias("name"), given.alias("dimensions"), (k == 1).alias("is_default"))
    shown = F.array_join(F.transform("dimensions", lambda x: F.concat(x["key"], F.lit("="), x["weight"].cast("string"))), ",")
    return records.update_cards(cards, changes).select("card_id", "repository", "name", shown.alias("dimensions"), "is_default")


@query("SELECT p_partkey AS record_id, 'brand=' || p_brand AS shown FROM part")
def visible_attributes(spark, d):
    own = F.create_map(F.lit("_score"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand", F.lit("_"), F.lit("x"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.array_join(F.transform(F.map_entries(records.visible_attributes(own)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("shown"))


@query(rf"""WITH {Q.CHUNKS}, p AS (SELECT node_id, ordinal, text, row_number() OVER w AS nth, coalesce(sum(length(text) + 1) OVER (PARTITION BY node_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE (ordinal // 6) % 2 = 1 AND ordinal // 3 + 1 = 3 WINDOW w AS (PARTITION BY node_id ORDER BY ordinal))
SELECT node_id, count(*) AS n_chunks, md5(string_agg(left(text, (500 - before)::INT), chr(10) ORDER BY ordinal)) AS text_md5 FROM p WHERE nth <= 80 AND before < 500 GROUP BY 1""")
def read_section_page(spark, d):
    odd = F.when(F.floor(F.col("ordinal") / 6) % 2 == 1, "Odd part").otherwise("Even part")
    c = corpus.chunks(spark, d).withColumns({"heading_path": odd, "page": (F.floor(F.col("ordinal") / 3) + 1).cast("int")})
    return browse.read_part(c, "ODD", 3, max_chars=100).select("node_id", "n_chunks", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {Q.CHUNKS} SELECT section_id, count(*) AS n_chunks FROM c GROUP BY 1 UNION ALL SELECT -doc_id - 1, 0 FROM documents")
def section_sizes(spark, d):
    own = corpus.chunks(spark, d).groupBy("section_id").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    empty = _t(spark, d, "documents").select((-F.col("doc_id") - 1).alias("section_id"), F.lit(5).cast("long").alias("first"), F.lit(3).cast("long").alias("last"))
    return browse.section_sizes(own.unionByName(empty)).select("section_id", "n_chunks")


@query("""WITH a AS (SELECT p_partkey AS ask_id, ['en', 'fr'][(p_partkey % 2 + 1)::INT] AS repository, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '/src1' WHEN 2 THEN '/a/b/c/d/e/f/g/h/i/j/k/l' ELSE '/no' END AS parent, CASE p_size % 7 WHEN 0 THEN ' .. ' WHEN 1 THEN 'x/' || p_brand ELSE 'src1' END AS name FROM part),
n AS (SELECT *, CASE WHEN name = ' .. ' THEN NULL ELSE parent || '/' || regexp_replace(name, '^.*/', '') END AS path FROM a),
f AS (SELECT DISTINCT lang AS repository, '/' || source AS path FROM documents UNION SELECT r, '/a/b/c/d/e/f/g/h/i/j/k/l' FROM (VALUES ('en'), ('fr')) t(r))
SELECT ask_id, repository, path, CASE WHEN path IS NULL THEN 'bad_name' WHEN parent <> '' AND (repository, parent) NOT IN (SELECT repository, path FROM f) THEN 'parent_not_folder' WHEN parent LIKE '/a/%' THEN 'too_deep'
  WHEN (repository, path) IN (SELECT repository, path FROM f) OR row_number() OVER (PARTITION BY repository, path ORDER BY ask_id) > 1 THEN 'name_exists' END AS error FROM n""")
def create_folder(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    deep = "/a/b/c/d/e/f/g/h/i/j/k/l"
    asked = _t(spark, d, "part").select(key.alias("ask_id"), F.when(key % 2 == 0, "en").otherwise("fr").alias("repository"), F.when(size % 5 == 0, "").when(size % 5 == 1, "/src1").when(size % 5 == 2, deep).otherwise("/no").alias("parent"), F.when(size % 7 == 0, " .. ").when(size % 7 == 1, F.concat(F.lit("x/"), "p_brand")).otherwise("src1").alias("name"))
    own = browse.with_folders(corpus.nodes(spark, d)).select("repository", "kind", "path")
    more = spark.createDataFrame([("en", "folder", deep), ("fr", "folder", deep)], "repository string, kind string, path string")
    return browse.create_folders(own.unionByName(more), asked)


@query("SELECT event_id, event_type FROM events WHERE event_type ILIKE '%IC%' AND user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 500")
def audit_search(spark, d):
    return ops.search_log(_t(spark, d, "events"), 600, contains={"event_type": "IC"}, equals={"user_id": 3}).select("event_id", "event_type")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_name ILIKE '%00012%' OR c_mktsegment ILIKE '%BUILD%' ORDER BY c_custkey DESC LIMIT 300")
def user_search(spark, d):
    users = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"), F.col("c_custkey").alias("created_at"))
    either = users.withColumn("both", F.concat_ws("\n", "name", F.when(T.contains_text(F.col("email"), "build"), F.lit("00012")).otherwise(F.lit(""))))
    return ops.search_log(either, 1000, 300, "created_at", "user_id", {"name": "00012", "both": "00012"}).select("user_id")


@query("SELECT 'reviews' AS listing, event_id FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 30) UNION ALL SELECT 'runs', event_id FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 40) UNION ALL SELECT 'conversations', event_id FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) UNION ALL SELECT 'messages', event_id FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 400)")
def listings(spark, d):
    e = _t(spark, d, "events")
    parts = [ops.listing(e, name, "ts", "event_id").select(F.lit(name).alias("listing"), "event_id") for name in ("reviews", "runs", "conversations", "messages")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT user_id, max(value) AS tokens_in, max(event_id) AS tokens_out FROM events GROUP BY 1")
def streamed_usage(spark, d):
    return ops.streamed_usage(_t(spark, d, "events").select("user_id", F.col("value").alias("tokens_in"), F.col("event_id").alias("tokens_out")), "user_id", "tokens_in", "tokens_out")


@query("SELECT doc_id AS node_id, lang AS repository FROM documents WHERE doc_id = 7 AND lang = 'en'")
def owned_lookup(spark, d):
    return ops.owned(corpus.nodes(spark, d), F.lit(7), "en").select("node_id", "repository")


@query(r"""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Part ' || doc_id || chr(10) || text END) AS embedded_md5 FROM documents""")
def embed_text(spark, d):
    heading = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Part "), F.col("doc_id").cast("string"), F.lit(" ")))
    return _t(spark, d, "documents").select("doc_id", F.md5(T.embed_text(heading, F.col("text")).cast("binary")).alias("embedded_md5"))


@query("SELECT c_custkey, lower(c_name) AS email FROM customer")
def email_keys(spark, d):
    return _t(spark, d, "customer").select("c_custkey", T.email_key(F.concat(F.lit(" "), "c_name", F.lit("\t"))).alias("email"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 > 0 THEN '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS at, (epoch_us(ts + to_microseconds(event_id * 777)) - epoch_us(ts)) // 1000 AS took_ms FROM events")
def event_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    later = F.timestamp_micros(F.unix_micros(ts) + F.col("event_id") * 777)
    return _t(spark, d, "events").select("event_id", T.iso_time(ts).alias("at"), T.elapsed_ms(ts, later).alias("took_ms"))


_VISIBLE = Q.CHUNKS.replace("FROM documents", "FROM (SELECT * FROM documents WHERE lang IN ('en', 'fr'))")


@query(f"WITH {_VISIBLE}, {Q.LEGS}, {Q.FUSED}, {Q.PASSAGES}, {Q.PLACED}, {Q.BUDGET.format(18000)} SELECT place, node_id, first, round(score, 4) AS score, text FROM fitted")
def multi_repository_search(spark, d):
    """A search over what a user may see: own repositories and shared ones."""
    repositories = spark.createDataFrame([("en", "me", "private"), ("fr", "you", "shared"), ("de", "you", "private"), ("es", "them", "private")], "repository string, owner_id string, visibility string")
    own = plans.visible_names(repositories, "me")
    found = stored.search(stored.of_tables(spark, d), Q.QUERY, _vector(spark, d), repositories=own)
    return found.select("place", "node_id", "first", "score", "text")


@query(f"WITH {Q.CHUNKS}, {Q.LEGS}, {Q.FUSED}, {Q.PASSAGES}, {Q.PLACED}, {Q.BUDGET.format(18000)} SELECT place AS number, path, round(score, 4) AS score, left(text, 400) AS quote FROM fitted JOIN nodes USING (node_id)")
def gather_evidence(spark, d):
    return plans.evidence(hybrid_search(spark, d), corpus.nodes(spark, d)).select("number", "path", "score", "quote")


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN status = 'running' THEN 'done' ELSE status END AS status, locked_at IS NULL OR status = 'running' AS free FROM jobs")
def job_finish(spark, d):
    done = queue.finish(_jobs(spark, d), F.col("status") == "running", F.lit(AS_OF).cast("timestamp"))
    return done.select("job_id", "status", F.col("locked_at").isNull().alias("free"))


@query(f"""WITH {_JOBS}, due AS (SELECT * FROM jobs WHERE status = 'queued' AND run_at <= TIMESTAMP '{AS_OF}' ORDER BY priority, run_at, job_id LIMIT 100)
SELECT job_id, CASE WHEN kind = 'view' THEN 'viewed ' || job_id WHEN kind = 'click' THEN 'clicked' END AS result, kind NOT IN ('view', 'click') AS unknown FROM due""")
def job_dispatch(spark, d):
    """Claimed jobs through the handlers of their kinds; one of an unknown kind fails."""
    reg = handlers.Handlers()
    reg.register("view", lambda jobs: jobs.select("job_id", F.concat(F.lit("viewed "), F.col("job_id").cast("string")).alias("result")))
    reg.register("click", lambda jobs: jobs.select("job_id", F.lit("clicked").alias("result")))
    return reg.dispatch(queue.claim_order(_jobs(spark, d), F.lit(AS_OF).cast("timestamp"), 100)).select("job_id", "result", F.col("error").isNotNull().alias("unknown"))


@query("SELECT run_id, 'step ' || step_id AS step FROM (SELECT event_id AS run_id, user_id AS step_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 40)")
def pipeline_runs(spark, d):
    e = _t(spark, d, "events")
    steps = e.select(F.col("user_id").alias("step_id")).distinct().select("step_id", F.concat(F.lit("step "), F.col("step_id").cast("string")).alias("name"), F.lit(0).alias("sort_order"), F.lit(0).alias("created_at"))
    return records.pipeline_page(steps, e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("step_id"), F.col("ts").alias("started_at")))[1].select("run_id", "step")


@query("SELECT p_partkey AS record_id, p_name AS title, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS summary FROM part WHERE p_size % 4 > 0")
def model_extract(spark, d):
    """Records out of a model's answers: fenced or wordy JSON is read, an answer without any gives no record."""
    said = F.to_json(F.struct(F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("summary")))
    answer = F.when(F.col("p_size") % 4 == 0, F.lit("I can't.")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), said, F.lit(" done")))
    docs = _t(spark, d, "part").select(F.col("p_partkey").alias("record_id"), answer.alias("text"))
    return providers.extract(docs, "record_id", providers.Scripted(lambda prompt: F.regexp_replace(prompt, r"^(?s).*\nText:\n", "")))


@query("SELECT p_partkey AS record_id, CASE WHEN p_size % 3 = 0 THEN 'Economy | Promo' WHEN p_size % 3 = 1 THEN 'Standard' ELSE '' END AS labels FROM part")
def model_classify(spark, d):
    """Labels by a model's answer, of which only those of the taxonomy count."""
    answer = F.when(F.col("p_size") % 3 == 0, F.lit('["Economy", "unknown", "Promo", "Economy"]')).when(F.col("p_size") % 3 == 1, F.lit('{"labels": ["Standard"]}')).otherwise(F.lit("none"))
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("record_id"), answer.alias("text"))
    model = providers.Scripted(lambda prompt: F.regexp_replace(prompt, r"^(?s).*\nText:\n", ""))
    return providers.classify(rows, "record_id", TAXONOMY, model).select("record_id", F.array_join("labels", " | ").alias("labels"))


@query(f"SELECT node_id, ordinal, section, tokens, text_md5 FROM ({_structure_sql('x')}) WHERE kind = 'chunk'")
def stream_ingest(spark, d):
    """All documents through the file stream: the chunks that it leaves."""
    own = store.folder(spark, "stream")
    docs = _t(spark, d, "documents")
    to_nodes = lambda batch: batch.select(F.col("doc_id").alias("node_id"), "text")
    ingest.ingest(spark, corpus.stream_path(d, "documents"), docs.schema, own, f"{own}-checkpoint", to_nodes, sizes={"target": 120, "most": 200, "overlap": 20}).awaitTermination()
    return ingest.latest(spark, own).select("node_id", "ordinal", "section", "tokens", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_STREAM_EVENTS = """e AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment, job_id) AS k FROM (
    SELECT event_id AS job_id, CASE WHEN event_id % 11 = 0 THEN 'job:' || event_id ELSE 'key:' || event_type || '-' || user_id END AS key,
      ['enqueue', 'enqueue', 'claim', 'finish', 'fail', 'claim', 'enqueue'][(event_id % 7 + 1)::INT] AS action, make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 200) AS moment, (event_id % 4) * 60 AS delay_s FROM events)
)"""


@query(f"""WITH RECURSIVE {_STREAM_EVENTS},
fold AS (
  SELECT key, 0::BIGINT AS k, NULL::BIGINT AS was, NULL::VARCHAR AS ws, 0 AS wa, NULL::BIGINT AS job, NULL::VARCHAR AS s, 0 AS a, NULL::TIMESTAMP AS run_at, NULL::TIMESTAMP AS locked FROM e WHERE k = 1
  UNION ALL
  SELECT key, k, job, x, a,
    CASE WHEN opens THEN job_id ELSE job END,
    CASE WHEN opens THEN 'queued' WHEN takes THEN 'running' WHEN ends THEN 'done' WHEN fails THEN (CASE WHEN a >= 2 THEN 'dead' ELSE 'queued' END) ELSE x END,
    CASE WHEN opens THEN 0 WHEN takes THEN a + 1 ELSE a END,
    CASE WHEN opens THEN moment + to_seconds(delay_s) WHEN fails AND a < 2 THEN moment + to_seconds(least(600, 5 * pow(2, a))::BIGINT) ELSE run_at END,
    CASE WHEN takes THEN moment WHEN opens OR ends OR fails THEN NULL ELSE locked END
  FROM (
    SELECT *, action = 'enqueue' AND (x IS NULL OR x IN ('done', 'dead')) AS opens, coalesce(action = 'claim' AND x = 'queued' AND run_at <= moment, false) AS takes, coalesce(action = 'finish' AND x = 'running', false) AS ends, coalesce(action = 'fail' AND x = 'running', false) AS fails FROM (
      SELECT e.key, e.k, e.job_id, e.action, e.moment, e.delay_s, f.job, f.a, f.run_at, f.locked, CASE WHEN f.s = 'running' AND f.locked + INTERVAL 20 MINUTES < e.moment THEN (CASE WHEN f.a >= 2 THEN 'dead' ELSE 'queued' END) ELSE f.s END AS x FROM fold f JOIN e ON e.key = f.key AND e.k = f.k + 1))
), told AS (
  SELECT was AS job_id, 2 * k AS n, ws AS status, wa AS attempts, NULL::TIMESTAMP AS locked FROM fold WHERE was IS NOT NULL UNION ALL SELECT job, 2 * k + 1, s, a, locked FROM fold WHERE job IS NOT NULL
), last AS (SELECT job_id, arg_max(status, n) AS status, arg_max(attempts, n) AS attempts, max_by(coalesce(locked, TIMESTAMP '2100-01-01'), n) AS locked FROM told GROUP BY 1)
SELECT job_id, CASE WHEN status = 'running' AND locked + INTERVAL 20 MINUTES < (SELECT max(moment) - INTERVAL 10 MINUTES FROM e) THEN (CASE WHEN attempts >= 2 THEN 'dead' ELSE 'queued' END) ELSE status END AS status, attempts::INT AS attempts FROM last""")
def job_stream(spark, d):
    """The queue as a stream with leases by timers, over all events as changes of jobs: the last state of each job."""
    n = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in ("enqueue", "enqueue", "claim", "finish", "fail", "claim", "enqueue")]), (n % 7 + 1).cast("int"))
    begin = 1_704_067_200_000_000
    at = F.timestamp_micros(F.lit(begin) + F.floor((F.unix_micros("ts") - begin) / 200))
    key = F.when(n % 11 > 0, F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")))
    events = _event_stream(spark, d).select(n.alias("job_id"), key.alias("dedupe_key"), action.alias("action"), at.alias("at"), n.alias("seq"), F.lit(2).alias("max_attempts"), (n % 4 * 60).alias("delay_s"))
    own = store.folder(spark, "queue")
    leases.changes(events, own, f"{own}-checkpoint").awaitTermination()
    return leases.current(spark, own).select("job_id", "status", "attempts")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    source = spark.readStream.schema(_t(spark, d, "events").schema).parquet(corpus.stream_path(d, "events"))
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM e),
g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOURS AS b, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, s.n)
SELECT user_id, epoch_us(a)::BIGINT AS begin_us, epoch_us(b)::BIGINT AS end_us, n, total FROM g WHERE b <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""")
def session_windows(spark, d):
    """An extension: sessions of users as a stream gives them, those that the last watermark has closed."""
    own = store.folder(spark, "sessions")
    found = joins.sessions(_event_stream(spark, d), "user_id", "6 hours")
    joins.batches(found, own, f"{own}-checkpoint").awaitTermination()
    return joins.given(spark, own, found).select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n", F.round("total", 3).alias("total"))


@query("""WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), r AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'),
j AS (SELECT l.user_id, l.event_id AS left_id, r.event_id AS right_id FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 12 HOURS),
m AS (SELECT least((SELECT max(ts) FROM l), (SELECT max(ts) FROM r)) - INTERVAL 10 MINUTES AS mark)
SELECT j.* FROM j JOIN l ON event_id = left_id, m WHERE right_id IS NOT NULL OR l.ts + INTERVAL 12 HOURS < mark""")
def stream_interval_join(spark, d):
    """An extension: views with the clicks of their user within twelve hours, as two streams joined; views without one once none can come."""
    own = store.folder(spark, "interval")
    side = lambda kind, name: _event_stream(spark, d).filter(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    found = joins.within(side("view", "left_id"), side("click", "right_id"), "user_id", "12 HOURS", how="left_outer")
    joins.batches(found, own, f"{own}-checkpoint").awaitTermination()
    return joins.given(spark, own, found).select("user_id", "left_id", "right_id")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN upper(source) ELSE source END AS source, md5(text) AS text_md5, version FROM documents, (SELECT unnest([1, 2]) AS version) WHERE version = 2 AND doc_id % 10 <> 7 OR version = 2 AND doc_id % 10 = 7 UNION ALL SELECT doc_id, source, md5(text), 1 FROM documents WHERE doc_id % 10 <> 7")
def upload_versions(spark, d):
    """Uploads that replace in place: most documents, then those of two endings, one of them new; both versions read back."""
    docs, own = _t(spark, d, "documents").select("doc_id", "source", "text"), store.folder(spark, "uploads")
    versions.overwrite(docs.filter("doc_id % 10 <> 7"), own, ["doc_id"], 16)
    again = docs.filter("doc_id % 10 IN (3, 7)").withColumn("source", F.when(F.col("doc_id") % 10 == 3, F.upper("source")).otherwise(F.col("source")))
    versions.replace(again, own, ["doc_id"], 16)
    both = [versions.read(spark, own, n).select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.lit(n).alias("version")) for n in (1, 2)]
    return both[0].unionByName(both[1])


_SECTIONED = _structure_sql(_MARKED).replace("md5(text)", "text").replace("md5(single.text)", "single.text").replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 13 <> 5)")
_SUMMED = rf"""sec AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ordinal) AS nth, CASE WHEN heading_path <> '' THEN heading_path ELSE title END AS lead, left(trim(regexp_replace(text_md5, '\s+', ' ', 'g')), 400) AS body FROM parts WHERE kind = 'section'),
summed AS (SELECT *, left(CASE WHEN body <> '' THEN lead || ': ' || body ELSE lead END, 4000) AS summary FROM sec)"""


def _indexed(spark: SparkSession, d: str) -> indexing.Indexed:
    """All documents as files, some headings in place of lines; every 13th can't be read, every 17th has no text."""
    n = F.col("doc_id")
    mark = lambda x, i: F.when((n % 3 != 0) & (i % 17 == 3), F.concat(F.repeat(F.lit("#"), 1 + (i * 7) % 4), F.lit(" Part "), i.cast("string"))).when(i % 23 == 11, F.concat(F.lit("[page "), i.cast("string"), F.lit("]"))).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n")
    docs = _t(spark, d, "documents")
    rows = docs.select(n.alias("node_id"), F.col("lang").alias("repository"), corpus.node_path().alias("path"), F.concat("lang", F.lit("-"), n.cast("string")).alias("name"), F.when(n % 17 != 9, text).otherwise("  \n").alias("text"), F.when(n % 13 == 5, "parser_error").alias("error"))
    return indexing.index_nodes(rows, providers.HashEmbedder(64), dim=64, sizes={"target": 120, "most": 200, "overlap": 20})


@query(f"""WITH parts AS ({_SECTIONED}), {_SUMMED},
ch AS (SELECT node_id, count(*) AS chunk_count, sum(tokens)::BIGINT AS tokens FROM parts WHERE kind = 'chunk' AND node_id % 17 <> 9 GROUP BY 1),
se AS (SELECT node_id, count(*) AS section_count, arg_min(summary, nth) AS summary FROM summed WHERE node_id % 17 <> 9 GROUP BY 1)
SELECT doc_id AS node_id, CASE WHEN chunk_count IS NULL THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 13 = 5 THEN 'parser_error' WHEN chunk_count IS NULL THEN 'no_text' ELSE '' END AS error,
  coalesce(chunk_count, 0) AS chunk_count, coalesce(section_count, 0) AS section_count, coalesce(tokens, 0) AS tokens, md5(left(coalesce(summary, ''), 2000)) AS summary_md5 FROM documents d LEFT JOIN ch ON ch.node_id = doc_id LEFT JOIN se ON se.node_id = doc_id""")
def index_files(spark, d):
    """Files to nodes in one call: what has become of each."""
    return _indexed(spark, d).nodes.select("node_id", "status", "error", "chunk_count", "section_count", "tokens", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


@query(rf"""WITH parts AS ({_SECTIONED}), {_SUMMED},
w AS (SELECT node_id * 1000000 + ordinal AS section_id, unnest(list_filter(regexp_split_to_array(lower(CASE WHEN heading_path <> '' THEN left(heading_path, 2000) || chr(10) || summary ELSE summary END), '\s+'), lambda x: x <> '')) AS w FROM summed WHERE node_id % 17 <> 9),
b AS (SELECT section_id, ('0x' || left(md5(w), 7))::BIGINT % 64 AS bucket, count(*) AS n FROM w GROUP BY 1, 2)
SELECT section_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY section_id)), 6) AS weight FROM b""")
def index_section_vectors(spark, d):
    """The vectors of all sections, of their heading and summary, as far as they are not 0."""
    each = _indexed(spark, d).sections.select("section_id", F.posexplode("embedding").alias("bucket", "weight")).filter("weight <> 0")
    return each.select("section_id", F.col("bucket").cast("long"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {_METRICS}, t AS (SELECT {_TIER} FROM scored)
SELECT 'score' AS step, 'done' AS status, count(*) AS rows, count_if(tier = 'core') AS core, count_if(tier = 'short') AS short, count_if(tier = 'long') AS long FROM t
UNION ALL SELECT 'broken', 'failed', 0, 0, 0, 0""")
def step_runs(spark, d):
    """Two runs of pipeline steps over all parts: what was counted as each was written, and what became of it."""
    registry, own = Registry(), store.folder(spark, "runs")
    registry.register(Plugin("score", "score", "Weighted scorecard", lambda df, _: records.weighted_scores(df, "record_id", _CARD)))
    registry.register(Plugin("broken", "score", "A step that fails", lambda df, _: df.withColumn("x", F.raise_error(F.lit("no")).cast("int"))))
    for name in ("score", "broken"):
        run = runs.queue_run(spark, own, name, name)
        runs.execute(spark, own, run, registry, {}, _metrics(spark, d), lambda df, name=name: df.write.parquet(store.folder(spark, name)))
    n = lambda key: F.coalesce(F.try_element_at("counts", F.lit(key)), F.lit(0)).alias(key)
    return runs.current(spark, own).select("step", "status", n("rows"), n("core"), n("short"), n("long"))


def _turn(spark: SparkSession, d: str) -> tools.Turn:
    c = corpus.chunks(spark, d)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n")
    own = c.groupBy("node_id", "section_id").agg(F.floor(F.min("ordinal") / corpus.SECTION_CHUNKS).alias("ordinal"), body.alias("summary"))
    sections = own.withColumns({"level": F.lit(1), "title": F.concat(F.lit(f"{chunking.BODY} "), (F.col("ordinal") + 1).cast("string"))})
    return tools.Turn(stored.of_tables(spark, d), corpus.nodes(spark, d), sections, ["en", "fr"])


@query(rf"""WITH {Q.CHUNKS}, o AS (SELECT min(ordinal) // 6 AS ordinal, string_agg(text, chr(10) ORDER BY ordinal) AS body FROM c WHERE node_id = (SELECT min(doc_id) FROM documents WHERE lang = 'en') GROUP BY section_id),
b AS (SELECT text, row_number() OVER w AS nth, coalesce(sum(length(text) + 1) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, ordinal FROM c WHERE node_id = (SELECT min(doc_id) FROM documents WHERE lang = 'en') WINDOW w AS (ORDER BY ordinal))
SELECT * FROM (SELECT 'rag_browse' AS tool, name AS first, source_size AS second FROM (SELECT lang, source AS name, sum(n_chars)::VARCHAR AS source_size FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1, 2) ORDER BY name, lang LIMIT 200)
UNION ALL SELECT 'rag_outline', '본문 ' || (ordinal + 1), md5(CASE WHEN length(t) > 180 THEN left(t, 180) || '…' ELSE t END) FROM (SELECT ordinal, trim(regexp_replace(body, '\s+', ' ', 'g')) AS t FROM o) WHERE ordinal < 300
UNION ALL SELECT 'rag_read', count(*)::VARCHAR, md5(string_agg(left(text, (900 - before)::INT), chr(10) ORDER BY ordinal)) FROM b WHERE nth <= 80 AND before < 900""")
def tool_calls(spark, d):
    """What three of the tools give of the corpus' English and French files, of the first English one."""
    turn = _turn(spark, d)
    path = corpus.nodes(spark, d).filter("repository = 'en'").orderBy("node_id").first()["path"]
    one = turn.call("rag_browse").select(F.lit("rag_browse").alias("tool"), F.col("name").alias("first"), F.col("size_bytes").cast("string").alias("second"))
    two = turn.call("rag_outline", path=path).select(F.lit("rag_outline"), "line", F.md5(F.col("summary").cast("binary")))
    three = turn.call("rag_read", path=path, max_chars="900").select(F.lit("rag_read"), F.col("n_chunks").cast("string"), F.md5(F.col("text").cast("binary")))
    return one.union(two).union(three)
