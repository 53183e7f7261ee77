"""The queries opN_<name> over the test tables, and their DuckDB SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniq.llm import media, warc
from graniq.llm.chat_format import chat_windows, read_windows
from graniq.llm.decontaminate import contaminated
from graniq.llm.filter_audit import filter_audit, labelled, text_failures
from graniq.llm.jaccard_join import jaccard_components
from graniq.llm.katz import katz
from graniq.llm.merkle import fold, leaf, merkle_manifest, proof
from graniq.llm.mixing import mix
from graniq.llm.quality import classify
from graniq.llm.secret_scan import secret_scan
from graniq.llm.storage import materialize
from graniq.llm.token_files import read_tokens, write_tokens
from graniq.llm.url_filter import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives, deduplicated, and read back from the deduplicated archives."""
    first = warc.write_archives(_table(spark, sf_dir, "pages"))
    heads = materialize(warc.headers(first), "warc-headers")
    second = warc.deduplicate(first, heads, min_bytes=1000)
    return warc.resolved(materialize(warc.headers(second), "warc-headers")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by components of links: sets of 3-word shingles, Jaccard similarity of 0.9 or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the co-trained classifier; keep is its decision."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "text_score", "page_score", "score", "keep")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least half of a benchmark item in tiles of four words or more."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), min_match=4, threshold=0.5)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, written, and read back."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    back = read_windows(materialize(chat_windows(turns.unionByName(own)), "op5"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as plane-shuffled files of token ids, read back from the files."""
    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules net/, example.net/en/, example.com/de/ and org/fr/ over all pages."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: weights 3, 1, 2, 150 % of all words, at most two copies."""
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken, "source", "rate", "copies")


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts scored by a model of words, pairs and triples of those whose crc32(doc_id) mod 7 is not 2."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scores = katz(_table(spark, sf_dir, "documents"), ~held, order=3).scores
    return scores.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op10_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as images in archives, read back through the data source."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for member, image, error in zip(*(batch.column(c).to_pylist() for c in ("member", "media", "error"))):
                if error:
                    raise OSError(error)
                samples, n = media.from_png(image)
                name = member.rpartition("-")[0]
                rows.append((None if name == "null" else int(name), n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.features(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _MEDIA.split(", ")])

    folder = media.write_media(_table(spark, sf_dir, "documents"))
    return media.read_media(spark, folder).mapInArrow(digest, _MEDIA)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all texts. A source is an owner, its languages are the repositories; a value of one source alone is owner-specific."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repository"))
    found = secret_scan(docs, max_owners=1)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, a part for each source."""
    return filter_audit(labelled(text_failures(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels")), list("ABCDE"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language, and a third of them, with lower-cased texts, held against it."""
    docs = _table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], lower))
    rows = merkle_manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"claimed": tampered})
    folded = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("claimed"), F.col("path")).alias("folded_root"), "lang")
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat_format": op5_chat_format,
    "op6_token_files": op6_token_files,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_katz": op9_katz,
    "op10_media_archives": op10_media_archives,
    "op11_secret_scan": op11_secret_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _places(kind: int, pattern: str, value: str, keep: str) -> str:
    """SQL of the matches of one kind: the stop of each is the length of all gaps and matches up to it."""
    return f"""
SELECT doc_id, source, lang, {kind} AS kind, stop - length(m) AS start, stop, v FROM (
  SELECT doc_id, source, lang, ms[i] AS m, {value} AS v, list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x)))::BIGINT + list_sum(list_transform(list_slice(ms, 1, i), lambda x: length(x)))::BIGINT AS stop
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, source, lang, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d))
) WHERE {keep}"""


def _secret_sql() -> str:
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    assign = rf"""(?:{"|".join(either(w) for w in ("password", "passwd", "secret", "token"))}|{either("api")}_?{either("key")})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    run = "[A-Za-z0-9+/_-]{20,}={0,2}"
    looks = "length(v) BETWEEN 16 AND 256 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8"
    kinds = [_places(0, assign, f"regexp_extract(ms[i], '{assign}', 1)", "length(v) >= 6"), _places(1, "AKIA[A-Z0-9]+", "ms[i]", "length(m) >= 20"), _places(2, "[0-9a-f]+", "ms[i]", "length(m) >= 24"), _places(4, run, "ms[i]", looks)]
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
looking AS (SELECT * FROM m WHERE {looks}),
held AS (SELECT v FROM (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners FROM m GROUP BY 1) WHERE owners = 1),
s AS (SELECT doc_id, kind, start, stop FROM m WHERE kind < 3 UNION ALL SELECT DISTINCT doc_id, 3, stop - length(v), stop FROM looking JOIN held USING (v)),
n AS (SELECT *, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop AS one FROM s),
g AS (SELECT doc_id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, count_if(kind = 3) AS n_live, string_agg(one, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(one, ',' ORDER BY start, kind, stop) AS spans FROM n GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live FROM documents LEFT JOIN g USING (doc_id)
"""


_AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM t
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
r AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM r GROUP BY 1, 2),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
x AS (SELECT part, o, step, n, good, toxic, fails[o[step]] AS own, len(list_filter(o[1:step - 1], lambda k: fails[k])) = 0 AS reached, len(list_filter(fails, lambda b: b)) AS many FROM c, s)
SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (reached AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (reached AND own), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (NOT reached AND own), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (own AND many = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (reached AND own), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (reached AND own), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(many, 1)) FILTER (own), 0)::BIGINT AS shapley FROM x GROUP BY part, o, step
"""


def _tree_sql(name: str, leaves: str, levels: int) -> list[str]:
    """SQL of trees over leaves(g, i, n, h): tables name0.. of nodes, and name_path: g, i (of the leaf), p (siblings from there on), l, r."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        up = f"CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END"
        out.append(f"{name}{k + 1} AS (SELECT g, j AS i, (n + 7) // 8 AS n, {up} AS h FROM (SELECT *, i // 8 AS j FROM {name}{k}) GROUP BY g, j, n)")
    side = lambda k, op: f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.i) FROM {name}{k} s WHERE s.g = x.g AND s.i // 8 = x.i // {8 ** (k + 1)} AND s.i {op} x.i // {8**k} AND s.n > 1), '')"
    steps = ", ".join(f"{{'l': {side(k, '<')}, 'r': {side(k, '>')}, 'open': (SELECT any_value(s.n) FROM {name}{k} s WHERE s.g = x.g) > 1}}" for k in range(levels))
    out.append(f"{name}_path AS (SELECT g, i, list_filter([{steps}], lambda s: s.open) AS path FROM {name}0 x)")
    return out


def _merkle_sql() -> str:
    part = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    digest = lambda t: f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', t))})"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
    trees = _tree_sql("a", "SELECT coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM d", 5)
    crown = _tree_sql("b", "SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM (SELECT g, h FROM a5)", 2)
    return f"""
WITH c AS (SELECT *, xor({crc}, 4294967295) AS crc FROM documents),
d AS (SELECT doc_id, lang, {digest("text")} AS leaf, CASE WHEN crc % 3 = 0 THEN {digest(f"translate(text, {_UPPER})")} END AS claimed FROM c),
{", ".join(trees)}, {", ".join(crown)},
g AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS k FROM a5),
o AS (SELECT doc_id, lang, leaf, coalesce(claimed, leaf) AS claimed, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM d),
p AS (SELECT doc_id, lang, leaf, claimed, subroot, b2.h AS root, list_concat(a_path.path, b_path.path) AS path FROM o JOIN g USING (g) JOIN a_path ON a_path.g = o.g AND a_path.i = o.i JOIN b_path ON b_path.i = k, b2),
q AS (SELECT *, list_reduce(list_prepend({{'l': '', 'r': claimed, 'open': true}}, path), lambda x, s: {{'l': '', 'r': sha256(s.l || x.r || s.r), 'open': true}}).r AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, lang, folded_root = root AS verified FROM q
"""


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op1_warc_revisits": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM q
""",
    "op2_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, len(w) || ' ' || array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2
), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM t x JOIN t y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * same >= 90 * (na.n + nb.n - same)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, c.least), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM r GROUP BY 1) c ON c.doc_id = d.doc_id
""",
    "op7_url_filter": r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, p, v)
), m AS (
  SELECT u.page_id, u.host, u.path, h || p AS rule, v,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = h OR u.host LIKE '%.' || h) AND starts_with(u.path, p)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op11_secret_scan": _secret_sql(),
    "op12_filter_audit": _AUDIT_SQL,
    "op13_merkle_manifest": _merkle_sql(),
}
