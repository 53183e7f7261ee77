"""Evidence for many records: hybrid search of a table of queries, all legs as joins by query_id.

A query is a row (query_id, text and, where it has one, vector). Rankings are windows by query;
what is ranked comes from the stored indexes:

- words: a query's two rarest words give its candidates, its other words are looked up for these alone;
- vectors: the cells of the index, for all queries at once;
- substrings and similarity: queries in blocks against chunks in blocks, as every chunk that holds any
  of a query's terms is ranked by the trigrams it shares. A pair of blocks is a product of
  two matrices of trigrams, and sends on only the best of each query, so neither side meets as
  a whole and no pair of a query and a chunk leaves its block unless it is among the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graniq.config import SearchConfig
from graniq.functions import ranks as R
from graniq.functions import text as T
from graniq.operators import cells, fusion
from graniq.operators.index import each, gram_number, heads, named, runs, word_grams
from graniq.operators.index import shard as shard_of
from graniq.plans.stored import MOST, Stored
from graniq.sources import store

#: Queries of a block; texts that are ranked at once, and with many trigrams as few as make so many cells with them; how many times that and how many characters a block of texts has.
QUERIES, TEXTS, CELLS, SLICES, CHARACTERS = 256, 2048, 16_000_000, 16, 16_000_000
#: Words of a query whose chunks are met before its other words are looked up.
RAREST = 2
_BY = ("query_id",)


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """rnk from 0 within a query; the sort is over what its top-k let through."""
    return rows.withColumn("rnk", (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("long"))


def lexical(stored: Stored, queries: DataFrame, n: int) -> DataFrame:
    """query_id, chunk_id, score, rnk: the chunks that have all words of a query, by rank."""
    words = queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    index = stored.index
    shard = shard_of(F.col("word"), index.shards)
    asked = words.select("word").distinct().withColumn("shard", shard)
    known = heads(index.table("postings")).join(asked, ["shard", "word"], "left_semi").groupBy("word").agg(F.sum("chunks").alias("chunks"))
    rated = words.join(known, "word", "left").select("query_id", "word", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    own = Window.partitionBy("query_id")
    rated = rated.withColumns({"need": F.count("*").over(own), "least": F.min("chunks").over(own), "nth": F.row_number().over(own.orderBy("chunks", "word"))}).filter("least > 0")
    rated = store.written(rated.select("query_id", "word", "need", "nth"), store.folder(stored.spark, "rated"))
    postings, rare = index.table("postings"), rated.filter(F.col("nth") <= RAREST)
    lists = each(postings.join(rare.select("word").distinct().withColumn("shard", shard), ["shard", "word"], "left_semi"), "word", "block")
    first = rare.join(lists, "word").groupBy("query_id", "block", "at").agg(F.first("need").alias("need"), F.collect_list(F.struct("word", "places")).alias("words")).filter(F.size("words") == F.least("need", F.lit(RAREST)))
    first = store.written(first, store.folder(stored.spark, "candidates"))
    # Written, so that Spark knows its size when it chooses the join with the postings.
    asked = first.select("query_id", "need", "block", "at").join(rated.filter(F.col("nth") > RAREST).select("query_id", "word"), "query_id")
    asked = store.written(asked.withColumn("shard", shard), store.folder(stored.spark, "asked"))
    met = each(postings.join(asked.groupBy("shard", "word", "block").agg(F.collect_set("at").alias("wanted")), ["shard", "word", "block"]), "word", "block", wanted="wanted")
    more = asked.join(met, ["word", "block", "at"]).select("query_id", "need", "block", "at", "word", "places")
    both = first.select("query_id", "need", "block", "at", F.inline("words")).unionByName(more)
    full = both.groupBy("query_id", "block", "at").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("word", "places"))).alias("words")).filter(F.size("words") == F.col("need"))
    ranked = named(full, index.table("members"), "chunk_id").select("query_id", "chunk_id", R.rank(F.transform("words", lambda w: w["places"])).alias("score"))
    return _numbered(ranked, F.col("score").desc(), "chunk_id").filter(F.col("rnk") < n)


def _parts(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", T.query_terms(F.col("text")).alias("terms"), T.trigrams(F.col("text")).alias("grams")).filter(F.size("terms") > 0)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[runs(keys)]


def _having(words: pa.Array, grams: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts whose words stand between blanks: which of some trigrams and pairs of letters, by their numbers and in order, each has (a row of 0 and 1 for each, first the trigrams), and how many trigrams in all."""
    n = len(words)
    split = pc.split_pattern(words, " ")
    each, owner = split.flatten(), np.repeat(np.arange(n), pc.list_value_length(split).to_numpy())
    real = np.flatnonzero(pc.not_equal(each, "").to_numpy(zero_copy_only=False))
    each, owner = each.take(pa.array(real)).dictionary_encode(), owner[real]
    bits = n.bit_length()
    pair = _distinct(each.indices.to_numpy().astype(np.int64) << bits | owner)
    of, at = pair >> bits, pair & (1 << bits) - 1  # a word and a text that has it
    gram, flat, count = word_grams(each.dictionary.to_pylist())
    m = count[of]
    spread = np.repeat((np.cumsum(count) - count)[of] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    pair = _distinct(flat[spread] << bits | np.repeat(at, m))
    of, at = pair >> bits, pair & (1 << bits) - 1
    out = np.zeros((len(grams) + len(pairs), n), dtype=np.uint8)
    for asked, first, own in ((grams, 0, gram), (pairs, len(grams), gram >> 21), (pairs, len(grams), gram & (1 << 42) - 1)):
        if len(asked):
            place = np.minimum(np.searchsorted(asked, own), len(asked) - 1)
            hit = asked[place] == own
            kept = slice(None) if hit.all() else np.flatnonzero(hit[of])
            out[(place + first)[of[kept]], at[kept]] = 1
    return out, np.bincount(at, minlength=n)


def _inner(term: str) -> list[int]:
    """The trigrams, or where its longest run of letters and digits has but two the pair, that every text with a term has, as numbers; none where it has but one."""
    piece = max(term.split("_"), key=len)
    return [ord(piece[0]) << 21 | ord(piece[1])] if len(piece) == 2 else [gram_number(piece[i : i + 3]) for i in range(len(piece) - 2)]


def _most_similar(q: pa.Table, t: pa.Table, n: int) -> pa.Table:
    """query_id, id, score, length: for a block of queries (query_id, terms, grams) and one of texts (id, lower, words, length) the n best texts of each query that hold any of its terms."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    if q.num_rows and t.num_rows:
        t = t.combine_chunks()
        ids, lengths, lower, words = t.column("id").to_numpy(), t.column("length").to_numpy(), t.column("lower"), t.column("words").combine_chunks()
        asked, terms = [[gram_number(g) for g in x] for x in q.column("grams").to_pylist()], q.column("terms").to_pylist()
        inner = {w: _inner(w) for x in terms for w in x}
        every, size = np.array(sorted({g for x in [*asked, *inner.values()] for g in x}), dtype=np.int64), np.array([[len(x)] for x in asked])
        pairs = np.searchsorted(every, 1 << 42)  # numbers of pairs are less than those of trigrams
        every = np.concatenate([every[pairs:], every[:pairs]])
        row = {g: i for i, g in enumerate(every.tolist())}
        inner = {w: [row[g] for g in x] for w, x in inner.items()}
        grams = len(every) - pairs
        wanted = np.zeros((len(asked), grams), dtype=np.float32)
        for i, x in enumerate(asked):
            wanted[i, [row[g] for g in x]] = 1
        # Of each query the best so far, as ids, scores and lengths; later texts must reach the last of n.
        held, least = [(ids[:0], np.zeros(0), lengths[:0])] * len(asked), np.full((len(asked), 1), -1.0)
        step = max(1, min(TEXTS, CELLS // max(1, len(every))))
        for start in range(0, len(ids), step):
            own_ids, own_lengths = ids[start : start + step], lengths[start : start + step]
            has, sizes = _having(words[start : start + step], every[:grams], every[grams:])
            shared = (wanted @ has[:grams].astype(np.float32)).astype(np.float64)  # whole numbers, exact as floats
            score = shared / np.maximum(1.0, sizes[None, :] + size - shared)
            can = {w: has[x].all(axis=0) if x else np.ones(len(own_ids), dtype=bool) for w, x in inner.items()}
            for i, reached in enumerate(score >= least):
                at = np.flatnonzero(reached)
                at = at[np.logical_or.reduce([can[w][at] for w in terms[i]])]
                at = at[np.lexsort((own_ids[at], own_lengths[at], -score[i, at]))]
                real: list[int] = []
                for k in at.tolist():  # the best first, until n of them hold a term
                    text = lower[start + k].as_py()
                    if any(w in text for w in terms[i]):
                        real.append(k)
                        if len(real) == n:
                            break
                if real:
                    new = [np.concatenate(c) for c in zip(held[i], (own_ids[real], score[i, real], own_lengths[real]))]
                    order = np.lexsort((new[0], new[2], -new[1]))[:n]
                    held[i] = tuple(c[order] for c in new)
                    least[i] = held[i][1][-1] if len(order) == n else -1.0
        out += [(np.full(len(x[0]), query), *x) for query, x in zip(q.column("query_id").to_pylist(), held) if len(x[0])]
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "id", "score", "length"])


def substrings(queries: DataFrame, texts: DataFrame, n: int, shorter_first: bool = True) -> DataFrame:
    """query_id, id, score, rnk: of the texts (id, text) that hold any term of a query anywhere, the n most similar to it by trigrams; then the shorter, then by id."""
    texts = texts.filter(F.col("text").isNotNull())
    parts, rows = _parts(queries), texts.select("id", F.lower("text").alias("lower"), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ").alias("words"), (F.length("text") if shorter_first else F.lit(0)).cast("long").alias("length"))
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, characters = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_queries, n_texts = max(1, -(-parts.count() // QUERIES)), max(1, -(-total // (TEXTS * SLICES)), -(-characters // CHARACTERS), min(4 * partitions, -(-total // TEXTS)))

    def best(q: pa.Table, t: pa.Table) -> pa.Table:
        return _most_similar(q, t, n)

    def blocks(side: DataFrame, key: str, mine: int, own: str, others: int, other: str) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64(key), F.lit(mine))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    # As many tasks as asked for: what a block costs is its product, not its bytes, by which Spark would merge tasks.
    tasks = min(n_queries * n_texts, partitions)
    left, right = (side.repartition(tasks, "l", "r").groupBy("l", "r") for side in (blocks(parts, "query_id", n_queries, "l", n_texts, "r"), blocks(rows, "id", n_texts, "r", n_queries, "l")))
    pairs = left.cogroup(right)
    found = pairs.applyInArrow(best, "query_id long, id long, score double, length long")
    return _numbered(found, F.col("score").desc(), "length", "id").filter(F.col("rnk") < n).select("query_id", "id", "score", "rnk")


def _few_of_each(stored: Stored, queries: DataFrame, hits: DataFrame, column: str, cap: int) -> DataFrame:
    """Of the chunks of each hit (query_id, id, score, rnk) the most similar to the query, a few of each, numbered in order."""
    chunks = stored.index.table("chunks").select("chunk_id", F.col(column).alias("id"), "ordinal", "text")
    hits = store.written(hits, store.folder(stored.spark, "hits"))  # of a known size, so that few hits go to the texts and not the texts to them
    grams = queries.select("query_id", T.trigrams(F.col("text")).alias("asked"))
    met = hits.withColumnRenamed("rnk", "place").join(chunks, "id").join(grams, "query_id")
    met = met.select("query_id", "place", "chunk_id", "ordinal", "score", T.similarity(T.trigrams(F.col("text")), F.col("asked")).alias("sim"))
    within = F.row_number().over(Window.partitionBy("query_id", "place").orderBy(F.col("sim").desc(), "ordinal", "chunk_id"))
    kept = met.withColumn("within", within).filter(F.col("within") <= cap)
    return _numbered(kept, "place", "within").select("query_id", "chunk_id", "score", "rnk")


def legs(stored: Stored, queries: DataFrame, cfg: SearchConfig) -> dict[str, DataFrame]:
    """The legs of all queries: query_id, chunk_id, score, rnk."""
    asked = queries.select("query_id", "text")
    index, out = stored.index, {}
    if "vector" in queries.columns and stored.chunks is not None:
        vectors = queries.select(F.col("query_id").alias("id"), "vector")
        near = cells.nearest(stored.chunks, vectors, cfg.per_leg, exact=True).filter(F.col("score") >= cfg.min_vector_score)
        out["vector"] = near.withColumnRenamed("id", "chunk_id")
        if stored.sections is not None:
            hits = cells.nearest(stored.sections, vectors, max(4, cfg.per_leg // 3), exact=True)
            out["section"] = _few_of_each(stored, asked, hits, "section_id", max(2, cfg.top_k // 2))
    out["lexical"] = lexical(stored, asked, cfg.per_leg)
    chunks = index.table("chunks")
    out["trigram"] = substrings(asked, chunks.select(F.col("chunk_id").alias("id"), "text"), cfg.per_leg).withColumnRenamed("id", "chunk_id")
    files = substrings(asked, index.table("paths").select(F.col("node_id").alias("id"), F.col("path").alias("text")), 8, shorter_first=False)
    out["path"] = _few_of_each(stored, asked, files, "node_id", 3)
    return out


def search(stored: Stored, queries: DataFrame, cfg: SearchConfig | None = None) -> DataFrame:
    """query_id, place, node_id, first, ordinals, legs, score, text: what ``stored.search`` gives for each query (query_id, text, vector).

    Query ids are distinct; a null or blank text finds nothing. Legs are written once, as each of
    them is read by fusion and again for the nodes of the winners.
    """
    cfg = (cfg or SearchConfig()).resolved()
    cfg = SearchConfig(**{**cfg.__dict__, "top_k": max(1, min(MOST, cfg.top_k))})
    stripped = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    asked = store.written(queries.withColumn("text", stripped).filter("text <> ''"), store.folder(stored.spark, "queries"))
    pool = store.written(fusion.fuse(legs(stored, asked, cfg), cfg, _BY), store.folder(stored.spark, "pool"))
    found = fusion.diversify(fusion.expand(pool, stored.index.table("chunks"), cfg.neighbor_window, _BY), cfg.max_per_document, cfg.pool, _BY)
    best = fusion.fit_budget(found.filter(F.col("place") <= cfg.top_k), cfg.budget_tokens, _BY)
    return best.select("query_id", "place", "node_id", "first", "ordinals", "legs", F.round("score", 4).alias("score"), "text")


def evidence(stored: Stored, queries: DataFrame, k: int = 6, quote: int = 400, cfg: SearchConfig | None = None) -> DataFrame:
    """query_id, context, citations: for each query the block that a model is shown, and what it may cite (path, score, quote); queries that find nothing have an empty block."""
    cfg = SearchConfig(**{**(cfg or SearchConfig()).resolved().__dict__, "top_k": k})
    found = search(stored, queries, cfg).join(stored.index.table("paths").select("node_id", "path"), "node_id").withColumns({"heading_path": F.lit(""), "page": F.lit(None).cast("int")})
    found = store.written(found, store.folder(stored.spark, "evidence"))
    cites = F.array_sort(F.collect_list(F.struct("place", "path", "score", F.substr("text", F.lit(1), F.lit(quote)).alias("quote")))).alias("citations")
    shown = fusion.context_block(found, by=_BY).join(found.groupBy("query_id").agg(cites), "query_id")
    none = F.array().cast("array<struct<place:bigint,path:string,score:double,quote:string>>")
    return queries.select("query_id").join(shown, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("citations", none).alias("citations"))
