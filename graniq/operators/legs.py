"""The five candidate generators of hybrid search.

A corpus has chunks (chunk_id, node_id, section_id, ordinal, text, path, repository, status
and, where there are vectors, embedding) and sections (section_id, embedding). Each leg
returns chunk_id, rnk (from 0), score, at most a few dozen rows: every ranking is a top-k
(TakeOrderedAndProject) before anything is joined or numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniq.functions import ranks as R
from graniq.functions import text as T
from graniq.functions import vectors as V


def scope(chunks: DataFrame, repositories: list[str] | None = None, prefix: str = "", wildcards: bool = False) -> DataFrame:
    """Chunks of ready files in these repositories, below or at a path. With ``wildcards``, % and _ in the path are those of LIKE."""
    out = chunks.filter(F.col("status") == "ready")
    if repositories is not None:
        out = out.filter(F.col("repository").isin(repositories))
    if prefix := prefix.rstrip("/"):
        below = F.col("path").like(prefix + "/%") if wildcards else F.col("path").startswith(prefix + "/")
        out = out.filter(below | (F.col("path") == prefix))
    return out


def _ranked(top: DataFrame, *order: Column) -> DataFrame:
    """Numbers of a handful of rows; the window has no more than the top-k above it let through."""
    return top.withColumn("rnk", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def vector_leg(chunks: DataFrame, vector: Column, n: int = 24, least: float = 0.15) -> DataFrame:
    """The n nearest chunks by cosine, then those of at least the least score."""
    scored = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", V.cosine(F.col("embedding"), vector).alias("score"))
    order = F.col("score").desc_nulls_last(), F.col("chunk_id")
    return _ranked(scored.orderBy(*order).limit(n).filter(F.col("score") >= least), *order)


def _similar(rows: DataFrame, text: str, grams: list[str], name: str) -> DataFrame:
    """rows with the trigram similarity of a text to the query's grams; the text's own are built once."""
    return rows.withColumn("__grams", T.trigrams(F.col(text))).withColumn(name, T.similarity_to(F.col("__grams"), grams)).drop("__grams")


def section_leg(chunks: DataFrame, sections: DataFrame, vector: Column, grams: list[str], n: int = 24, k: int = 8) -> DataFrame:
    """The chunks of the nearest sections, the most similar to the query's text first, a few of each."""
    cap = max(2, k // 2)
    near = sections.filter(F.col("embedding").isNotNull()).select("section_id", V.cosine(F.col("embedding"), vector).alias("score"))
    order = F.col("score").desc_nulls_last(), F.col("section_id")
    top = _ranked(near.orderBy(*order).limit(max(4, n // 3)), *order).withColumnRenamed("rnk", "srank")
    found = _similar(chunks.join(F.broadcast(top), "section_id").select("chunk_id", "score", "srank", "ordinal", "text"), "text", grams, "sim")
    within = F.row_number().over(Window.partitionBy("srank").orderBy(F.col("sim").desc(), "ordinal", "chunk_id"))
    kept = found.withColumn("within", within).filter(F.col("within") <= cap)
    return _ranked(kept, F.col("srank"), F.col("within")).select("chunk_id", "score", "rnk")


def lexical_leg(chunks: DataFrame, query_tokens: list[str], n: int = 24) -> DataFrame:
    """Chunks with all tokens of the query, by the rank over the tokens' places; none for a query without tokens."""
    wanted = list(dict.fromkeys(query_tokens))
    if not wanted:
        return chunks.select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rnk")).limit(0)
    has_all = F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col("tokens"))) == 0
    found = chunks.select("chunk_id", T.words(F.col("text")).alias("tokens")).filter(has_all)
    at = lambda w: R.places(F.filter(F.transform("tokens", lambda x, i: F.when(x == w, i + 1)), lambda i: i.isNotNull()))
    ranked = found.select("chunk_id", F.array(*[at(w) for w in wanted]).alias("words")).select("chunk_id", R.rank(F.col("words")).alias("score"))
    order = F.col("score").desc(), F.col("chunk_id")
    return _ranked(ranked.orderBy(*order).limit(n), *order)


def trigram_leg(chunks: DataFrame, grams: list[str], terms: list[str], n: int = 24) -> DataFrame:
    """Chunks that contain a term anywhere, by trigram similarity to the query, shorter ones first."""
    found = _similar(chunks.filter(T.contains_any(F.col("text"), terms)).select("chunk_id", "text", F.length("text").alias("len")), "text", grams, "score").select("chunk_id", "score", "len")
    order = F.col("score").desc(), F.col("len"), F.col("chunk_id")
    return _ranked(found.orderBy(*order).limit(n), *order).select("chunk_id", "score", "rnk")


def path_leg(chunks: DataFrame, nodes: DataFrame, grams: list[str], terms: list[str], files: int = 8, cap: int = 3) -> DataFrame:
    """Chunks of the files whose path contains a term, a few of each."""
    files_ = nodes.filter((F.col("kind") == "file") & (F.col("status") == "ready") & T.contains_any(F.col("path"), terms))
    hits = _similar(files_.select("node_id", "path"), "path", grams, "score").select("node_id", "score")
    order = F.col("score").desc(), F.col("node_id")
    top = _ranked(hits.orderBy(*order).limit(files), *order).withColumnRenamed("rnk", "prank")
    found = _similar(chunks.join(F.broadcast(top), "node_id").select("chunk_id", "score", "prank", "ordinal", "text"), "text", grams, "sim")
    within = F.row_number().over(Window.partitionBy("prank").orderBy(F.col("sim").desc(), "ordinal", "chunk_id"))
    kept = found.withColumn("within", within).filter(F.col("within") <= cap)
    return _ranked(kept, F.col("prank"), F.col("within")).select("chunk_id", "score", "rnk")


def batch_lexical(chunks: DataFrame, queries: DataFrame, n: int = 24) -> DataFrame:
    """Lexical leg for many queries(query_id, text) at once, by an inverted index: query_id, chunk_id, score, rnk.

    Distinct (chunk, token, count) rows meet the query's tokens in an equi-join, and a chunk
    is kept if it has as many of a query's tokens as the query; counting is combined before
    the shuffle. Frequent tokens are skewed keys, which the adaptive join splits.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("token"))
    need = wanted.groupBy("query_id").agg(F.count("*").alias("need"))
    asked = wanted.select("token").distinct()
    index = chunks.select("chunk_id", F.explode(T.words(F.col("text"))).alias("token")).join(F.broadcast(asked), "token", "left_semi").groupBy("chunk_id", "token").agg(F.count("*").cast("double").alias("tf"))
    found = index.join(wanted, "token").groupBy("query_id", "chunk_id").agg(F.count("*").alias("have"), F.sum(F.round(F.col("tf") / (F.col("tf") + 1), 9).cast("decimal(20,9)")).cast("double").alias("score"))
    full = found.join(need, "query_id").filter("have = need")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    return full.withColumn("rnk", (rank - 1).cast("long")).filter(F.col("rnk") < n).select("query_id", "chunk_id", "score", "rnk")
