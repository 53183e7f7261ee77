"""Hybrid search: legs, fusion, passages, order and budget as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniq.config import SearchConfig
from graniq.functions import text as T
from graniq.operators import browse, fusion, legs


def query_parts(spark: SparkSession, query: str) -> tuple[list[str], list[str], list[str]]:
    """Terms, tokens and trigrams of one query, by the same expressions that columns use."""
    q = F.lit(query)
    row = spark.range(1).select(T.query_terms(q).alias("terms"), F.array_distinct(T.words(q)).alias("tokens"), T.trigrams(q).alias("grams")).first()
    return row["terms"], row["tokens"], row["grams"]


def candidate_legs(chunks: DataFrame, nodes: DataFrame, sections: DataFrame | None, query: str, vector: Column | None, cfg: SearchConfig, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The legs that apply: without a query vector the lexical ones, without terms no substring legs. Vectors of chunks may be a table of their own."""
    cfg = cfg.resolved()
    terms, tokens, grams = query_parts(chunks.sparkSession, query)
    out = {}
    if vector is not None:
        own = chunks if vectors is None else chunks.select("chunk_id").join(vectors, "chunk_id")
        out["vector"] = legs.vector_leg(own, vector, cfg.per_leg, cfg.min_vector_score)
        if sections is not None:
            out["section"] = legs.section_leg(chunks, sections, vector, grams, cfg.per_leg, cfg.top_k)
    out["lexical"] = legs.lexical_leg(chunks, tokens, cfg.per_leg)
    if terms:
        out["trigram"] = legs.trigram_leg(chunks, grams, terms, cfg.per_leg)
        out["path"] = legs.path_leg(chunks, nodes, grams, terms)
    return out


def search(chunks: DataFrame, nodes: DataFrame, sections: DataFrame | None, query: str, vector: Column | None = None, cfg: SearchConfig | None = None, repositories: list[str] | None = None, prefix: str = "", vectors: DataFrame | None = None) -> DataFrame:
    """Passages: place, node_id, first, ordinals, legs, score, text. A blank query or an empty scope finds nothing.

    The vectors of chunks may come as a table of their own (chunk_id, embedding), so that no text goes through the join with them.
    """
    cfg = (cfg or SearchConfig()).resolved()
    query = (query or "").strip()
    inside = legs.scope(chunks, repositories, prefix)
    if not query or repositories == []:
        inside = inside.limit(0)
    found = candidate_legs(inside, legs.scope(nodes, repositories, prefix), sections, query, vector, cfg, vectors)
    passages = fusion.diversify(fusion.expand(fusion.fuse(found, cfg), chunks, cfg.neighbor_window), cfg.max_per_document, cfg.pool)
    if cfg.rerank:
        passages = fusion.overlap_rerank(passages, query)
    best = fusion.fit_budget(passages.filter(F.col("place") <= cfg.top_k), cfg.budget_tokens)
    return best.select("place", "node_id", "first", "ordinals", "legs", F.round("score", 4).alias("score"), "text")


def visible_names(repositories: DataFrame, user: str, wanted: list[str] | None = None, admin: bool = False) -> list[str]:
    """The repositories (repository, owner_id, visibility) that a user may see, or those wanted; an unknown or hidden one among them is an error."""
    own = sorted(r["repository"] for r in browse.visible(repositories, user, admin).select("repository").distinct().collect())
    if wanted is not None:
        if hidden := set(wanted) - set(own):
            raise LookupError(f"no such repository: {', '.join(sorted(hidden))}")
        own = wanted
    return own


def search_visible(chunks: DataFrame, nodes: DataFrame, sections: DataFrame | None, repositories: DataFrame, user: str, query: str, vector: Column | None = None, cfg: SearchConfig | None = None, wanted: list[str] | None = None, admin: bool = False) -> DataFrame:
    """A search over all repositories (repository, owner_id, visibility) that a user may see, of those wanted where a list is given; an unknown or hidden one among them is an error."""
    own = visible_names(repositories, user, wanted, admin)
    return search(chunks, nodes, sections, query, vector, cfg, repositories=own)


def evidence(found: DataFrame, nodes: DataFrame, heading: Column | None = None, page: Column | None = None, quote: int = 400) -> DataFrame:
    """What an assertion rests on, from a search: number, path, heading, page, score, quote."""
    named = found.join(nodes.select("node_id", "path"), "node_id")
    return named.select(F.col("place").alias("number"), "path", (F.lit("") if heading is None else heading).alias("heading"), (F.lit(None).cast("int") if page is None else page).alias("page"), "score", F.substr("text", F.lit(1), F.lit(quote)).alias("quote"))
