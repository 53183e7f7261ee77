"""Hybrid search over stored indexes: words, trigrams and paths, and cells of vectors."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniq.config import LEGS, SearchConfig
from graniq.operators import cells, fusion, index
from graniq.operators.index import Index, Scope
from graniq.plans.providers import Embedder, Reranker
from graniq.plans.search import query_parts
from graniq.sources import corpus, store

_LOG = logging.getLogger(__name__)
_FOUND = "place long, node_id long, first long, ordinals array<long>, legs array<string>, score double, text string"
#: The most passages that a search gives.
MOST = 20


@dataclass(frozen=True)
class Stored:
    """The indexes of a corpus. Without vectors of chunks or sections those legs don't apply."""

    index: Index
    chunks: cells.CellIndex | None = None
    sections: cells.CellIndex | None = None

    @property
    def spark(self) -> SparkSession:
        return self.index.spark


def build(chunks: DataFrame, nodes: DataFrame, sections: DataFrame | None = None, folder: str | None = None, vectors: DataFrame | None = None) -> Stored:
    """Index a corpus: chunks (with embedding, where there is one), files, and sections (section_id, embedding).

    The vectors of chunks may come as a table of their own (chunk_id, embedding), so that no text goes through the join with them.
    """
    folder = folder or store.folder(chunks.sparkSession, "stored")
    words = index.build(chunks.drop("embedding"), nodes, f"{folder}/words")
    if vectors is not None:
        chunks = chunks.drop("embedding").join(vectors, "chunk_id")
    if "embedding" not in chunks.columns:
        return Stored(words)
    ready = chunks.filter("status = 'ready' AND embedding IS NOT NULL").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"), "node_id", "repository")
    of = sections.select(F.col("section_id").alias("id"), F.col("embedding").alias("vector")) if sections is not None else None
    return Stored(words, cells.build(ready, f"{folder}/chunks"), cells.build(of, f"{folder}/sections") if of is not None else None)


_BUILT: dict[tuple[str, str], Stored] = {}


def of_tables(spark: SparkSession, sf_dir: str) -> Stored:
    """The indexes of the test tables of a folder: built by the first search of a session, and used by those after it."""
    key = spark.conf.get("spark.app.id", ""), sf_dir
    if key not in _BUILT:
        _BUILT[key] = build(corpus.chunks(spark, sf_dir), corpus.nodes(spark, sf_dir), corpus.sections(spark, sf_dir), vectors=corpus.vectors(spark, sf_dir))
    return _BUILT[key]


def scope(stored: Stored, repositories: list[str] | None = None, prefix: str = "") -> Scope:
    """A filter of rows (node_id, repository): of these repositories, and of the files below or at a path."""
    below = prefix.rstrip("/")
    inside = stored.index.table("paths").filter(F.col("path").startswith(below + "/") | (F.col("path") == below)).select("node_id") if below else None

    def apply(rows: DataFrame) -> DataFrame:
        rows = rows if repositories is None else rows.filter(F.col("repository").isin(repositories))
        return rows if inside is None else rows.join(inside, "node_id", "left_semi")

    return apply


def query_vector(spark: SparkSession, query: str, embedder: Embedder | None) -> list[float] | None:
    """The query's vector; none without an embedder, and none from one that fails: then the legs of words carry the search alone."""
    if embedder is None:
        return None
    try:
        return spark.range(1).select(embedder.embed(F.lit(query)).alias("v")).first()["v"]
    except Exception as e:  # noqa: BLE001 a model that is down costs quality, not the answer
        _LOG.warning("query without a vector: %s", str(e)[:120])
        return None


def candidate_legs(stored: Stored, query: str, vector: list[float] | None, cfg: SearchConfig, within: Scope = index.everywhere, names: list[str] = LEGS) -> dict[str, DataFrame]:
    """The legs that apply, of those named: without a query vector the lexical ones, without terms no substring legs. They run side by side."""
    spark = stored.spark
    terms, tokens, grams = query_parts(spark, query)

    def near() -> DataFrame:
        return index.placed(spark, [(i, s) for i, s in cells.nearest_to(stored.chunks, vector, cfg.per_leg, within) if s >= cfg.min_vector_score])

    legs = {"lexical": lambda: index.lexical_leg(stored.index, tokens, cfg.per_leg, within)}
    if vector is not None and stored.chunks is not None:
        legs["vector"] = near
        if stored.sections is not None:
            legs["section"] = lambda: index.section_leg(stored.index, cells.nearest_to(stored.sections, vector, max(4, cfg.per_leg // 3)), grams, cfg.top_k, within)
    if terms:
        legs["trigram"] = lambda: index.trigram_leg(stored.index, grams, terms, cfg.per_leg, within)
        legs["path"] = lambda: index.path_leg(stored.index, grams, terms, scope=within)
    asked = [name for name in LEGS if name in legs and name in names]
    with ThreadPoolExecutor(len(LEGS)) as pool:
        return dict(zip(asked, pool.map(lambda name: legs[name](), asked)))


def fused(stored: Stored, query: str, vector: list[float] | None, cfg: SearchConfig, within: Scope = index.everywhere) -> DataFrame:
    """The pool of a search as rows: chunk_id, score, legs."""
    rows = fusion.fuse(candidate_legs(stored, query, vector, cfg, within), cfg).collect()  # the pool, a few dozen rows
    columns = [pa.array([r["chunk_id"] for r in rows], pa.int64()), pa.array([r["score"] for r in rows], pa.float64()), pa.array([r["legs"] for r in rows], pa.list_(pa.string()))]
    return stored.spark.createDataFrame(pa.table(columns, names=["chunk_id", "score", "legs"]))


def passages(stored: Stored, pool: DataFrame, cfg: SearchConfig) -> DataFrame:
    """The pool grown into passages, from the chunks of its own nodes alone."""
    ids = [r["chunk_id"] for r in pool.select("chunk_id").collect()]
    nodes = [r["node_id"] for r in stored.index.chunks("chunk_id", ids).select("node_id").distinct().collect()]
    return fusion.expand(pool, stored.index.chunks("node_id", nodes), cfg.neighbor_window)


def reranked(found: DataFrame, query: str, reranker: Reranker) -> DataFrame:
    """Passages by a reranker's score, then their former place; where it fails they stay as they are."""
    try:
        scored = [(r["node_id"], r["first"], r["__s"], r["place"]) for r in found.select("node_id", "first", "place", reranker.score(query, F.col("text")).alias("__s")).collect()]  # the pool
    except Exception as e:  # noqa: BLE001 a model that is down costs quality, not the answer
        _LOG.warning("no reranking: %s", str(e)[:160])
        return found
    order = sorted(scored, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[3]))
    placed = found.sparkSession.createDataFrame([(n, f, i) for i, (n, f, _, _) in enumerate(order, 1)], "node_id long, first long, place long")
    return found.drop("place").join(F.broadcast(placed), ["node_id", "first"])


def search(stored: Stored, query: str, vector: list[float] | None = None, cfg: SearchConfig | None = None, repositories: list[str] | None = None, prefix: str = "", embedder: Embedder | None = None, reranker: Reranker | None = None) -> DataFrame:
    """Passages: place, node_id, first, ordinals, legs, score, text. A blank query or no repository finds nothing.

    The query's vector is given or comes from the embedder. With a reranker its score orders the
    pool of passages. At most MOST passages are given.
    """
    cfg = (cfg or SearchConfig()).resolved()
    cfg = replace(cfg, top_k=max(1, min(MOST, cfg.top_k)), rerank=cfg.rerank or reranker is not None)
    query = (query or "").strip()
    if not query or repositories == []:
        return stored.spark.createDataFrame([], _FOUND)
    vector = vector if vector is not None else query_vector(stored.spark, query, embedder)
    pool = fused(stored, query, vector, cfg, scope(stored, repositories, prefix))
    found = fusion.diversify(passages(stored, pool, cfg), cfg.max_per_document, cfg.pool)
    if reranker is not None:
        found = reranked(found, query, reranker)
    elif cfg.rerank:
        found = fusion.overlap_rerank(found, query)
    best = fusion.fit_budget(found.filter(F.col("place") <= cfg.top_k), cfg.budget_tokens)
    return best.select("place", "node_id", "first", "ordinals", "legs", F.round("score", 4).alias("score"), "text")
