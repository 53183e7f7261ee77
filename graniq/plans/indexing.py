"""Indexing end to end: from files with their texts to nodes with counters, sections with summaries, and chunks, with vectors of both."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniq.functions import text as T
from graniq.functions import vectors as V
from graniq.operators.chunking import structure
from graniq.plans.providers import ChatModel, Embedder
from graniq.sources import store, versions

#: Ids of sections and chunks are those of their node times this, plus their number, which must be less.
STRIDE = 1_000_000
# Sections that a model sums up at most, the least characters of one that it does, the characters that it sees.
SUMMARIES, LEAST, SEEN = 60, 200, 6000


class Indexed(NamedTuple):
    """nodes: node_id, repository, path, name, status (ready, failed), error, chunk_count, section_count, tokens, text_preview, summary, embedding_model.

    sections: section_id, node_id, repository, ordinal, level, title, heading_path, parent_id, page, chunk_from, chunk_to, tokens, summary, embedding.
    chunks: chunk_id, node_id, section_id, repository, path, status, ordinal, heading_path, page, tokens, text, embedding. All are written tables.
    """

    nodes: DataFrame
    sections: DataFrame
    chunks: DataFrame


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def summaries(sections: DataFrame, model: ChatModel | None = None) -> DataFrame:
    """Sections (name of the file, nth, heading_path, title, text) with summary: below the heading its first 400 characters, or what a model says of it.

    A model is asked for the first SUMMARIES sections of a node that have LEAST characters; where it says nothing the text's beginning stays.
    """
    lead = F.when(F.coalesce("heading_path", F.lit("")) != "", F.col("heading_path")).otherwise(F.coalesce("title", F.lit("")))
    body = F.substr(T.one_line(F.col("text")), F.lit(1), F.lit(400))
    plain = F.when(body != "", F.concat(lead, F.lit(": "), body)).otherwise(lead)
    if model is None:
        return sections.withColumn("summary", plain)
    own = _stripped(F.col("text"))
    prompt = F.concat(F.lit("[문서] "), F.coalesce("name", F.lit("")), F.lit("\n[섹션] "), lead, F.lit("\n\n"), F.substr(own, F.lit(1), F.lit(SEEN)))
    asked = (F.col("nth") < SUMMARIES) & (F.length(own) >= LEAST)
    said = F.when(asked, model.answer(prompt))
    return sections.withColumn("summary", F.when(F.coalesce(said, F.lit("")) != "", F.concat(lead, F.lit(": "), said)).otherwise(plain))


def _with_vectors(parts: DataFrame, key: str, text: str, model: Embedder | None, dim: int) -> DataFrame:
    """Parts with the vector of their text below its heading; a model that embeds whole tables is joined by the key, another is an expression."""
    if model is None:
        return parts.withColumn("embedding", F.lit(None).cast("array<double>"))
    body = T.embed_text(F.substr(F.coalesce("heading_path", F.lit("")), F.lit(1), F.lit(2000)), F.col(text))
    if hasattr(model, "embed_table"):
        vectors = model.embed_table(parts.select(F.col(key).alias("key"), body.alias("text")), "key")
        return parts.join(vectors.select(F.col("key").alias(key), V.pad(F.col("embedding"), dim).alias("embedding")), key, "left")
    vector = model.embed(body)
    return parts.withColumn("embedding", F.when(vector.isNotNull(), V.pad(vector, dim)))


def index_nodes(files: DataFrame, embedder: Embedder | None = None, model: ChatModel | None = None, dim: int = 1536, sizes: dict[str, int] | None = None) -> Indexed:
    """Index files (node_id, repository, path, name, text, error): one call to the three tables.

    A file with an error has failed by it, one without chunks by ``no_text``; both have no sections
    and no chunks. Without an embedder vectors are null, and search goes by words. Node ids are
    distinct whole numbers.
    """
    spark = files.sparkSession
    given = store.written(files.select("node_id", "repository", "path", "name", F.coalesce("text", F.lit("")).alias("text"), "error"), store.folder(spark, "files"))
    parts = store.written(structure(given.filter("error IS NULL").select("node_id", "text"), **(sizes or {})), store.folder(spark, "parts"))
    about = given.select("node_id", "repository", "path", "name")

    own = parts.filter("kind = 'section'")
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("ordinal")) - 1  # a list of all sections beside each would grow with the square of a long text
    own = own.withColumn("nth", nth).join(about, "node_id")
    # A text with more parts fails, as ids would be those of the next node.
    at = lambda n: F.col("node_id") * STRIDE + F.when(n >= STRIDE, F.raise_error(F.lit(f"a text has more than {STRIDE} parts"))).otherwise(n)
    told = summaries(own, model).select(
        at(F.col("ordinal")).alias("section_id"), "node_id", "repository", "ordinal", "nth", "level", F.substr("title", F.lit(1), F.lit(2000)).alias("title"), F.substr("heading_path", F.lit(1), F.lit(2000)).alias("heading_path"),
        at(F.col("parent")).alias("parent_id"), "page", F.col("first").alias("chunk_from"), F.col("last").alias("chunk_to"), "tokens", F.substr("summary", F.lit(1), F.lit(4000)).alias("summary"),
    )
    sections = store.written(_with_vectors(told, "section_id", "summary", embedder, dim), store.folder(spark, "sections"))

    pieces = parts.filter("kind = 'chunk'").join(about, "node_id").select(at(F.col("ordinal")).alias("chunk_id"), "node_id", at(F.col("section")).alias("section_id"), "repository", "path", F.lit("ready").alias("status"), "ordinal", "heading_path", "page", "tokens", "text")
    chunks = store.written(_with_vectors(pieces, "chunk_id", "text", embedder, dim), store.folder(spark, "chunks"))

    of_chunks = chunks.groupBy("node_id").agg(F.count("*").alias("chunk_count"), F.sum("tokens").alias("tokens"))
    of_sections = sections.groupBy("node_id").agg(F.count("*").alias("section_count"), F.min_by("summary", "nth").alias("summary"))
    met = given.join(of_chunks, "node_id", "left").join(of_sections, "node_id", "left")
    ready = F.col("chunk_count").isNotNull()
    name = getattr(embedder, "name", "") if embedder is not None else ""
    nodes = met.select(
        "node_id", "repository", "path", "name", F.when(ready, "ready").otherwise("failed").alias("status"), F.when(ready, "").otherwise(F.coalesce(F.substr("error", F.lit(1), F.lit(500)), F.lit("no_text"))).alias("error"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunk_count", "section_count", "tokens")], F.when(ready, F.substr("text", F.lit(1), F.lit(2000))).otherwise("").alias("text_preview"), F.coalesce(F.substr("summary", F.lit(1), F.lit(2000)), F.lit("")).alias("summary"),
        F.when(ready, name).otherwise("").alias("embedding_model"),
    )
    return Indexed(store.written(nodes, store.folder(spark, "nodes")), sections.drop("nth"), chunks)


def persist(indexed: Indexed, path: str, buckets: int = versions.BUCKETS) -> None:
    """Put an index in the place of what is stored of its nodes: chunks and sections first, then the nodes that tell of them. A node that has failed keeps its former parts, which no search reads."""
    for name, table in (("chunks", indexed.chunks), ("sections", indexed.sections), ("nodes", indexed.nodes)):
        if versions.latest(f"{path}/{name}"):
            versions.replace(table, f"{path}/{name}", ["node_id"], buckets)
        else:
            versions.overwrite(table, f"{path}/{name}", ["node_id"], buckets)
