"""Models as interfaces over Columns, with deterministic stand-ins that work offline.

An embedder turns texts into vectors, a chat model prompts into answers; both are Columns, so a
real one is a Pandas UDF that calls a server for a batch, and a stand-in stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniq.functions import text as T
from graniq.functions import vectors as V


class Embedder(Protocol):
    dim: int

    def embed(self, text: Column) -> Column: ...


class ChatModel(Protocol):
    def answer(self, prompt: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: str, text: Column) -> Column: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Bags of hashed words."""

    dim: int = 256

    @property
    def name(self) -> str:
        return f"hash/{self.dim}"

    def embed(self, text: Column) -> Column:
        """The vector of single texts, such as a query."""
        return V.hash_embedding(text, self.dim)

    def embed_table(self, texts: DataFrame, key: str) -> DataFrame:
        """key, embedding of a table of texts (key, text): words are counted by an aggregation."""
        return V.hash_embeddings(texts, key, self.dim)


@dataclass(frozen=True)
class Scripted:
    """A chat model whose answers are an expression of the prompt."""

    script: Callable[[Column], Column]

    def answer(self, prompt: Column) -> Column:
        return self.script(prompt)


@dataclass(frozen=True)
class Overlap:
    """The offline reranker: trigram similarity."""

    def score(self, query: str, text: Column) -> Column:
        return T.similarity(T.trigrams(text), T.trigrams(F.lit(query)))


def embedded(parts: DataFrame, model: Embedder, dim: int = 1536, name: str = "embedding", heading: str = "heading_path", text: str = "text") -> DataFrame:
    """Parts with the vector of their text below its heading path, cut or filled up to ``dim``; used for chunks, for the summaries of sections and for records alike."""
    return parts.withColumn(name, V.pad(model.embed(T.embed_text(F.col(heading), F.col(text))), dim))


def _asked(rows: DataFrame, task: str, model: ChatModel) -> DataFrame:
    return rows.withColumn("__json", T.lenient_json(model.answer(F.concat(F.lit(task + "\nText:\n"), F.coalesce("text", F.lit(""))))))


def extract(docs: DataFrame, key: str, model: ChatModel, task: str = "Give a JSON object with title and summary.") -> DataFrame:
    """Records that a model finds in texts (key, text): key, title, summary. An answer without JSON, or without a title, gives none."""
    found = _asked(docs, task, model)
    field = lambda name, n: F.substr(F.coalesce(F.get_json_object("__json", f"$.{name}"), F.lit("")), F.lit(1), F.lit(n))
    return found.select(key, field("title", 2000).alias("title"), field("summary", 4000).alias("summary")).filter("title <> ''")


def classify(rows: DataFrame, key: str, labels: list[str], model: ChatModel, cap: int = 8) -> DataFrame:
    """Labels of texts (key, text) by a model: key, labels. Its answer is a list or an object with one; labels that are not asked for don't count."""
    found = _asked(rows, "Choose from: " + "; ".join(labels), model)
    given = F.coalesce(F.from_json("__json", "array<string>"), F.from_json(F.get_json_object("__json", "$.labels"), "array<string>"), F.array().cast("array<string>"))
    known = F.array_distinct(F.filter(given, lambda x: x.isin(labels)))
    return found.select(key, F.slice(known, 1, cap).alias("labels"))
