"""Fusion of legs, and growth of the winners into passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniq.config import LEGS, SearchConfig
from graniq.functions import text as T
from graniq.sources import store


def fuse(legs: dict[str, DataFrame], cfg: SearchConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, score, legs: weighted reciprocal ranks, summed leg by leg in a fixed order; the pool of the best.

    A leg of no weight adds nothing. Ties go to the earlier leg, the better rank in it, the
    smaller chunk_id. With columns ``by`` (a query_id) each of their values has a pool of its own.
    """
    weights = dict(zip(LEGS, cfg.weights))
    parts = [df.select(*by, "chunk_id", F.lit(i).alias("leg"), "rnk") for i, name in enumerate(LEGS) if (df := legs.get(name)) is not None and weights[name] > 0]
    both = reduce(DataFrame.unionByName, parts)
    per = [F.max(F.when(F.col("leg") == i, F.lit(weights[name]) / (F.lit(cfg.rrf_k) + F.col("rnk")))) for i, name in enumerate(LEGS)]
    score = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in per])
    names = F.array(*[F.lit(x) for x in LEGS])
    out = both.groupBy(*by, "chunk_id").agg(score.alias("score"), F.min(F.struct("leg", "rnk")).alias("first"), F.transform(F.array_sort(F.collect_set("leg")), lambda i: F.element_at(names, i + 1)).alias("legs"))
    order = [F.col("score").desc(), F.col("first"), F.col("chunk_id")]
    if by:
        best = out.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= cfg.pool)
    else:
        best = out.orderBy(*order).limit(cfg.pool)
    return best.select(*by, "chunk_id", "score", "legs")


def expand(fused: DataFrame, chunks: DataFrame, window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Passages: node_id, first (ordinal), ordinals, text, score, legs.

    Winners of a node within 2 * window + 1 of each other are one run; its text is that of
    all chunks from window before to window after it. Texts are fetched for these alone.
    """
    won = (fused if by else F.broadcast(fused)).join(chunks.select("chunk_id", "node_id", "ordinal"), "chunk_id")
    by_node = Window.partitionBy(*by, "node_id").orderBy("ordinal")
    gap = F.col("ordinal") - F.lag("ordinal").over(by_node) > 2 * window + 1
    won = won.withColumn("run", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(by_node.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "legs"))), lambda x: x["legs"])
    runs = won.groupBy(*by, "node_id", "run").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.max("score").alias("score"), F.array_distinct(F.flatten(in_order)).alias("legs"))
    wanted = runs.withColumn("ordinal", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("first") - window), F.col("last") + window)))
    # Many are written, so that Spark knows their size: few passages go to the texts, and not the texts to them.
    wanted = store.written(wanted, store.folder(wanted.sparkSession, "wanted")) if by else F.broadcast(wanted)
    parts = wanted.join(chunks.select("node_id", "ordinal", "text"), ["node_id", "ordinal"])
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    texts = F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t != "")
    joined = F.regexp_replace(F.array_join(texts, "\n"), r"^\s+|\s+$", "")
    return parts.groupBy(*by, "node_id", "run", "first").agg(F.max("score").alias("score"), F.first("legs").alias("legs"), joined.alias("text"), F.transform(ordered, lambda x: x["ordinal"]).alias("ordinals")).drop("run")


def _order(*more: Column) -> list[Column]:
    return [*more, F.col("score").desc(), F.col("node_id"), F.col("first")]


def diversify(passages: DataFrame, most: int, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds place (from 1): the first ``most`` passages of a node keep their order, the others come after all of these."""
    nth = F.row_number().over(Window.partitionBy(*by, "node_id").orderBy(*_order()))
    late = passages.withColumn("late", nth > most)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*_order(F.col("late"))))  # over a pool, a few dozen rows
    return late.withColumn("place", place.cast("long")).filter(F.col("place") <= limit).drop("late")


def fit_budget(passages: DataFrame, tokens: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Passages in order of place while more than 200 of 3 * tokens characters are left; the last is cut, with an ellipsis."""
    total = 3 * tokens
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(total) - before
    cut = F.concat(F.regexp_replace(F.substr("text", F.lit(1), F.col("left").cast("int")), r"\s+$", ""), F.lit("…"))
    return passages.withColumn("left", left).filter(F.col("left") > 200).withColumn("text", F.when(F.length("text") > F.col("left"), cut).otherwise(F.col("text"))).drop("left")


def overlap_rerank(passages: DataFrame, query: str) -> DataFrame:
    """The offline reranker: by trigram similarity to the query, then the former order."""
    sim = T.similarity(T.trigrams(F.col("text")), T.trigrams(F.lit(query)))
    place = F.row_number().over(Window.orderBy(F.col("sim").desc(), "place"))
    return passages.withColumn("sim", sim).withColumn("place", place.cast("long")).drop("sim")


def context_block(passages: DataFrame, heading: str = "[검색된 문서 발췌]", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of ``by``), context: the numbered passages (place, path, heading_path, page, text) below a heading."""
    piece = F.concat(F.lit("\n"), T.cite(F.col("place"), F.col("path"), F.col("heading_path"), F.col("page")), F.lit("\n"), F.col("text"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))), lambda x: x["piece"])
    return passages.groupBy(*by).agg(F.when(F.count("*") > 0, F.array_join(F.concat(F.array(F.lit(heading)), pieces), "\n")).otherwise("").alias("context"))


def citations(found: DataFrame) -> DataFrame:
    """Numbers of passages over several searches (search, place, node_id, ordinals): each passage keeps that of its first appearance."""
    once = found.groupBy("node_id", "ordinals").agg(F.min(F.struct("search", "place")).alias("at"))
    numbered = store.numbered(once.select("at.search", "at.place", "node_id", "ordinals"), ["search", "place", "node_id"])
    return numbered.select("number", "node_id", "ordinals", "search", "place")
