"""Counts, logs, retention and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniq.functions import text as T


def zero_filled_counts(parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return parents.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def repository_counts(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per repository: files, bytes, chunks; zero where there are none."""
    files = nodes.groupBy("repository").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))
    parts = chunks.groupBy("repository").agg(F.count("*").alias("n_chunks"))
    return files.join(parts, "repository", "left").select("repository", "n_files", "n_bytes", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def node_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("node_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("section_id").alias("n_sections"), F.sum(T.token_count(F.col("text"))).alias("n_tokens"))


def histogram(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def usage(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Calls and token sums of the last hours before as_of; zero for none."""
    recent = events.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    return recent.agg(F.count("*").alias("n_calls"), F.coalesce(F.round(F.sum("value"), 4), F.lit(0.0)).alias("tokens"))


def log_page(log: DataFrame, limit: int = 500) -> DataFrame:
    return log.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(min(limit, 500))


def retain(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """What is left after a purge of rows older than so many days."""
    return log.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def history(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, system turns left out, in order: nth from 1."""
    said = turns.filter(F.col("role").isin("user", "assistant"))
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    kept = said.withColumn("back", back).filter(F.col("back") <= n)
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return kept.select("conv_id", nth.cast("long").alias("nth"), "turn", "role", "text")


def transcript(turns: DataFrame) -> DataFrame:
    """Each conversation as one text of labelled turns; other roles, and answers without a text, are left out."""
    # The labels of turns.
    line = F.when(F.col("role") == "user", F.concat(F.lit("[사용자]\n"), F.coalesce("text", F.lit("")))).when((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) != ""), F.concat(F.lit("[assistant]\n"), F.col("text")))
    said = turns.withColumn("line", line).filter("line IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return said.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(ordered, "\n\n").alias("text"))


def conversation_titles(turns: DataFrame) -> DataFrame:
    first = turns.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", T.title_of(F.col("text")).alias("title"))


def turn_totals(searches: DataFrame, key: str) -> DataFrame:
    """Per turn of search log rows (leg, hits, score, reranked): searches, hits, best score, whether any was reranked."""
    return searches.groupBy(key).agg(F.count("*").alias("n_searches"), F.sum("hits").alias("hits"), F.max("score").alias("top_score"), F.bool_or("reranked").alias("reranked"))


def search_log(log: DataFrame, limit: int = 100, most: int = 500, at: str = "ts", key: str = "event_id", contains: dict[str, str] | None = None, equals: dict[str, str] | None = None) -> DataFrame:
    """The newest rows of a log whose columns contain the given parts (any of them), case aside, and equal the given values; empty ones ask for nothing."""
    parts = [T.contains_text(F.col(c), v) for c, v in (contains or {}).items() if v]
    for c, v in (equals or {}).items():
        if v:
            log = log.filter(F.col(c) == v)
    if parts:
        any_of = parts[0]
        for p in parts[1:]:
            any_of = any_of | p
        log = log.filter(any_of)
    return log.orderBy(F.col(at).desc(), F.col(key).desc()).limit(min(limit, most))


# How many rows the listings show.
NEWEST = {"reviews": 30, "runs": 40, "conversations": 100}
OLDEST = {"messages": 400}


def listing(rows: DataFrame, name: str, at: str, key: str) -> DataFrame:
    """Rows of a listing by time: the newest first, of messages the oldest."""
    if name in OLDEST:
        return rows.orderBy(at, key).limit(OLDEST[name])
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(NEWEST[name])


def streamed_usage(counters: DataFrame, key: str, *columns: str) -> DataFrame:
    """Token usage of a turn from counters that only grow while it streams: their greatest values."""
    return counters.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])


def owned(rows: DataFrame, row_id: Column, repository: str, key: str = "node_id") -> DataFrame:
    """The row of this number, if it is the repository's; else none."""
    return rows.filter((F.col(key) == row_id) & (F.col("repository") == repository))
