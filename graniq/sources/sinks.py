"""What leaves the engine: event frames, reports into the corpus, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_frame(payload: Column) -> Column:
    """A server-sent event: one ``data:`` line of JSON and a blank line."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def write_reports(cards: DataFrame, folder: str) -> DataFrame:
    """Write cards (file, markdown) as a table of the corpus' reports folder, and return them as nodes to ingest (path, text)."""
    nodes = cards.select(F.concat(F.lit("/reports/"), F.col("file")).alias("path"), F.col("markdown").alias("text"))
    nodes.write.mode("overwrite").parquet(folder)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(folder)


def snapshot(tables: dict[str, DataFrame], folder: str, day: str) -> list[str]:
    """A dated copy of tables; the folders written. Old days are the store's to expire."""
    paths = [f"{folder}/{day}/{name}" for name in sorted(tables)]
    for name, path in zip(sorted(tables), paths):
        tables[name].write.mode("overwrite").parquet(path)
    return paths
