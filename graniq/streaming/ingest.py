"""Incremental ingestion: a file stream into the chunk table, replacing per node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graniq.operators.chunking import structure


def chunk_table(nodes: DataFrame, **sizes: int) -> DataFrame:
    """Chunks of nodes (node_id, text): node_id, ordinal, section, tokens, text."""
    return structure(nodes, **sizes).filter("kind = 'chunk'").select("node_id", "ordinal", "section", "tokens", "text")


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, to_nodes: Callable[[DataFrame], DataFrame], interval: str | None = None, files: str = "*", sizes: dict[str, int] | None = None):
    """Start a query that indexes new files of a folder, those whose names fit ``files``.

    Each batch writes below ``target/batch=<id>``, in overwrite mode, so that a batch that is
    repeated after a failure gives the same table; ``latest`` reads the newest batch of each
    node. A node without chunks writes one row with null columns, so that its older chunks end.
    Without an interval it stops when all files present are done. sizes: target, most and overlap of chunks.
    """

    def write(batch: DataFrame, number: int) -> None:
        nodes = to_nodes(batch)
        nodes.select("node_id").distinct().join(chunk_table(nodes, **(sizes or {})), "node_id", "left").write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each node's newest batch."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy("node_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["node_id", "batch"], "left_semi").filter("ordinal IS NOT NULL").drop("batch")


def event_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: events per window and type, late ones dropped after the delay; for streams and tables alike."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
