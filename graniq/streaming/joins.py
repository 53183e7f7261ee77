"""Streams with state, an extension: session windows, and streams joined within an interval of time.

The same expressions hold for tables. Late rows, those behind the watermark (the latest time before the
batch before, less the delay), are dropped and counted by Spark; a session is given once the watermark has passed its end,
and a row without a partner once no partner can come any more. So a run over all that is there leaves out what
is still open at the last watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """key, begin, end, n, total: runs of a key's events (key, ts, value) less than a gap apart; an end is a gap after the last event."""
    windows = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w"))
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "total")


def within(left: DataFrame, right: DataFrame, key: str, after: str, delay: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Rows of left (key, ts, left_id) with those of right (key, ts, right_id) of the same key that come at the same time or up to ``after`` later.

    As a left outer join each row of left without a partner comes once, with nulls, when the
    watermark of both is past its time and ``after``.
    """
    l = left.select(F.col(key).alias("__key"), F.col("ts").alias("left_ts"), "left_id").withWatermark("left_ts", delay)  # noqa: E741
    r = right.select(F.col(key).alias("__other"), F.col("ts").alias("right_ts"), "right_id").withWatermark("right_ts", delay)
    same = (F.col("__key") == F.col("__other")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {after}"))
    return l.join(r, same, how).select(F.col("__key").alias(key), "left_id", "right_id", "left_ts", "right_ts")


def batches(df: DataFrame, target: str, checkpoint: str, interval: str | None = None):
    """Start a query that appends what is final below ``target/batch=<id>``, in overwrite mode, so that a repeated batch replaces itself; without an interval it ends with the rows that are there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def given(spark: SparkSession, target: str, like: DataFrame) -> DataFrame:
    """All rows that have been given."""
    return spark.read.schema(like.schema).parquet(target).select(*like.columns)
