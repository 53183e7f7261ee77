"""Written tables of the engine, in the folder that the cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset and Spark runs in this
process alone, a temporary folder is used; on a cluster it must be set, as no folder of the driver
is seen by executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder for one use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graniq-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graniq/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table, with a directory for each value of ``by``, read again."""
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str = "number", first: int = 1) -> DataFrame:
    """Rows with their number in a total order.

    Rows are ranged and sorted, and written with their place in their range; the counts of the ranges, a row for
    each, give the numbers that come before. So no task sees all rows, as a window over all of them would.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, folder(rows.sparkSession, "numbered")).withColumn("__range", F.shiftright("__at", 33))
    ranges = placed.groupBy("__range").agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = ranges.select("__range", (before - F.col("__from") + first).alias("__shift"))
    return placed.join(shift, "__range").withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")
