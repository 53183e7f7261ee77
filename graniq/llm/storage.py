"""Intermediate tables and files in the folder that the cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset and Spark runs in
this process alone (tests, notebooks), a temporary folder is used and set for the session; on
a cluster it must be set, as no folder of the driver is seen by executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder for one use, below the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graniq-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graniq/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: what follows reads files that survive the loss of any executor.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, max_bytes: int = 8 << 20) -> None:
    """Bound the Arrow batches sent to Python by bytes, so that long texts don't add up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b")) > max_bytes:
        spark.conf.set(key, str(max_bytes))


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute path."""
    return fs.FileSystem.from_uri(path)


def remove(folder: str) -> None:
    """Delete a folder of files that nothing will read again."""
    where, path = open_fs(folder)
    if where.get_file_info(path).type != fs.FileType.NotFound:
        where.delete_dir(path)


def forget(table: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(folder)
